import re

import pytest
from pyspark.sql import functions as F

from quillmill.llm import levels, residue, truncation
from quillmill.tables import table


@pytest.fixture(scope="module")
def samples(spark, data):
    return [(r["text"], r["reading_level"]) for r in table(spark, data, "level_samples").orderBy("sample_id").collect()]


def level_of(model, text):
    d = levels.difficulty(levels.Scorer(model).distribution(text))
    return levels.LEVELS[0 if d < model.cuts[0] else 1 if d < model.cuts[1] else 2]


def test_held_out_passages(samples):
    right = 0
    for fold in range(3):
        model = levels.fit([s for i, s in enumerate(samples) if i // 3 % 3 != fold])
        right += sum(level_of(model, t) == y for i, (t, y) in enumerate(samples) if i // 3 % 3 == fold)
    assert right >= 0.93 * len(samples)


def test_levels_without_marks_or_case(samples):
    model = levels.fit(samples)
    flat = [(t.lower().replace(".", " ").replace('"', " "), y) for t, y in samples]
    assert sum(level_of(model, t) == y for t, y in flat) >= 0.9 * len(flat)
    assert levels.Scorer(model).distribution("123 ... !!") is None


def test_stated_levels(spark):
    df = spark.createDataFrame([(" Beginner ", "4-6"), ("LEVEL: ADVANCED", "ages 12 to 15"), ("unknown", "all ages"), (None, None), ("", "8+"), ("Intermediate reader", "11–13")], "reading_level string, age_range string")
    got = [tuple(r) for r in df.select(levels.stated_level(F.col("reading_level")), levels.stated_age_level(F.col("age_range"))).collect()]
    assert got == [("beginner", "beginner"), ("advanced", "advanced"), (None, None), (None, None), (None, "intermediate"), ("intermediate", "intermediate")]


def test_contradictions(spark, samples):
    easy, hard = next(t for t, y in samples if y == "beginner"), next(t for t, y in samples if y == "advanced")
    chapters = spark.createDataFrame([("c1", "b1", easy), ("c1", "b1", easy), ("c2", "b2", hard), ("c3", "b3", None), ("c4", "b4", ""), ("c5", "b5", hard), ("c6", None, hard)], "id string, book_id string, content string")
    books = spark.createDataFrame([("b1", "Advanced", None), ("b2", "advanced", "4-6"), ("b3", "beginner", "4-6"), ("b4", "beginner", None), ("b5", "unknown", "all ages"), ("b6", "beginner", "9+")], "id string, reading_level string, age_range string")
    labels = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(samples)], "sample_id int, text string, reading_level string")
    assert sorted(r["book_id"] for r in levels.found(chapters, books, labels).collect()) == ["b1", "b2"]
    assert {r["book_id"]: r["level"] for r in levels.book_levels(chapters, labels).collect()} == {"b1": "beginner", "b2": "advanced", "b5": "advanced"}
    assert levels.chapter_levels(chapters, labels).count() == 4
    assert levels.found(chapters.limit(0), books, labels).count() == 0


BAD = [
    "How does the {{noun}} change what Ann believes?", "Why did [object Object] think the car was red?", "If you were undefined, would you go?", "Lorem ipsum dolor sit amet.", "TODO: write item 7", "503 Service Unavailable", "Why do you think Ann ran? JavaScript is disabled in your browser.",
    '{"status": 404, "message": "Not Found"}', "Seite nicht gefunden", "BITTE AKTIVIEREN SIE JAVASCRIPT, UM FORTZUFAHREN.", "xxx", "placeholder", "Error: connection refused (os error 111)",
]
GOOD = [
    "Why does the robot answer “ERROR” whenever Ann asks about the map?", "How many {curly} shapes does Ann draw, and why?", "Which word [in the second line] tells you that?", "Fill in the missing word: Ann hid under the ______.", "Why was Ann 100% sure that Tom took it?",
    "The placeholder on the shelf was only a needle, until Ann dusted it.", "From the makers of <em>The Box</em> &amp; <em>Cat Days</em>.", "Why did the saddle forget the script for the school play?",
]


UNSEEN_GOOD = ["Fill in: 3 + __ = 7", "Read chapters [3] to [5] and compare.", "Price: $12.99 (hardcover)", "Why does Null Island have no people?", "What happens when JavaScript runs in the browser?"]
UNSEEN_BAD = ["Sorry, we could not load this page. Try again.", "Please switch on cookies before you go on.", "Your profile could not be saved. Retry later.", "Hello [[nickname]], how was the trip to the lake?", "Which of the two did ${hero_1} like more, and why?"]


def test_residue_in_unseen_words(spark, data):
    texts = residue.texts_of(table(spark, data.replace("sf0.001", "sf0.01"), "books"), table(spark, data.replace("sf0.001", "sf0.01"), "questions"))
    model = residue.fit([(r["text"], r["title"]) for r in residue.training_texts(texts)])
    assert not [t for t in UNSEEN_GOOD if model.score(t) >= residue.LIKELY]
    assert sum(model.score(t) >= residue.LIKELY for t in UNSEEN_BAD) >= 4


@pytest.mark.parametrize("family", ["SLOTS", "FILLER", "ERRORS", "SCRIPTS"])
def test_residue_decides_without_rules(spark, data, family):
    """Whatever the rules name is found by the score alone, and little else."""
    rule = re.compile("|".join(f"(?:{p})" for p in getattr(residue, family)), re.IGNORECASE)
    texts = residue.texts_of(table(spark, data.replace("sf0.001", "sf0.01"), "books"), table(spark, data.replace("sf0.001", "sf0.01"), "questions"))
    model = residue.fit([(r["text"], r["title"]) for r in residue.training_texts(texts)])
    own = [(r["text"], r["title"]) for r in texts.dropDuplicates(["field", "record_id"]).collect()]
    named = [t for t in own if rule.search(t[0])]
    assert sum(model.score(*t) >= residue.LIKELY for t in named) >= 0.95 * len(named)
    if family == "SLOTS":
        others = [t for t in own if not residue.RULES.search(t[0])]
        assert sum(model.score(*t) >= residue.LIKELY for t in others) <= 0.003 * len(others)


def test_residue(spark, data):
    books, questions = table(spark, data, "books"), table(spark, data, "questions")
    more = spark.createDataFrame([(f"bad{i}", t) for i, t in enumerate(BAD)] + [(f"good{i}", t) for i, t in enumerate(GOOD)] + [("null", None), ("empty", ""), ("blank", "  "), ("long", "A fine day. " * 5000 + "Lorem ipsum dolor sit amet.")], "id string, question_text string")
    rows = questions.select("id", "source", "question_text").unionByName(more.withColumn("source", F.lit("s")))
    rows = rows.unionByName(rows.filter("id LIKE 'bad%'"))
    found = [r["record_id"] for r in residue.found(spark, books, rows).filter("field = 'question_text'").collect()]
    assert len(found) == len(set(found))
    ours = {i for i in found if i.startswith(("bad", "good", "null", "empty", "blank", "long"))}
    assert ours == {f"bad{i}" for i in range(len(BAD))} | {"long"}
    assert residue.found(spark, books.limit(0), questions.limit(0)).count() == 0


def test_residue_on_unseen_hosts(spark, data):
    for r in residue.validation(spark, table(spark, data, "books"), table(spark, data, "questions")).collect():
        assert r["n_agree"] >= 0.95 * r["n_texts"]


def test_validation_counts_every_text(spark, data):
    """More texts than any sample of the old size held; each delivered twice counts once."""
    books, questions = table(spark, data, "books"), table(spark, data, "questions")
    many = questions.crossJoin(spark.range(12).withColumnRenamed("id", "copy")).withColumn("id", F.concat_ws("-", "id", "copy")).drop("copy")
    texts = residue.texts_of(books, many).dropDuplicates(["field", "record_id"]).collect()
    got = {r["source"]: r for r in residue.validation(spark, books, many).collect()}
    assert sum(r["source"] is not None for r in texts) > 1800
    for source in {r["source"] or "" for r in texts}:
        own = [r["text"] for r in texts if (r["source"] or "") == source]
        assert (got[source]["n_texts"], got[source]["n_weak"]) == (len(own), sum(bool(residue.RULES.search(t)) for t in own))


def test_samples_without_a_source(spark, data):
    texts = residue.texts_of(table(spark, data, "books"), table(spark, data, "questions"))
    sources = sorted({r["source"] or "" for r in texts.collect()})
    every, places = residue.samples_without(texts, sources, 5, 30)
    for s in sources[:3]:
        rest = residue.training_texts(texts.filter(F.coalesce("source", F.lit("")) != s), 5, 30)
        assert [every[i] for i in places[s]] == [(r["text"], r["title"]) for r in rest]


def test_marks_and_ends(spark):
    texts = ["It ended.", "It ended?”", "See (p. 12)", "fine 🙂", "no mark", "the &am", "a <em>b", "open (and", "list,", "“quoted", "x &amp;", "wait...", "wait..", "caf\ufffd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(truncation.closed(F.col("t"))).collect()] == [True, True, True, True] + [False] * 6 + [False, True, False, False]
    assert [r[0] for r in df.select(truncation.broken_mark(F.col("t"))).collect()] == [False] * 5 + [True] * 5 + [False, False, True, True]


def test_truncation(spark):
    names = ["Ann", "Bo", "Cato", "Dora", "Edna", "Fay", "Gus", "Hal"]
    things = ["castle", "garden", "letter", "market", "orchard", "puppet", "needle", "basket"]
    full = [f"Why do you think {n} opened the {t} after {m} ran toward the {u}?" for n in names for t in things for m, u in zip(names, things) if n != m]
    rows = [(f"q{i}", "b1", "plain", t) for i, t in enumerate(full)]
    rows += [(f"l{i}", "b1", "limited", t[:60]) for i, t in enumerate(full[:80])]
    rows += [("cut1", "b1", "plain", "Why do you think Ann opened the cas"), ("cut2", "b1", "plain", "Why do you think Ann opened the castle after "), ("cut3", "b1", "plain", "Why do you think Ann opened the castle after Bo ran toward the orc")]
    rows += [("ok1", "b1", "plain", "Why do you think Ann opened the castle after Bo ran toward the orchard"), ("ok2", "b1", "plain", "Why do you think Ann opened the..."), ("ok3", "b1", "plain", "Why do you think Ann opened the castle after Bo ran toward the orchard? (p. 12)"), ("n", "b1", "plain", None), ("e", "b1", "plain", " ")]
    rows += [rows[-8]]
    questions = spark.createDataFrame(rows, "id string, book_id string, source string, question_text string")
    books = spark.createDataFrame([], "id string, title string, source string, description string")
    found = [r["record_id"] for r in truncation.found(spark, books, questions).collect()]
    assert len(found) == len(set(found))
    expected = {i for i, _, s, t in rows if s == "limited" and not t.endswith("?")} | {"cut1", "cut2", "cut3"}
    assert set(found) == expected
    report = {r["source"]: r for r in truncation.report(spark, books, questions).collect()}
    assert report["plain"]["n_cut"] == 3 and report["limited"]["n_at_limit"] == len(expected) - 3
    assert truncation.found(spark, books, questions.limit(0)).count() == 0


def test_several_limits_of_a_source(spark):
    """Two limits in characters and one in bytes; other lengths vary."""
    rows = [(f"a{i}", "two", ("xy" * 60)[:50]) for i in range(20)] + [(f"b{i}", "two", ("xy" * 60)[:90]) for i in range(15)] + [(f"c{i}", "two", "z" * (20 + i % 60) + ".") for i in range(240)]
    rows += [(f"d{i}", "bytes", ("é" * (i % 7) + "w" * 200).encode()[:64].decode(errors="ignore")) for i in range(30)] + [(f"e{i}", "bytes", "z" * (10 + i % 40) + ".") for i in range(160)] + [(f"f{i}", "none", "z" * (10 + i % 40)) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, source string, raw string").select(F.lit("question_text").alias("field"), "source", "raw", (~truncation.closed(F.col("raw"))).alias("unclosed"))
    got = {r["source"]: sorted((x["unit"], x["most"]) for x in r["spikes"]) for r in truncation.limits(df).collect()}
    assert got == {"two": [("chars", 50), ("chars", 90)], "bytes": [("bytes", 64)]}
