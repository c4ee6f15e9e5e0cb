import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillmill.operators import annotate, dml, generated, library, match, tasks
from quillmill.schemas import TASK


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_fanout_and_corrected_counts(spark):
    books = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, title string")
    chapters = spark.createDataFrame([("c1", "a"), ("c2", "a")], "id string, book_id string")
    questions = spark.createDataFrame([("q1", "a"), ("q2", "a"), ("q3", "a")], "id string, book_id string")
    fan = {r["book_id"]: (r["n_chapters"], r["n_questions"]) for r in library.book_stats_fanout(books, chapters, questions).collect()}
    true = {r["book_id"]: (r["n_chapters"], r["n_questions"]) for r in library.book_stats(books, chapters, questions).collect()}
    assert fan == {"a": (2, 6), "b": (0, 0)} and true == {"a": (2, 3), "b": (0, 0)}


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([("x", 1, "old", 1), ("y", 2, "old", 1)], "id string, k int, v string, at int")
    new = spark.createDataFrame([("x2", 1, "new", 2), ("x3", 1, "newest", 3), ("z", 3, "add", 1)], "id string, k int, v string, at int")
    assert sorted(r["v"] for r in dml.upsert(old, new, ["k"], "at").collect()) == ["add", "newest", "old"]
    accepted, rejected = dml.insert_new(old, new, ["k"])
    assert ids(accepted) == ["z"] and ids(rejected) == ["x2", "x3"]
    assert ids(dml.insert_or_ignore(old, new, ["k"], ["at"])) == ["z"]


def test_overlay_keeps_what_has_no_change(spark):
    old = spark.createDataFrame([("a", "1", "p"), ("b", "2", "q")], "id string, v string, w string")
    new = spark.createDataFrame([("a", "9", None)], "id string, v string, w string")
    assert {r["id"]: (r["v"], r["w"]) for r in dml.overlay(old, new, "id", ["v", "w"]).collect()} == {"a": ("9", "p"), "b": ("2", "q")}


def test_cascade(spark):
    chapters = spark.createDataFrame([("c1", "a"), ("c2", "b")], "id string, book_id string")
    questions = spark.createDataFrame([("q1", "c1"), ("q2", "c2"), ("q3", None)], "id string, chapter_id string")
    doomed = spark.createDataFrame([("a",)], "id string")
    c, q = dml.delete_cascade(doomed, [(chapters, "book_id", "id"), (questions, "chapter_id", "id")])
    assert ids(c) == ["c2"] and ids(q) == ["q2", "q3"]


def test_append_continues_numbers(spark):
    old = spark.createDataFrame([("a", "g", 3)], "id string, g string, order_index int")
    new = spark.createDataFrame([("b", "g", 0), ("c", "g", 0), ("d", "h", 0)], "id string, g string, order_index int")
    assert {r["id"]: r["order_index"] for r in dml.append_ordered(old, new, "g", ["id"]).collect()} == {"b": 4, "c": 5, "d": 1}


@pytest.fixture
def queue(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 9, m)
    rows = [
        ("1", "questions", 3, "queued", "b1", "c1", json.dumps({"grade_level": "grade-1", "question_number": 1}), 0, None, None, None, t(1), None, None),
        ("2", "tags", 1, "queued", "b1", None, "{}", 0, None, None, None, t(2), None, None),
        ("3", "questions", 3, "processing", "b1", "c1", json.dumps({"grade_level": "grade-1", "question_number": 2}), 1, t(3), t(18), None, t(3), t(3), None),
        ("4", "questions", 3, "ready", "b2", "c2", None, 1, t(3), t(18), None, t(3), t(3), t(9)),
    ]
    return spark.createDataFrame(rows, TASK)


def test_task_order_and_timeouts(queue):
    assert [r["id"] for r in tasks.waiting(queue, 5).collect()] == ["2", "1"]
    now = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    late = {r["id"]: r["status"] for r in tasks.timed_out(queue, now).collect()}
    assert late == {"1": "queued", "2": "queued", "3": "error", "4": "ready"}
    taken = tasks.assigned(queue, now, 1).first()
    assert (taken["id"], taken["status"], taken["attempts"], taken["timeout_at"]) == ("2", "processing", 1, dt.datetime(2024, 1, 1, 10, 15))


def test_enqueue_keys(spark, queue):
    new = queue.filter("id = '1'").withColumn("id", F.lit("9"))
    third = new.withColumn("id", F.lit("8")).withColumn("payload", F.lit('{"grade_level": "grade-1", "question_number": 3}'))
    both = new.unionByName(third)
    assert ids(tasks.enqueue(queue, both)) == []
    assert ids(tasks.enqueue(queue, both, with_number=True)) == ["8"]
    assert ids(tasks.replaced(queue, new)) == ["2", "3", "4", "9"]


def test_states_and_changes(queue):
    assert {r["chapter_id"]: r["state"] for r in tasks.chapter_states(queue).collect()} == {"c1": "processing", "c2": "ready"}
    row = queue.limit(1).select(tasks.grade_changes(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("g")).first()["g"]
    assert (row["removed"], row["added"], row["wanted"]) == (["a"], ["c"], ["c"])


def test_empty_tables(spark, queue):
    none = queue.limit(0)
    assert tasks.status_counts(none).first().asDict() == {"queued": 0, "processing": 0, "ready": 0, "error": 0}
    assert tasks.enqueue(none, none).count() == 0 and tasks.latest_by_book(none).count() == 0


def test_passages(spark):
    documents = spark.createDataFrame([("b", [f"paragraph number {i} tells about thing {i}" for i in range(6)]), ("empty", [])], "k string, p array<string>")
    excerpts = spark.createDataFrame([("b", "x", "Paragraph number 2, tells"), ("b", "y", "tiny"), ("b", "z", "not to be found anywhere"), ("empty", "e", "paragraph number 2 tells"), ("b", "n", None)], "k string, id string, text string")
    assert [(r["id"], r["idx"]) for r in match.passages(excerpts, documents, "k").collect()] == [("x", 2)]
    long = spark.createDataFrame([("b", "long", "paragraph number 3 tells about thing 3 " + "and more " * 100)], "k string, id string, text string")
    whole = documents.withColumn("p", F.transform("p", lambda p: F.concat(p, F.lit(" " + "and more " * 20))))
    assert [(r["id"], r["idx"]) for r in match.passages(long, whole, "k").collect()] == [("long", 3), ("long", 4), ("long", 5)]


def test_token_sort_ratio(spark):
    df = spark.createDataFrame([("the quick brown fox", "quick the brown fox"), ("", ""), ("abc", "xyz"), ("ab cd", "cd abx"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(match.token_sort_ratio("a", "b")).collect()]
    assert got[:3] == [100.0, 100.0, 0.0] and abs(got[3] - 200 * 5 / 11) < 1e-9 and got[4] is None


def test_likeness_claims(spark):
    left = spark.createDataFrame([("k", "l1", 1, "the quick brown fox"), ("k", "l2", 2, "the quick brown fax")], "k string, id string, pos int, text string")
    right = spark.createDataFrame([("k", 7, "quick the brown fox"), ("k", 8, "nothing alike at all here")], "k string, idx int, text string")
    assert [(r["idx"], r["id"]) for r in match.claimed(left, right, "k", 60.0).collect()] == [(7, "l1")]
    same = spark.createDataFrame([("k", 7, "the quick brown fox")], "k string, idx int, text string")
    assert [(r["idx"], r["id"]) for r in match.claimed(left, same, "k").collect()] == [(7, "l1")]


def test_notes(spark):
    words = [{"word": "fox", "definition": 'an "animal"', "example": "A fox."}, {"word": "red fox", "definition": "kind", "example": None}]
    assert annotate.note_first("<p class='fox'>A Fox, a fox</p>", words[:1]) == "<p class='fox'>A Fox, a fox</p>"
    assert annotate.note_first("A Fox, a fox", words[:1]) == 'A <abbr title="an &quot;animal&quot;">Fox</abbr>, a fox'
    df = spark.createDataFrame([(1, "A red fox and a fox", words), (2, None, words), (3, "x", None)], "id int, t string, v array<struct<word:string,definition:string,example:string>>")
    got = {r["id"]: r["h"] for r in df.select("id", annotate.note_all(F.col("t"), F.col("v")).alias("h")).collect()}
    assert got[2] is None and got[3] == "x" and got[1].count("<abbr") >= 2
    assert {r["id"]: r["html"] for r in annotate.noted(df, "id", "t", "v").collect()}[3] == "x"


def test_provider(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    assert {r["id"]: r["response"] for r in generated.answered(df, lambda ps: [p.upper() for p in ps]).collect()} == {1: "A", 2: "B"}


def test_numbers_of_hot_groups(spark):
    rows = [("hot", i % 7, f"{i:05}") for i in range(3000)] + [(f"g{i % 50}", i % 3, f"x{i:05}") for i in range(500)] + [(None, 1, "n1"), (None, 0, "n2")]
    got = library.numbered(spark.createDataFrame(rows, "g string, k int, id string"), "g", ["k", "id"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted(x[1:] for x in rows if x[0] == g), 1):
            want[g, r[1]] = n
    assert {(r["g"], r["id"]): r["number"] for r in got} == want and len(got) == len(rows)
    assert library.numbered(spark.createDataFrame([], "g string, k int, id string"), "g", ["k", "id"]).count() == 0


def test_append_without_group(spark):
    """Rows without a group are numbered as one group of their own."""
    old = spark.createDataFrame([("a", "g", 3)], "id string, g string, order_index int")
    new = spark.createDataFrame([("b", "g"), ("c", None), ("d", None)], "id string, g string")
    assert {r["id"]: r["order_index"] for r in dml.append_ordered(old, new, "g", ["id"]).collect()} == {"b": 4, "c": 1, "d": 2}
    graded = spark.createDataFrame([("a", None), ("b", " "), ("c", "grade-2")], "id string, grade_level string")
    assert [r["grade_level"] for r in dml.with_item_grade(graded, F.lit("grade-1")).orderBy("id").collect()] == ["grade-1", "grade-1", "grade-2"]
