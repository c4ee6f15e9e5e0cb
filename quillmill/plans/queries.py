"""Registry of the engine's own queries with the SQL that says the same over the same tables.

Every query runs over its whole tables. Where SQL cannot say it (folds, position-dependent markup), the query has no SQL and
is tested against a plain model instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.config import level_target
from quillmill.functions import clean
from quillmill.functions import text as T
from quillmill.operators import annotate, dml, generated, library, match, segment, tasks
from quillmill.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

class _Sql(str):
    """SQL with one place {0}; braces of patterns stay as they are."""

    def format(self, value: str) -> str:
        return self.replace("{0}", value)


NOW = "2024-06-01 00:00:00"
#: White space in the Unicode sense as one RE2 class, and words by it.
WS = r"[\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = _Sql(rf"regexp_replace(regexp_replace({{0}}, '^{WS}+', ''), '{WS}+$', '')")
WORDS = _Sql(rf"list_filter(regexp_split_to_array({{0}}, '{WS}+'), lambda w: w <> '')")
PARAS = _Sql("list_filter(list_transform(regexp_split_to_array({0}, '\\n\\n+'), lambda p: " + STRIP.format("p") + "), lambda p: p <> '')")
TASKS = "(SELECT DISTINCT * FROM queue_tasks)"
QUESTIONS = "(SELECT DISTINCT * FROM questions)"
HEADING = r"^(CHAPTER|Chapter|PART|Part)\s+[IVXLCDM\d]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return tasks.distinct_tasks(table(s, d, "queue_tasks"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").dropDuplicates(["id"])


# Words and sizes ---------------------------------------------------------------------------------------------------

_MINUTES = _Sql("greatest(1, CAST(round_even({0} / 200.0, 0) AS INT))")
_WC = f"len({WORDS.format('text')})"


@query("source_stats", f"SELECT source, count(*) AS n_docs, sum(n) AS n_words, sum({_MINUTES.format('n')}) AS minutes FROM (SELECT source, len({WORDS.format(chr(39) * 2 + ' || coalesce(text, ' + chr(39) * 2 + ')')}) AS n FROM documents) GROUP BY source")
def _(s, d):
    return library.source_stats(table(s, d, "documents"))


@query("doc_word_count", f"SELECT doc_id, {_WC} AS n_words FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("reading_time", f"SELECT id, {_MINUTES.format('n')} AS minutes FROM (SELECT id, len({WORDS.format('content')}) AS n FROM chapters WHERE content IS NOT NULL)")
def _(s, d):
    return table(s, d, "chapters").filter("content IS NOT NULL").select("id", T.reading_minutes(T.word_count(F.col("content"))).alias("minutes"))


@query("naive_word_count", "SELECT id, len(string_split(content, ' ')) AS n FROM chapters WHERE content IS NOT NULL AND content <> ''")
def _(s, d):
    return table(s, d, "chapters").filter("content <> ''").select("id", T.naive_word_count(F.col("content")).alias("n"))


@query("stale_word_counts", f"SELECT id, coalesce(word_count, -1) AS stored, n AS counted FROM (SELECT id, word_count, len({WORDS.format('content')}) AS n FROM chapters WHERE content IS NOT NULL) WHERE coalesce(word_count, -1) <> n")
def _(s, d):
    rows = table(s, d, "chapters").filter("content IS NOT NULL").select("id", F.coalesce("word_count", F.lit(-1)).alias("stored"), T.word_count(F.col("content")).alias("counted"))
    return rows.filter("stored <> counted")


@query("latest_docs_topk", "SELECT doc_id, source FROM documents ORDER BY created_at DESC, doc_id LIMIT 50")
def _(s, d):
    return table(s, d, "documents").orderBy(F.desc("created_at"), "doc_id").limit(50).select("doc_id", "source")


# Filters -----------------------------------------------------------------------------------------------------------


@query("active_books", "SELECT id FROM books WHERE is_active AND created_at IS NOT NULL")
def _(s, d):
    return table(s, d, "books").filter("is_active AND created_at IS NOT NULL").select("id")


@query("active_tasks", f"SELECT id FROM {TASKS} WHERE status IN ('queued', 'processing')")
def _(s, d):
    return _tasks(s, d).filter(F.col("status").isin("queued", "processing")).select("id")


@query("whole_book_tasks", f"SELECT id FROM {TASKS} WHERE chapter_id IS NULL AND payload IS NOT NULL")
def _(s, d):
    return _tasks(s, d).filter("chapter_id IS NULL AND payload IS NOT NULL").select("id")


@query("overdue_tasks", f"SELECT id FROM {TASKS} WHERE status = 'processing' AND timeout_at < TIMESTAMP '{NOW}'")
def _(s, d):
    return _tasks(s, d).filter((F.col("status") == "processing") & (F.col("timeout_at") < F.lit(NOW).cast("timestamp_ntz"))).select("id")


@query("json_payload_filter", f"SELECT id FROM {TASKS} WHERE json_extract_string(payload, '$.grade_level') IN ('grade-4', 'grade-K')")
def _(s, d):
    return _tasks(s, d).filter(tasks.payload(tasks.GRADE).isin("grade-4", "grade-K")).select("id")


@query("title_like", "SELECT id FROM books WHERE title LIKE '%Tale%'")
def _(s, d):
    return table(s, d, "books").filter(F.col("title").like("%Tale%")).select("id")


@query("grade_tags", "SELECT id, array_to_string(list_filter(tags, lambda t: starts_with(t, 'grade-')), ',') AS grades FROM books WHERE tags IS NOT NULL")
def _(s, d):
    return table(s, d, "books").filter("tags IS NOT NULL").select("id", F.array_join(T.grade_tags(F.col("tags")), ",").alias("grades"))


@query("tag_filters", "SELECT id, list_contains(tags, 'fantasy') AS has_one, list_has_any(tags, ['grade-4', 'humor']) AS has_any, list_has_all(tags, ['grade-4', 'grade-5']) AS has_all FROM books WHERE tags IS NOT NULL")
def _(s, d):
    pair = F.array(F.lit("grade-4"), F.lit("grade-5"))
    return table(s, d, "books").filter("tags IS NOT NULL").select(
        "id", F.array_contains("tags", "fantasy").alias("has_one"), F.arrays_overlap("tags", F.array(F.lit("grade-4"), F.lit("humor"))).alias("has_any"), (F.size(F.array_except(pair, "tags")) == 0).alias("has_all")
    )


@query("genre_or_tag", "SELECT id FROM books WHERE genre = 'poetry' OR list_contains(tags, 'poetry')")
def _(s, d):
    return table(s, d, "books").filter((F.col("genre") == "poetry") | F.array_contains("tags", "poetry")).select("id")


# Joins and counts --------------------------------------------------------------------------------------------------


@query("chapters_per_book", "SELECT b.id AS book_id, count(c.id) AS n_chapters FROM books b LEFT JOIN chapters c ON c.book_id = b.id GROUP BY b.id")
def _(s, d):
    return library.child_counts(table(s, d, "books").select("id"), table(s, d, "chapters"), "book_id", "n_chapters").withColumnRenamed("id", "book_id")


@query("book_stats_fanout", "SELECT b.id AS book_id, count(DISTINCT c.id) AS n_chapters, count(q.id) AS n_questions FROM books b LEFT JOIN chapters c ON c.book_id = b.id LEFT JOIN questions q ON q.book_id = b.id GROUP BY b.id")
def _(s, d):
    return library.book_stats_fanout(table(s, d, "books"), table(s, d, "chapters"), table(s, d, "questions"))


@query("book_stats", f"""
    SELECT b.id AS book_id, b.title, coalesce(c.n, 0) AS n_chapters, coalesce(q.n, 0) AS n_questions FROM books b
    LEFT JOIN (SELECT book_id, count(*) AS n FROM chapters GROUP BY book_id) c ON c.book_id = b.id
    LEFT JOIN (SELECT book_id, count(*) AS n FROM {QUESTIONS} GROUP BY book_id) q ON q.book_id = b.id""")
def _(s, d):
    return library.book_stats(table(s, d, "books"), table(s, d, "chapters"), _questions(s, d))


@query("questions_with_chapters", f"SELECT c.title, count(*) AS n_questions FROM {QUESTIONS} q JOIN chapters c ON q.chapter_id = c.id GROUP BY c.title")
def _(s, d):
    chapters = table(s, d, "chapters").select(F.col("id").alias("chapter_id"), "title")
    return _questions(s, d).select("chapter_id").join(chapters, "chapter_id").groupBy("title").agg(F.count("*").alias("n_questions"))


@query("tasks_with_titles", f"SELECT t.id, b.title AS book_title FROM {TASKS} t LEFT JOIN books b ON t.book_id = b.id")
def _(s, d):
    return tasks.with_titles(_tasks(s, d), table(s, d, "books")).select("id", "book_title")


@query("known_books", "SELECT id FROM books b WHERE is_active = false AND EXISTS (SELECT 1 FROM books o WHERE o.is_active AND o.title = b.title AND o.author = b.author)")
def _(s, d):
    books = table(s, d, "books")
    return dml.insert_new(books.filter("is_active").select("title", "author"), books.filter("NOT is_active").select("id", "title", "author"), ["title", "author"])[1].select("id")


@query("nested_books", "SELECT b.id AS book_id, b.title, coalesce(string_agg(c.id, ',' ORDER BY c.chapter_number, c.id), '') AS chapter_ids FROM books b LEFT JOIN chapters c ON c.book_id = b.id GROUP BY b.id, b.title")
def _(s, d):
    return library.nested_books(table(s, d, "books"), table(s, d, "chapters")).withColumn("chapter_ids", F.array_join("chapter_ids", ","))


@query("task_fanout", """
    SELECT c.book_id, c.id AS chapter_id, g.grade_level, n.question_number, CASE WHEN n.question_number = 1 THEN 8 ELSE 0 END AS vocab_count, 1 AS num_questions, 3 AS priority,
      '{"grade_level":"' || g.grade_level || '","num_questions":1,"question_number":' || n.question_number || '}' AS payload
    FROM chapters c JOIN (SELECT id, unnest(CASE WHEN len(list_filter(coalesce(tags, []), lambda t: starts_with(t, 'grade-'))) > 0 THEN list_filter(tags, lambda t: starts_with(t, 'grade-')) ELSE [reading_level] END) AS grade_level FROM books) g ON g.id = c.book_id,
      (SELECT unnest([1, 2, 3]) AS question_number) n WHERE g.grade_level IS NOT NULL""")
def _(s, d):
    return tasks.fan_out(table(s, d, "chapters"), table(s, d, "books")).filter("grade_level IS NOT NULL")


@query("status_counts", f"SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'error') AS error FROM {TASKS}")
def _(s, d):
    return tasks.status_counts(_tasks(s, d))


@query("ready_tasks", f"SELECT count(*) AS n FROM {TASKS} WHERE status = 'ready' AND task_type = 'questions'")
def _(s, d):
    return _tasks(s, d).filter("status = 'ready' AND task_type = 'questions'").agg(F.count("*").alias("n"))


@query("distinct_grades", f"SELECT DISTINCT json_extract_string(payload, '$.grade_level') AS grade FROM {TASKS} WHERE json_extract_string(payload, '$.grade_level') IS NOT NULL ORDER BY 1")
def _(s, d):
    return table(s, d, "queue_tasks").select(tasks.payload(tasks.GRADE).alias("grade")).filter("grade IS NOT NULL").distinct().orderBy("grade")


@query("book_totals", "SELECT book_id, count(*) AS n_chapters, sum(coalesce(word_count, 0)) AS n_words, sum(coalesce(estimated_reading_time_minutes, 0)) AS minutes FROM chapters GROUP BY book_id")
def _(s, d):
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table(s, d, "chapters").groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum(zero("word_count")).alias("n_words"), F.sum(zero("estimated_reading_time_minutes")).alias("minutes"))


@query("batch_outcomes", f"SELECT task_type, count(*) FILTER (status = 'ready') AS n_done, count(*) FILTER (status = 'error') AS n_failed FROM {TASKS} GROUP BY task_type")
def _(s, d):
    return _tasks(s, d).groupBy("task_type").agg(F.count_if(F.col("status") == "ready").alias("n_done"), F.count_if(F.col("status") == "error").alias("n_failed"))


@query("questions_by_difficulty", f"SELECT coalesce(lower(difficulty_level), 'unspecified') AS difficulty, count(*) AS n FROM {QUESTIONS} GROUP BY 1")
def _(s, d):
    return _questions(s, d).groupBy(F.coalesce(F.lower("difficulty_level"), F.lit("unspecified")).alias("difficulty")).agg(F.count("*").alias("n"))


@query("unique_grade_tags", "SELECT DISTINCT grade FROM (SELECT unnest(tags) AS grade FROM books) WHERE starts_with(grade, 'grade-')")
def _(s, d):
    return library.unique_grades(table(s, d, "books"))


@query("vocabulary_of_books", "SELECT c.book_id, count(*) AS n_entries, count(DISTINCT v.word) AS n_words FROM (SELECT book_id, unnest(vocabulary_words) AS v FROM chapters) c GROUP BY c.book_id")
def _(s, d):
    rows = table(s, d, "chapters").select("book_id", F.explode("vocabulary_words").alias("v"))
    return rows.groupBy("book_id").agg(F.count("*").alias("n_entries"), F.count_distinct("v.word").alias("n_words"))


@query("vocabulary_by_grade", "SELECT coalesce(v.grade_level, 'unspecified') AS grade, count(*) AS n FROM (SELECT unnest(vocabulary_words) AS v FROM chapters) GROUP BY 1")
def _(s, d):
    return table(s, d, "chapters").select(F.explode("vocabulary_words").alias("v")).groupBy(F.coalesce("v.grade_level", F.lit("unspecified")).alias("grade")).agg(F.count("*").alias("n"))


# Order, windows, top-k ---------------------------------------------------------------------------------------------


@query("latest_books", "SELECT id, title FROM books WHERE is_active ORDER BY created_at DESC, id LIMIT 50")
def _(s, d):
    return table(s, d, "books").filter("is_active").orderBy(F.desc("created_at"), "id").limit(50).select("id", "title")


@query("active_tasks_topk", f"SELECT id, priority FROM {TASKS} WHERE status IN ('queued', 'processing') ORDER BY priority, created_at, id LIMIT 100")
def _(s, d):
    return _tasks(s, d).filter("status IN ('queued', 'processing')").orderBy("priority", "created_at", "id").limit(100).select("id", "priority")


@query("done_tasks_topk", f"SELECT id, priority FROM {TASKS} WHERE status = 'ready' ORDER BY priority, completed_at DESC NULLS FIRST, id LIMIT 100")
def _(s, d):
    return _tasks(s, d).filter("status = 'ready'").orderBy("priority", F.desc_nulls_first("completed_at"), "id").limit(100).select("id", "priority")


@query("dequeue_order", f"SELECT id, row_number() OVER (PARTITION BY task_type ORDER BY priority, created_at, id) AS place FROM {TASKS} WHERE status = 'queued'")
def _(s, d):
    return library.numbered(_tasks(s, d).filter("status = 'queued'"), "task_type", ["priority", "created_at", "id"], "place").select("id", "place")


@query("chapter_numbers", "SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, id) AS number FROM chapters")
def _(s, d):
    return library.numbered(table(s, d, "chapters").select("id", "book_id", "chapter_number"), "book_id", ["chapter_number", "id"]).select("id", "number")


@query("matter_flags", """
    SELECT id, pos, pos < total * 0.2 AS in_front, pos > total * 0.8 AS in_back,
      (pos < total * 0.2 AND regexp_matches(lower(title), 'contents|preface|foreword|introduction|prologue|dedication|acknowledgments|acknowledgements|about the author|note to reader'))
      OR (pos > total * 0.8 AND regexp_matches(lower(title), 'epilogue|afterword|appendix|notes|glossary|bibliography|index|about the author|acknowledgments|acknowledgements')) AS is_matter
    FROM (SELECT id, title, row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, id) - 1 AS pos, count(*) OVER (PARTITION BY book_id) AS total FROM chapters)""")
def _(s, d):
    return library.matter_flags(table(s, d, "chapters"))


@query("highlight_colours", "SELECT id, (row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, id) - 1) % 5 AS colour FROM chapters")
def _(s, d):
    return library.colours(table(s, d, "chapters"))


@query("latest_task_per_book", f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY book_id, task_type ORDER BY created_at DESC, id DESC) AS r FROM {TASKS} WHERE chapter_id IS NULL) WHERE r = 1")
def _(s, d):
    return tasks.latest_by_book(_tasks(s, d)).select("id")


@query("first_questions", f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY chapter_id ORDER BY order_index, id) AS r FROM {QUESTIONS}) WHERE r <= 3")
def _(s, d):
    return library.first_of(_questions(s, d).select("id", "chapter_id", "order_index"), "chapter_id", ["order_index", "id"], 3).select("id")


@query("vocabulary_by_length", "SELECT id, array_to_string(list_transform(list_sort(list_transform(range(1, len(vocabulary_words) + 1), lambda i: {'n': -length(vocabulary_words[i].word), 'i': i})), lambda x: vocabulary_words[x.i].word), ',') AS words FROM chapters WHERE len(vocabulary_words) > 0")
def _(s, d):
    rows = table(s, d, "chapters").filter("size(vocabulary_words) > 0")
    return rows.select("id", F.array_join(F.transform(annotate.by_length(F.col("vocabulary_words")), lambda v: v["word"]), ",").alias("words"))


# Changes -----------------------------------------------------------------------------------------------------------


@query("cascade_delete", f"""
    WITH c AS (SELECT id FROM chapters WHERE book_id NOT IN (SELECT id FROM books WHERE NOT is_active))
    SELECT 'chapters' AS tab, count(*) AS n FROM c UNION ALL SELECT 'questions', count(*) FROM {QUESTIONS} q WHERE q.chapter_id IS NULL OR q.chapter_id NOT IN (SELECT id FROM chapters WHERE id NOT IN (SELECT id FROM c))""")
def _(s, d):
    doomed = table(s, d, "books").filter("NOT is_active").select("id")
    c, q = dml.delete_cascade(doomed, [(table(s, d, "chapters").select("id", "book_id"), "book_id", "id"), (_questions(s, d).select("id", "chapter_id"), "chapter_id", "id")])
    return c.agg(F.count("*").alias("n")).select(F.lit("chapters").alias("tab"), "n").unionByName(q.agg(F.count("*").alias("n")).select(F.lit("questions").alias("tab"), "n"))


@query("upsert_chapters", """
    SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY book_id, chapter_number ORDER BY s DESC, created_at DESC, id DESC) AS r FROM
      (SELECT id, title, book_id, chapter_number, created_at, 0 AS s FROM chapters UNION ALL SELECT id || '-new', title || ' (new)', book_id, chapter_number, created_at, 1 FROM chapters WHERE chapter_number = 2)) WHERE r = 1""")
def _(s, d):
    old = table(s, d, "chapters").select("id", "title", "book_id", "chapter_number", "created_at")
    new = old.filter("chapter_number = 2").withColumns({"id": F.concat("id", F.lit("-new")), "title": F.concat("title", F.lit(" (new)"))})
    return dml.upsert(old, new, ["book_id", "chapter_number"], "created_at").select("id", "title")


@query("overlay_levels", "SELECT b.id, coalesce(c.reading_level, b.reading_level) AS reading_level FROM books b LEFT JOIN (SELECT id, lower(trim(reading_level)) AS reading_level FROM books WHERE is_active) c ON b.id = c.id")
def _(s, d):
    books = table(s, d, "books")
    changes = books.filter("is_active").select("id", F.lower(F.trim("reading_level")).alias("reading_level"))
    return dml.overlay(books.select("id", "reading_level"), changes, "id", ["reading_level"])


@query("append_order_index", f"""
    SELECT q.id, coalesce(m.m, 0) + row_number() OVER (PARTITION BY q.chapter_id ORDER BY q.created_at, q.id) AS order_index
    FROM {QUESTIONS} q LEFT JOIN (SELECT chapter_id, max(order_index) AS m FROM questions GROUP BY chapter_id) m ON m.chapter_id = q.chapter_id WHERE q.question_type = 'inference'""")
def _(s, d):
    q = _questions(s, d).select("id", "chapter_id", "order_index", "created_at", "question_type")
    return dml.append_ordered(q, q.filter("question_type = 'inference'"), "chapter_id", ["created_at", "id"]).select("id", "order_index")


@query("replace_groups", f"SELECT id FROM {QUESTIONS} WHERE question_type = 'inference' OR chapter_id IS NULL OR chapter_id NOT IN (SELECT chapter_id FROM questions WHERE question_type = 'inference' AND chapter_id IS NOT NULL)")
def _(s, d):
    q = _questions(s, d).select("id", "chapter_id", "question_type")
    return dml.replace_groups(q, q.filter("question_type = 'inference'"), ["chapter_id"]).select("id")


@query("delete_chapters", f"""
    WITH gone AS (SELECT id FROM chapters WHERE {STRIP.format("coalesce(content, '')")} = '')
    SELECT 'kept' AS tab, count(*) AS n FROM chapters WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'removed', count(*) FROM gone
    UNION ALL SELECT 'tasks', count(*) FROM {TASKS} WHERE NOT (status = 'queued' AND coalesce(chapter_id, '') IN (SELECT id FROM gone))""")
def _(s, d):
    chapters = table(s, d, "chapters").select("id", "content")
    kept, removed, left = dml.deleted_with(chapters, chapters.filter(T.strip(F.coalesce("content", F.lit(""))) == ""), _tasks(s, d))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
    return one(kept, "kept").unionByName(one(removed, "removed")).unionByName(one(left, "tasks"))


@query("published_books", f"""
    SELECT sha256('book:' || b.id) AS published_id, b.id AS draft_id, b.title, coalesce(c.n, 0) AS total_chapters, coalesce(c.w, 0) AS word_count, CAST(floor(coalesce(c.w, 0) / 200) AS INT) AS minutes
    FROM books b LEFT JOIN (SELECT book_id, count(*) AS n, sum(len({WORDS.format("coalesce(content, '')")})) AS w FROM chapters GROUP BY book_id) c ON c.book_id = b.id""")
def _(s, d):
    return dml.published(table(s, d, "books"), table(s, d, "chapters"))


_KEYED = f"(SELECT *, coalesce(json_extract_string(payload, '$.grade_level'), '') AS g, coalesce(json_extract_string(payload, '$.question_number'), '') AS qn, coalesce(chapter_id, '') AS c FROM {TASKS})"


def _enqueue_sql(number: bool) -> str:
    more = ", qn" * number
    return f"""
    SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY task_type, book_id, c, g{more} ORDER BY created_at, id) AS r FROM {_KEYED} WHERE status = 'error') n WHERE r = 1
      AND NOT EXISTS (SELECT 1 FROM {_KEYED} o WHERE o.status IN ('queued', 'processing') AND o.task_type = n.task_type AND o.book_id = n.book_id AND o.c = n.c AND o.g = n.g{' AND o.qn = n.qn' * number})"""


@query("enqueue_dedup_strict", _enqueue_sql(False))
def _(s, d):
    t = _tasks(s, d)
    return tasks.enqueue(t, t.filter("status = 'error'")).select("id")


@query("enqueue_dedup", _enqueue_sql(True))
def _(s, d):
    t = _tasks(s, d)
    return tasks.enqueue(t, t.filter("status = 'error'"), with_number=True).select("id")


@query("clear_completed", f"SELECT id FROM {TASKS} WHERE status NOT IN ('ready', 'error')")
def _(s, d):
    return _tasks(s, d).filter("status NOT IN ('ready', 'error')").select("id")


@query("watchdog", f"SELECT id, CASE WHEN status = 'processing' AND timeout_at < TIMESTAMP '{NOW}' THEN 'error' ELSE status END AS status FROM {TASKS}")
def _(s, d):
    return tasks.timed_out(_tasks(s, d), F.lit(NOW).cast("timestamp_ntz")).select("id", "status")


@query("selective_deletion", f"SELECT id FROM {TASKS} WHERE NOT (task_type = 'tags')")
def _(s, d):
    none = F.lit(None).cast("string")
    return _tasks(s, d).filter(~tasks.selected_for_deletion(none, none, F.lit("tags"))).select("id")


@query("chapter_states", f"""
    SELECT chapter_id, CASE max(CASE status WHEN 'processing' THEN 3 WHEN 'queued' THEN 2 WHEN 'error' THEN 1 ELSE 0 END) WHEN 3 THEN 'processing' WHEN 2 THEN 'queued' WHEN 1 THEN 'error' ELSE 'ready' END AS state,
      count(*) FILTER (status = 'ready') AS n_ready FROM {TASKS} WHERE chapter_id IS NOT NULL GROUP BY chapter_id""")
def _(s, d):
    return tasks.chapter_states(_tasks(s, d))


@query("task_durations", f"""
    SELECT id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s IS NOT NULL THEN s || 's' END AS duration,
      CASE priority WHEN 1 THEN 'High' WHEN 2 THEN 'Med' WHEN 3 THEN 'Low' ELSE '?' END AS label
    FROM (SELECT id, priority, date_sub('second', coalesce(locked_at, created_at), completed_at) AS s FROM {TASKS})""")
def _(s, d):
    return _tasks(s, d).select("id", T.task_duration(F.coalesce("locked_at", "created_at"), F.col("completed_at")).alias("duration"), T.priority_label(F.col("priority")).alias("label"))


@query("grade_diff", f"""
    SELECT b.id AS book_id, array_to_string(list_sort(list_filter(o.grades, lambda g: NOT list_contains(n.grades, g))), ',') AS removed, array_to_string(list_sort(list_filter(n.grades, lambda g: NOT list_contains(o.grades, g))), ',') AS added
    FROM books b JOIN (SELECT book_id, list(DISTINCT json_extract_string(payload, '$.grade_level')) FILTER (json_extract_string(payload, '$.grade_level') IS NOT NULL) AS grades FROM {TASKS} GROUP BY book_id) o ON o.book_id = b.id,
      LATERAL (SELECT list_filter(coalesce(b.tags, []), lambda t: starts_with(t, 'grade-')) AS grades) n WHERE o.grades IS NOT NULL""")
def _(s, d):
    old = _tasks(s, d).groupBy("book_id").agg(F.collect_set(tasks.payload(tasks.GRADE)).alias("old")).filter("size(old) > 0")
    rows = table(s, d, "books").select(F.col("id").alias("book_id"), F.coalesce(T.grade_tags(F.col("tags")), F.array().cast("array<string>")).alias("new")).join(old, "book_id")
    change = tasks.grade_changes(F.col("old"), F.col("new"))
    return rows.select("book_id", F.array_join(change["removed"], ",").alias("removed"), F.array_join(change["added"], ",").alias("added"))


# Paragraphs, pages, sections ---------------------------------------------------------------------------------------


@query("para_split", f"SELECT id, len(p) AS n_paragraphs, list_sum(list_transform(p, lambda x: length(x))) AS n_chars FROM (SELECT id, {PARAS.format('content')} AS p FROM chapters WHERE content IS NOT NULL) WHERE len(p) > 0")
def _(s, d):
    rows = table(s, d, "chapters").filter("content IS NOT NULL").select("id", T.paragraphs(F.col("content")).alias("p")).filter("size(p) > 0")
    return rows.select("id", F.size("p").alias("n_paragraphs"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("fixed_pages", f"""
    SELECT id, i + 1 AS page, array_to_string(w[i * 250 + 1 : (i + 1) * 250], ' ') AS text FROM (SELECT id, w, unnest(range(0, (len(w) + 249) // 250)) AS i FROM (SELECT id, {WORDS.format('content')} AS w FROM chapters WHERE content IS NOT NULL))""")
def _(s, d):
    rows = table(s, d, "chapters").filter("content IS NOT NULL").select("id", F.posexplode(segment.fixed_pages(F.col("content"))).alias("i", "text"))
    return rows.select("id", (F.col("i") + 1).alias("page"), "text")


@query("para_features", rf"""
    SELECT type, count(*) AS n, count(*) FILTER (regexp_matches(p, '["'']$|["''][.,!?]$')) AS n_end_dialogue FROM (
      SELECT p, CASE WHEN regexp_matches(p, '^["'']') THEN 'dialogue' WHEN regexp_matches(p, '\n\s*\*\s*\*\s*\*\s*\n|\n\s*---+\s*\n|\n\s*•\s*•\s*•\s*\n|\n\s*～+\s*\n') THEN 'scene_break' WHEN regexp_matches(p, '{HEADING}') THEN 'heading' ELSE 'narrative' END AS type
      FROM (SELECT unnest({PARAS.format('content')}) AS p FROM chapters WHERE content IS NOT NULL)) GROUP BY type""")
def _(s, d):
    rows = table(s, d, "chapters").filter("content IS NOT NULL").select(F.explode(T.paragraphs(F.col("content"))).alias("p"))
    return rows.groupBy(T.paragraph_type(F.col("p")).alias("type")).agg(F.count("*").alias("n"), F.count_if(T.ends_dialogue(F.col("p"))).alias("n_end_dialogue"))


@query("description_extract", f"""
    SELECT id, CASE WHEN d IS NULL THEN 'No description available.' WHEN length(d) > 500 THEN regexp_replace(d[1:500], '(?s) [^ ]*$', '') || '...' ELSE d END AS description
    FROM (SELECT id, list_filter(p[1:3], lambda x: length(x) >= 50)[1] AS d FROM (SELECT id, {PARAS.format('content')} AS p FROM chapters WHERE content IS NOT NULL))""")
def _(s, d):
    return table(s, d, "chapters").filter("content IS NOT NULL").select("id", T.description(F.col("content"), r"\n\n+").alias("description"))


_FIRST = r"regexp_split_to_array({0}[1:500], '[.!?]+[\s\x{A0}]+')[1]"
_TELLING = _Sql(f"list_filter({WORDS.format('{0}')}, lambda w: length(w) > 4 AND lower(w) NOT IN ('there', 'their', 'which', 'where', 'these', 'those', 'would', 'could', 'should', 'about', 'after', 'before'))")
_TITLE = _Sql(rf"CASE WHEN regexp_matches(line, '^(CHAPTER|Chapter|PART|Part)\s+') THEN line WHEN length(first) > 20 AND len({_TELLING.format('first')}) >= 2 THEN 'Section ' || {{0}} || ': ' || array_to_string({_TELLING.format('first')}[1:3], ' ') ELSE 'Section ' || {{0}} END")
BREAKS = r"\n\s*\*\s*\*\s*\*\s*\n|\n\s*---+\s*\n|\n\s*•\s*•\s*•\s*\n|\n\s*～+\s*\n"
_LEAST, _MOST = level_target("beginner")


@query("section_fold", rf"""
    WITH RECURSIVE docs AS (SELECT id, {PARAS.format('content')} AS p FROM chapters WHERE content IS NOT NULL),
    feats AS (SELECT id, i, t, len({WORDS.format('t')}) AS wc, regexp_matches(t, '^["'']') AS starts, regexp_matches(t, '["''][.,!?]?$') AS ends, regexp_matches(t, '{BREAKS}') AS broken, regexp_matches(t, '{HEADING}') AS head
      FROM (SELECT id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM docs)),
    kinds AS (SELECT *, CASE WHEN starts THEN 'dialogue' WHEN broken THEN 'scene_break' WHEN head THEN 'heading' ELSE 'narrative' END AS kind FROM feats),
    fold(id, i, n, words, talk, sec, used) AS (
      SELECT id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(1 AS BIGINT), false FROM docs
      UNION ALL
      SELECT id, i, CASE WHEN skip THEN n WHEN split THEN 1 ELSE n + 1 END, CASE WHEN skip THEN words WHEN split THEN wc ELSE words + wc END,
        CASE WHEN skip THEN talk WHEN starts THEN true WHEN ends THEN false ELSE talk END, CASE WHEN NOT skip AND split THEN sec + 1 ELSE sec END, NOT skip
      FROM (SELECT k.id, k.i, f.n, f.words, f.talk, f.sec, k.wc, k.starts, k.ends, (k.wc < 5 AND k.kind = 'heading' AND f.n = 0) AS skip,
          (f.words >= {_LEAST} AND NOT (f.talk AND NOT k.ends) AND f.n > 0 AND (k.broken OR k.kind = 'heading' OR (f.words >= {_MOST} AND ((k.kind = 'narrative' AND NOT f.talk) OR k.ends)))) AS split
        FROM fold f JOIN kinds k ON k.id = f.id AND k.i = f.i + 1)),
    secs AS (SELECT f.id, f.sec, string_agg(k.t, chr(10) || chr(10) ORDER BY k.i) AS content, sum(k.wc) AS word_count, count(*) AS paragraph_count FROM fold f JOIN kinds k ON k.id = f.id AND k.i = f.i WHERE f.used GROUP BY f.id, f.sec HAVING sum(k.wc) >= 200),
    named AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sec) AS number, {STRIP.format("string_split(content, chr(10))[1]")} AS line, {_FIRST.replace('{0}', 'content')} AS first FROM secs)
    SELECT id, number, content, word_count, paragraph_count, {_TITLE.format('number')} AS title FROM named""")
def _(s, d):
    return segment.sections(table(s, d, "chapters").filter("content IS NOT NULL"), "id", "content", "beginner")


@query("greedy_pages", f"""
    WITH RECURSIVE docs AS (SELECT id, content, {PARAS.format('content')} AS p FROM chapters WHERE content IS NOT NULL),
    sized AS (SELECT id, p, list_transform(p, lambda t: len({WORDS.format('t')})) AS n FROM docs WHERE len(p) > 0),
    fold(id, i, words, page) AS (
      SELECT id, CAST(1 AS BIGINT), n[1], CAST(1 AS BIGINT) FROM sized
      UNION ALL SELECT f.id, f.i + 1, CASE WHEN f.words + s.n[f.i + 1] > 500 THEN s.n[f.i + 1] ELSE f.words + s.n[f.i + 1] END, CASE WHEN f.words + s.n[f.i + 1] > 500 THEN f.page + 1 ELSE f.page END FROM fold f JOIN sized s ON s.id = f.id WHERE f.i < len(s.n))
    SELECT f.id, f.page, string_agg(s.p[f.i], chr(10) || chr(10) ORDER BY f.i) AS text FROM fold f JOIN sized s ON s.id = f.id GROUP BY f.id, f.page
    UNION ALL SELECT id, 1, content FROM docs WHERE len(p) = 0""")
def _(s, d):
    rows = table(s, d, "chapters").filter("content IS NOT NULL").select("id", F.posexplode(segment.greedy_pages(F.col("content"))).alias("i", "text"))
    return rows.select("id", (F.col("i") + 1).alias("page"), "text")


@query("page_routing", f"""
    WITH pages AS (SELECT id, i + 1 AS page, array_to_string(w[i * 250 + 1 : (i + 1) * 250], ' ') AS text FROM (SELECT id, w, unnest(range(0, (len(w) + 249) // 250)) AS i FROM (SELECT id, {WORDS.format('content')} AS w FROM chapters WHERE content IS NOT NULL))),
    kinds AS (SELECT *, CASE WHEN page IN (2, 3, 6) THEN 'metadata' ELSE 'content' END AS kind FROM pages WHERE page <> 1),
    runs AS (SELECT *, CASE WHEN kind = 'metadata' THEN sum(CASE WHEN kind = 'content' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY page) ELSE -1 END AS run FROM kinds)
    SELECT id, kind, min(page) AS first_page, max(page) AS last_page, length(string_agg(text, '\n\n' ORDER BY page)) - (count(*) - 1) * (length('\n\n') - 2) AS n_chars FROM runs GROUP BY id, kind, run""")
def _(s, d):
    pages = table(s, d, "chapters").filter("content IS NOT NULL").select("id", F.posexplode(segment.fixed_pages(F.col("content"))).alias("i", "text")).select("id", (F.col("i") + 1).alias("page"), "text")
    out = segment.route_pages(pages, "id", F.col("page") == 1, F.col("page").isin(2, 3, 6))
    return out.select("id", "kind", "first_page", "last_page", F.length("content").alias("n_chars"))


# Cleaning ----------------------------------------------------------------------------------------------------------

_LICENSE = "(?i)" + "|".join(f"(?:{p})" for p in clean.LICENSE_LINES)


@query("license_skip", f"""
    SELECT doc_id, count(*) AS n_kept FROM (
      SELECT doc_id, max(CASE WHEN regexp_matches(line, '{_LICENSE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY i) AS bad FROM (
        SELECT doc_id, i, line, coalesce(sum(CASE WHEN {STRIP.format('line')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM (
          SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))) WHERE bad = 0 GROUP BY doc_id""")
def _(s, d):
    lines = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(F.split(clean.without_licenses(F.col("text")), "\n", -1)).alias("n_kept"))
    return lines


def _without(text: str, markers: list[str], pattern: str, rest: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, '(?is){m}') THEN regexp_replace(regexp_replace({text}, '{pattern.replace('MARK', m)}', ''), '{rest}', '')" for m in markers)
    return f"CASE {cases} ELSE {text} END"


def _clean_sql(source: str) -> str:
    """SQL of the cleaned text: header, footer, licence lines, white space, in this order."""
    squeezed = "string_split(regexp_replace(regexp_replace(kept, ' +', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(10))"
    return f"""
    WITH src AS ({source}),
    head AS (SELECT doc_id, text, {_without('text', clean.START_MARKERS, '(?is)^.*?MARK', '^' + chr(92) + 'n+')} AS t FROM src),
    foot AS (SELECT doc_id, text, {_without('t', clean.END_MARKERS, '(?is)MARK.*$', chr(92) + 'n+$')} AS t FROM head),
    lines AS (SELECT doc_id, i, line, coalesce(sum(CASE WHEN {STRIP.format('line')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block
      FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM foot))),
    marked AS (SELECT *, max(CASE WHEN regexp_matches(line, '{_LICENSE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY i) AS bad FROM lines),
    kept AS (SELECT f.doc_id, any_value(f.text) AS text, coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (m.bad = 0), '') AS kept FROM foot f JOIN marked m ON m.doc_id = f.doc_id GROUP BY f.doc_id),
    done AS (SELECT doc_id, text, {STRIP.format("array_to_string(list_transform(" + squeezed + ", lambda l: " + STRIP.format('l') + "), chr(10))")} AS t FROM kept)
    SELECT doc_id, len({WORDS.format('text')}) AS original_words, len({WORDS.format('t')}) AS cleaned_words, len({WORDS.format('text')}) - len({WORDS.format('t')}) AS removed_words, len({WORDS.format('t')}) < len({WORDS.format('text')}) * 0.1 AS excessive, md5(t) AS digest FROM done"""


def _cleaned(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", clean.cleaning_stats(F.col("text")).alias("c")).select("doc_id", "c.original_words", "c.cleaned_words", "c.removed_words", "c.excessive", F.md5("c.text").alias("digest"))


@query("clean_stats", _clean_sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL"))
def _(s, d):
    return _cleaned(table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))


#: What stands around a text of a public-domain library.
_BEFORE, _AFTER = "The title\n\n*** START OF THE PROJECT GUTENBERG EBOOK A TITLE ***\n\n", "\n\nwww.gutenberg.org and more\nof it\n\n*** END OF THIS PROJECT GUTENBERG EBOOK A TITLE ***\n\nThe licence"


@query("clean_marked", _clean_sql(f"SELECT doc_id, {_BEFORE!r} || text || {_AFTER!r} AS text FROM documents WHERE text IS NOT NULL".replace("'" + _BEFORE.replace(chr(10), chr(92) + "n") + "'", "'" + _BEFORE + "'").replace("'" + _AFTER.replace(chr(10), chr(92) + "n") + "'", "'" + _AFTER + "'")))
def _(s, d):
    """Every text with a header, a licence line and a footer around it."""
    return _cleaned(table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.concat(F.lit(_BEFORE), "text", F.lit(_AFTER)).alias("text")))


@query("whitespace_normalized", f"""
    SELECT doc_id, md5({STRIP.format("array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda l: " + STRIP.format('l') + "), chr(10))")}) AS digest FROM documents WHERE text IS NOT NULL""".replace("{3,}", "{3,}"))
def _(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(clean.normalized(F.col("text"))).alias("digest"))


# Matching ----------------------------------------------------------------------------------------------------------


def _documents(s, d):
    return table(s, d, "chapters").filter("content IS NOT NULL").select(F.col("id").alias("k"), T.paragraphs(F.col("content")).alias("p"))


_PLAIN = _Sql(rf"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({{0}}, 'data:image/[^;]+;base64,[A-Za-z0-9+/=]+', '', 'g'), '<[^>]+>', ' ', 'g')), '{WS}+', ' ', 'g'), '[^a-zA-Z0-9_ ]', '', 'g'))")


@query("passage_match", f"""
    WITH c AS (SELECT id, {PARAS.format('content')} AS p FROM chapters WHERE content IS NOT NULL),
    paras AS (SELECT id, i - 1 AS idx, {_PLAIN.format('t')} AS t FROM (SELECT id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM c)),
    asked AS (SELECT id, array_to_string(w[1:50], ' ')[1:100] AS pattern, len(w) AS n FROM (SELECT id, t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM paras WHERE idx = 2) WHERE length(t) >= 10),
    hit AS (SELECT a.id, a.n, min(b.idx) AS at FROM asked a JOIN paras b ON a.id = b.id WHERE contains(b.t, a.pattern) GROUP BY a.id, a.n),
    ends AS (SELECT id, max(idx) AS last FROM paras GROUP BY id)
    SELECT h.id, unnest(range(h.at, least(h.at + greatest(CAST(ceil(h.n / 100.0) AS BIGINT), 1) - 1, e.last) + 1)) AS idx FROM hit h JOIN ends e ON h.id = e.id""")
def _(s, d):
    documents = _documents(s, d)
    return match.passages(documents.filter("size(p) > 2").select("k", F.col("k").alias("id"), F.get("p", F.lit(2)).alias("text")), documents, "k")


@query("highlight_map", f"""
    WITH c AS (SELECT id, {PARAS.format('content')} AS p FROM chapters WHERE content IS NOT NULL),
    paras AS (SELECT id, i - 1 AS idx, {_PLAIN.format('t')} AS t FROM (SELECT id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM c)),
    asked AS (SELECT id, idx AS place, array_to_string(w[1:50], ' ')[1:100] AS pattern, len(w) AS n FROM (SELECT id, idx, t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM paras WHERE idx IN (1, 2, 3)) WHERE length(t) >= 10),
    hit AS (SELECT a.id, a.place, a.n, min(b.idx) AS at FROM asked a JOIN paras b ON a.id = b.id WHERE contains(b.t, a.pattern) GROUP BY a.id, a.place, a.n),
    ends AS (SELECT id, max(idx) AS last FROM paras GROUP BY id),
    claims AS (SELECT h.id, h.place, unnest(range(h.at, least(h.at + greatest(CAST(ceil(h.n / 20.0) AS BIGINT), 1) - 1, e.last) + 1)) AS idx FROM hit h JOIN ends e ON h.id = e.id)
    SELECT id AS key, idx, max(place) AS place FROM claims GROUP BY id, idx""")
def _(s, d):
    """Three excerpts a chapter claim paragraphs, a paragraph for each twenty words; the last one owns what several claim."""
    documents = _documents(s, d)
    asked = documents.select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.get("p", F.lit(i)).alias("text")) for i in (1, 2, 3)])).alias("e")).select("k", F.concat_ws("#", "k", "e.i").alias("id"), F.col("e.text").alias("text")).filter("text IS NOT NULL")
    found = match.passages(asked, documents, "k", words_each=20).withColumns({"key": F.substring_index("id", "#", 1), "place": F.substring_index("id", "#", -1).cast("int")})
    return match.last_writer(found, "place").select("key", "idx", F.substring_index("id", "#", -1).cast("int").alias("place"))


@query("lev_similarity", "SELECT a.id AS id_a, b.id AS id_b, levenshtein(regexp_replace(a.title, '[^ -~]', '?', 'g'), regexp_replace(b.title, '[^ -~]', '?', 'g')) AS edits FROM books a JOIN books b ON a.author = b.author AND a.id < b.id WHERE a.title IS NOT NULL AND b.title IS NOT NULL")
def _(s, d):
    books = table(s, d, "books").filter("title IS NOT NULL").select("id", "author", F.regexp_replace("title", "[^ -~]", "?").alias("title"))
    a, b = books.alias("a"), books.alias("b")
    rows = a.join(b, (F.col("a.author") == F.col("b.author")) & (F.col("a.id") < F.col("b.id")))
    return rows.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.levenshtein("a.title", "b.title").alias("edits"))


@query("fuzzy_titles")
def _(s, d):
    books = table(s, d, "books").filter("title IS NOT NULL AND author IS NOT NULL")
    left = books.select("author", "id", F.col("created_at").cast("string").alias("pos"), F.col("title").alias("text"))
    return match.claimed(left, books.select("author", F.col("id").alias("idx"), F.col("title").alias("text")), "author")


# Markup and generated answers --------------------------------------------------------------------------------------


@query("escaped_descriptions", "SELECT id, replace(replace(replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM books WHERE description IS NOT NULL")
def _(s, d):
    return table(s, d, "books").filter("description IS NOT NULL").select("id", T.escape_html(F.col("description")).alias("html"))


@query("html_text", rf"""
    SELECT id, {STRIP.format("regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '" + WS + "+', ' ', 'g')")} AS text
    FROM chapters WHERE content LIKE '%<%'""")
def _(s, d):
    return table(s, d, "chapters").filter("content LIKE '%<%'").select("id", T.plain_text(F.col("content")).alias("text"))


@query("chapter_html", f"""
    SELECT c.id, '<div class="chapter-content" style="font-size: ' || CASE lower(trim(b.reading_level)) WHEN 'beginner' THEN '18px' WHEN 'advanced' THEN '15px' ELSE '16px' END || '; line-height: 1.8;">' ||
      array_to_string(list_transform(list_filter(string_split(c.content, chr(10) || chr(10)), lambda p: {STRIP.format('p')} <> ''), lambda p: '<p style="margin-bottom: 1.5em; text-indent: 2em;">' || p || '</p>'), '') || '</div>' AS html
    FROM chapters c LEFT JOIN books b ON b.id = c.book_id WHERE c.content IS NOT NULL""")
def _(s, d):
    books = table(s, d, "books").select(F.col("id").alias("book_id"), F.lower(F.trim("reading_level")).alias("level"))
    return table(s, d, "chapters").filter("content IS NOT NULL").select("id", "book_id", "content").join(books, "book_id", "left").select("id", T.chapter_html(F.col("content"), F.col("level")).alias("html"))


@query("annotate_abbr")
def _(s, d):
    return annotate.noted(table(s, d, "chapters").filter("content IS NOT NULL AND size(vocabulary_words) > 0"), "id", "content", "vocabulary_words")


@query("annotate_all")
def _(s, d):
    rows = table(s, d, "chapters").filter("content IS NOT NULL AND size(vocabulary_words) > 0")
    return rows.select("id", annotate.note_all(F.col("content"), F.col("vocabulary_words")).alias("html"))


@query("think_strip", "SELECT id, question_text AS answer FROM (SELECT id, " + STRIP.format("question_text") + f" AS question_text FROM {QUESTIONS} WHERE question_text IS NOT NULL)")
def _(s, d):
    wrapped = F.concat(F.lit("<think>why\nnot</think>\n"), F.col("question_text"), F.lit("<THOUGHT>x</THOUGHT>"))
    return _questions(s, d).filter("question_text IS NOT NULL").select("id", T.without_thinking(wrapped).alias("answer"))


@query("parse_questions", f"SELECT id, {STRIP.format('question_text')} AS text, coalesce(array_to_string(expected_keywords, ','), '') AS keywords, coalesce(difficulty_level, 'medium') AS difficulty FROM {QUESTIONS} WHERE {STRIP.format('question_text')} <> '' AND NOT regexp_matches(question_text, '[{{}}`]|<')")
def _(s, d):
    rows = _questions(s, d).filter(~F.col("question_text").rlike(r"[{}`]|<"))
    answer = F.concat(F.lit("Here you are:\n```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("question_text").alias("text"), F.col("expected_keywords").alias("keywords"), F.col("difficulty_level").alias("difficulty"))).alias("questions"))), F.lit("\n```"))
    parsed = rows.select("id", F.explode(generated.questions(answer, F.lit(3))).alias("q"))
    return parsed.select("id", "q.text", F.array_join("q.keywords", ",").alias("keywords"), "q.difficulty")


@query("stock_questions", "SELECT id, unnest([replace('Why do you think the events in ''{}'' happened the way they did?', '{}', title), replace('How did the characters in ''{}'' change or grow?', '{}', title)]) AS text FROM chapters WHERE title IS NOT NULL")
def _(s, d):
    return table(s, d, "chapters").filter("title IS NOT NULL").select("id", F.explode(generated.stock_questions(F.col("title"), F.lit(2))).alias("q")).select("id", "q.text")


@query("fallback_tags", """
    SELECT id, CASE lower(trim(reading_level)) WHEN 'beginner' THEN 'fiction,grade-K,grade-1,grade-2' WHEN 'early-reader' THEN 'fiction,grade-1,grade-2,grade-3' WHEN 'advanced' THEN 'fiction,grade-7,grade-8,grade-9'
      WHEN 'young-adult' THEN 'fiction,grade-10,grade-11,grade-12' ELSE 'fiction,grade-4,grade-5,grade-6' END AS tags FROM books""")
def _(s, d):
    return table(s, d, "books").select("id", F.array_join(T.fallback_tags(F.lower(F.trim("reading_level"))), ",").alias("tags"))


@query("age_to_grade", """
    SELECT id, g AS grade, CASE WHEN g <= 3 THEN '6-8' WHEN g <= 6 THEN '9-11' WHEN g <= 9 THEN '12-14' ELSE '15-17' END AS age FROM (
      SELECT id, CASE WHEN age_range LIKE '%6-8%' THEN 2 WHEN age_range LIKE '%9-11%' THEN 5 WHEN age_range LIKE '%12-14%' THEN 8 WHEN age_range LIKE '%15%' OR age_range LIKE '%16%' THEN 10 ELSE 5 END AS g FROM books)""")
def _(s, d):
    rows = table(s, d, "books").select("id", T.age_to_grade(F.col("age_range")).alias("grade"))
    return rows.withColumn("age", T.grade_to_age(F.col("grade")))


@query("tag_edit", "SELECT id, array_to_string(CASE WHEN list_contains(coalesce(tags, []), 'humor') THEN tags ELSE list_append(coalesce(tags, []), 'humor') END, ',') AS tags FROM books")
def _(s, d):
    return table(s, d, "books").select("id", F.array_join(T.with_tag(F.col("tags"), F.lit(" Humor ")), ",").alias("tags"))


@query("prompts", f"SELECT id, 'Read: ' || coalesce(title, '') || ' / ' || CASE WHEN len(w) > 200 THEN array_to_string(w[1:200], ' ') || '...' ELSE content END AS prompt FROM (SELECT id, title, content, {WORDS.format('content')} AS w FROM chapters WHERE content IS NOT NULL)")
def _(s, d):
    return table(s, d, "chapters").filter("content IS NOT NULL").select("id", generated.prompt("Read: {title} / {text}", {"title": F.col("title"), "text": generated.prompt_text(F.col("content"), 200)}).alias("prompt"))


@query("reading_benchmarks", "SELECT * FROM (VALUES ('1st', 80, 80), ('2nd', 80, 110), ('3rd', 110, 130), ('4th', 130, 150), ('5th', 150, 160), ('6th', 160, 175), ('7th', 175, 185), ('8th', 185, 200), ('9th', 200, 230), ('Adult', 238, 260)) t(grade, wpm_low, wpm_high)")
def _(s, d):
    #: Silent reading speeds by grade.
    rows = [("1st", 80, 80), ("2nd", 80, 110), ("3rd", 110, 130), ("4th", 130, 150), ("5th", 150, 160), ("6th", 160, 175), ("7th", 175, 185), ("8th", 185, 200), ("9th", 200, 230), ("Adult", 238, 260)]
    return s.createDataFrame(rows, "grade string, wpm_low int, wpm_high int")


@query("ordered_concat", "SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY part, chapter_number, id) AS place FROM (SELECT id, book_id, chapter_number, CASE WHEN chapter_number <= 1 THEN 0 WHEN chapter_number >= 5 THEN 2 ELSE 1 END AS part FROM chapters)")
def _(s, d):
    c = table(s, d, "chapters").select("id", "book_id", "chapter_number")
    parts = [c.filter("chapter_number <= 1"), c.filter("chapter_number > 1 AND chapter_number < 5"), c.filter("chapter_number >= 5")]
    joined = parts[0].withColumn("part", F.lit(0)).unionByName(parts[1].withColumn("part", F.lit(1))).unionByName(parts[2].withColumn("part", F.lit(2)))
    return library.numbered(joined, "book_id", ["part", "chapter_number", "id"], "place").select("id", "place")


@query("page_sets", "SELECT id, CASE WHEN chapter_number IN (1, 2, 9) THEN 'deleted' WHEN chapter_number IN (2, 3, 8) THEN 'metadata' ELSE 'content' END AS kind FROM chapters")
def _(s, d):
    deleted = F.array_union(F.array(F.lit(1), F.lit(2)), F.array(F.lit(9), F.lit(2)))
    metadata = F.array_union(F.array(F.lit(2), F.lit(3)), F.array(F.lit(8)))
    return table(s, d, "chapters").select("id", F.when(F.array_contains(deleted, F.col("chapter_number")), "deleted").when(F.array_contains(metadata, F.col("chapter_number")), "metadata").otherwise("content").alias("kind"))


@query("union_without_repeats", f"SELECT id FROM {TASKS} WHERE status = 'queued' UNION SELECT id FROM {TASKS} WHERE priority = 1")
def _(s, d):
    t = _tasks(s, d)
    first = t.filter("status = 'queued'").select("id")
    return first.unionByName(dml.insert_new(first, t.filter("priority = 1").select("id"), ["id"])[0])


@query("draft_conflicts", "SELECT id, EXISTS (SELECT 1 FROM books o WHERE NOT o.is_active AND o.isbn = b.isbn) AS rejected FROM books b WHERE is_active")
def _(s, d):
    books = table(s, d, "books")
    accepted, rejected = dml.insert_new(books.filter("NOT is_active").select("isbn"), books.filter("is_active").select("id", "isbn"), ["isbn"])
    return accepted.select("id", F.lit(False).alias("rejected")).unionByName(rejected.select("id", F.lit(True).alias("rejected")))


@query("json_defaults", f"SELECT id, coalesce(payload, '{{}}') AS payload, coalesce(attempts, 0) AS attempts FROM {TASKS}")
def _(s, d):
    return _tasks(s, d).select("id", F.coalesce("payload", F.lit("{}")).alias("payload"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query("grades_in_order", f"SELECT id, row_number() OVER (PARTITION BY book_id ORDER BY json_extract_string(payload, '$.grade_level') NULLS FIRST, created_at, id) AS place FROM {TASKS}")
def _(s, d):
    """Grades sort as texts: grade-10 before grade-2."""
    rows = _tasks(s, d).select("id", "book_id", tasks.payload(tasks.GRADE).alias("grade"), "created_at")
    return library.numbered(rows, "book_id", ["grade", "created_at", "id"], "place").select("id", "place")


@query("regenerated_chapters", f"""
    SELECT id FROM {TASKS} WHERE NOT (status = 'queued' AND coalesce(chapter_id, '') IN (SELECT id FROM chapters WHERE chapter_number = 1) AND coalesce(json_extract_string(payload, '$.grade_level'), '') IN ('grade-4', 'grade-5'))""")
def _(s, d):
    """What stays of the tasks when first chapters are made anew for two grades."""
    first = table(s, d, "chapters").filter("chapter_number = 1").select(F.col("id").alias("c"))
    t = _tasks(s, d)
    doomed = t.filter("status = 'queued'").filter(tasks.payload(tasks.GRADE).isin("grade-4", "grade-5")).join(first, F.col("chapter_id") == F.col("c"), "left_semi").select("id")
    return t.join(doomed, "id", "left_anti").select("id")


@query("grades_or_level", "SELECT id, array_to_string(CASE WHEN len(list_filter(coalesce(tags, []), lambda t: starts_with(t, 'grade-'))) > 0 THEN list_filter(tags, lambda t: starts_with(t, 'grade-')) ELSE [coalesce(reading_level, '?')] END, ',') AS grades FROM books")
def _(s, d):
    return table(s, d, "books").select("id", F.array_join(T.grades_or_level(F.col("tags"), F.coalesce("reading_level", F.lit("?"))), ",").alias("grades"))


@query("newest_states", "SELECT id, status FROM (SELECT id, status, row_number() OVER (PARTITION BY id ORDER BY coalesce(completed_at, started_at, created_at) DESC NULLS LAST, status DESC) AS r FROM queue_tasks) WHERE r = 1")
def _(s, d):
    return tasks.newest_state(table(s, d, "queue_tasks")).select("id", "status")


@query("assigned_tasks", f"SELECT id, 'processing' AS status, attempts + 1 AS attempts, TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE AS timeout_at FROM (SELECT * FROM {TASKS} WHERE status = 'queued' ORDER BY priority, created_at, id LIMIT 20)")
def _(s, d):
    return tasks.assigned(_tasks(s, d), F.lit(NOW).cast("timestamp_ntz"), 20).select("id", "status", "attempts", "timeout_at")


@query("joined_paragraphs", f"SELECT id, md5(array_to_string({PARAS.format('content')}, chr(10) || chr(10))) AS digest FROM chapters WHERE content IS NOT NULL")
def _(s, d):
    """Paragraphs as rows, numbered, and joined again in order."""
    rows = table(s, d, "chapters").filter("content IS NOT NULL").select("id", F.posexplode_outer(T.paragraphs(F.col("content"))).alias("i", "p"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("p", F.lit("")).alias("p")))), lambda x: x["p"])
    return rows.groupBy("id").agg(F.md5(F.array_join(ordered, "\n\n")).alias("digest"))


@query("section_titles", rf"""
    SELECT id, {_TITLE.format('chapter_number')} AS title
    FROM (SELECT id, chapter_number, {STRIP.format("string_split(content, chr(10))[1]")} AS line, {_FIRST.replace('{0}', 'content')} AS first FROM chapters WHERE content IS NOT NULL)""")
def _(s, d):
    return table(s, d, "chapters").filter("content IS NOT NULL").select("id", T.section_title(F.col("content"), F.col("chapter_number")).alias("title"))


@query("blurbs", """
    SELECT id, CASE WHEN length(t) >= 50 THEN t ELSE coalesce(title, '') || ' by ' || coalesce(author, '') || ' is a captivating children''s book that engages young readers with its compelling story and memorable characters.' END AS blurb
    FROM (SELECT id, title, author, CASE WHEN length(p) > 500 THEN regexp_replace(p[1:500], '(?s) [^ ]*$', '') || '...' ELSE p END AS t FROM (SELECT id, title, author, regexp_replace(regexp_replace(""" + STRIP.format("regexp_replace(description, chr(10) || '[ \t]*' || chr(10) || '+', chr(10) || chr(10), 'g')") + """, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS p FROM books WHERE description IS NOT NULL))""")
def _(s, d):
    zero = lambda c: F.coalesce(c, F.lit(""))
    return table(s, d, "books").filter("description IS NOT NULL").select("id", T.blurb(F.col("description"), zero("title"), zero("author")).alias("blurb"))


@query("page_fallbacks", "SELECT book_id, n, CASE WHEN n > 20 THEN '1,2,' || (n - 1) || ',' || n ELSE '1,2' END AS delete_pages, CASE WHEN n > 20 THEN n - 2 ELSE n END AS content_end_page FROM (SELECT book_id, CAST(count(*) AS INT) AS n FROM chapters GROUP BY book_id)")
def _(s, d):
    rows = table(s, d, "chapters").groupBy("book_id").agg(F.count("*").cast("int").alias("n"))
    return rows.select("book_id", "n", generated.page_fallback(F.col("n")).alias("f")).select("book_id", "n", F.array_join(F.transform("f.delete_pages", lambda p: p.cast("string")), ",").alias("delete_pages"), "f.content_end_page")


@query("recounted_words", f"SELECT id, CASE WHEN chapter_number = 1 AND content IS NOT NULL THEN len({WORDS.format("content || ' and more'")}) ELSE word_count END AS n_words FROM chapters WHERE word_count IS NOT NULL OR (chapter_number = 1 AND content IS NOT NULL)")
def _(s, d):
    chapters = table(s, d, "chapters").select("id", "chapter_number", "content", "word_count")
    changed = chapters.filter("chapter_number = 1 AND content IS NOT NULL").select("id", F.concat("content", F.lit(" and more")).alias("content"))
    return dml.recount_words(chapters, changed).filter("word_count IS NOT NULL").select("id", F.col("word_count").alias("n_words"))


@query("replaced_tasks", f"""
    SELECT id FROM {TASKS} t WHERE NOT (status = 'queued' AND EXISTS (SELECT 1 FROM {TASKS} n WHERE n.status = 'error' AND n.task_type = t.task_type AND n.book_id = t.book_id AND coalesce(n.chapter_id, '') = coalesce(t.chapter_id, '')))
    UNION ALL SELECT id || '-again' FROM {TASKS} WHERE status = 'error'""")
def _(s, d):
    t = _tasks(s, d)
    again = t.filter("status = 'error'").withColumns({"id": F.concat("id", F.lit("-again")), "status": F.lit("queued")})
    return tasks.replaced(t, again).select("id")


@query("generated_titles", rf"""
    SELECT id, CASE WHEN length(t) > 10 AND length(t) < 60 THEN t ELSE '-' END AS title FROM (SELECT id, array_to_string(({WORDS.format("regexp_replace(regexp_replace(regexp_replace(" + STRIP.format("title") + r", '^" + chr(34) + "+|" + chr(34) + "+$', '', 'g'), '^''+|''+$', '', 'g'), '(?i)^(chapter|section)\\s+\\d+\\s*:?\\s*', '')")})[1:6], ' ') AS t FROM chapters WHERE title IS NOT NULL)""")
def _(s, d):
    return table(s, d, "chapters").filter("title IS NOT NULL").select("id", T.generated_title(F.col("title"), F.lit("-")).alias("title"))


@query("stream_task_states", f"SELECT status, count(*) AS n FROM {TASKS} GROUP BY status")
def _(s, d):
    """The task file read as a stream, the latest state of each task kept by the engine, run to its end, then counted."""
    import os
    import uuid

    from quillmill.streaming import tasks as stream
    from quillmill.tables import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    base = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    path = f"{d}/queue_tasks.parquet"
    source = s.readStream.schema(s.read.parquet(path).schema).parquet(path if os.path.isdir(path) else f"{d}/queue_tasks.parque[t]")
    changes = source.select("id", "status", F.coalesce("completed_at", "started_at", "created_at").cast("timestamp").alias("at"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.apply_batches(changes, keep, f"{base}/state").awaitTermination()
    # A task may have changed in several batches; the engine's state saw all of them, so the last batch has its state.
    last = s.read.parquet(f"{base}/out").groupBy("id").agg(F.max_by("status", "batch").alias("status"))
    return last.groupBy("status").agg(F.count("*").alias("n"))
