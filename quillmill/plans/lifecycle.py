"""Queries on the life of a draft, with the SQL that says the same; they join the registry when this module is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import lifecycle, tasks
from quillmill.plans.queries import NOW, QUESTIONS, STRIP, TASKS, WORDS, query
from quillmill.tables import table

_GRADES = "list_filter(coalesce({0}, []), lambda t: starts_with(t, 'grade-'))"


def _tasks(s, d):
    return tasks.distinct_tasks(table(s, d, "queue_tasks"))


def _questions(s, d):
    return table(s, d, "questions").dropDuplicates(["id"])


@query("book_status", f"""
    WITH act AS (SELECT book_id, task_type, status, row_number() OVER (PARTITION BY book_id, task_type ORDER BY created_at DESC, id DESC) AS r FROM {TASKS} WHERE status IN ('queued', 'processing', 'error') AND chapter_id IS NULL)
    SELECT b.id AS book_id, coalesce(t.status, CASE WHEN len(coalesce(b.tags, [])) > 0 THEN 'ready' ELSE 'pending' END) AS tag_status,
      coalesce(e.status, CASE WHEN {STRIP.format("coalesce(b.description, '')")} <> '' THEN 'ready' ELSE 'pending' END) AS description_status
    FROM books b LEFT JOIN act t ON t.book_id = b.id AND t.task_type = 'tags' AND t.r = 1 LEFT JOIN act e ON e.book_id = b.id AND e.task_type = 'descriptions' AND e.r = 1""")
def _(s, d):
    return lifecycle.book_status(table(s, d, "books"), _tasks(s, d))


@query("chapter_status", f"""
    WITH act AS (SELECT chapter_id, max(CASE status WHEN 'processing' THEN 3 WHEN 'queued' THEN 2 ELSE 1 END) AS k FROM {TASKS} WHERE status IN ('queued', 'processing', 'error') AND task_type = 'questions' GROUP BY chapter_id),
    n AS (SELECT chapter_id, count(*) AS n FROM {QUESTIONS} GROUP BY chapter_id),
    c AS (SELECT c.id, len({_GRADES.replace("{0}", "b.tags")}) AS g, act.k, coalesce(n.n, 0) AS n FROM chapters c LEFT JOIN books b ON b.id = c.book_id LEFT JOIN act ON act.chapter_id = c.id LEFT JOIN n ON n.chapter_id = c.id)
    SELECT id AS chapter_id, CASE WHEN coalesce(g, 0) = 0 THEN 'pending' WHEN k = 3 THEN 'processing' WHEN k = 2 THEN 'queued' WHEN k = 1 THEN 'error' WHEN n >= 3 * g THEN 'ready' ELSE 'pending' END AS state FROM c""")
def _(s, d):
    return lifecycle.chapter_status(table(s, d, "chapters"), table(s, d, "books"), _questions(s, d), _tasks(s, d))


_KEPT = "(SELECT * FROM chapters WHERE book_id IN (SELECT id FROM books))"


@query("finalized_books", f"""
    WITH q AS (SELECT chapter_id, count(*) AS n FROM {QUESTIONS} GROUP BY chapter_id),
    c AS (SELECT k.book_id, count(*) AS c, sum(len({WORDS.format("coalesce(k.content, '')")})) AS w, sum(coalesce(q.n, 0)) AS n FROM {_KEPT} k LEFT JOIN q ON q.chapter_id = k.id GROUP BY k.book_id)
    SELECT sha256('book:' || b.id) AS id, b.title, b.author, coalesce(c.c, 0) AS total_chapters, coalesce(c.w, 0) AS word_count, coalesce(c.n, 0) AS n_questions FROM books b LEFT JOIN c ON c.book_id = b.id""")
def _(s, d):
    return lifecycle.published_tables(table(s, d, "books"), table(s, d, "chapters"), _questions(s, d))[0]


@query("finalized_chapters", f"""
    WITH q AS (SELECT chapter_id, count(*) AS n FROM {QUESTIONS} GROUP BY chapter_id)
    SELECT sha256('chapter:' || k.id) AS id, sha256('book:' || k.book_id) AS book_id, k.chapter_number, len({WORDS.format("coalesce(k.content, '')")}) AS word_count, coalesce(CAST(to_json(k.vocabulary_words) AS VARCHAR), '[]') AS vocabulary, coalesce(q.n, 0) AS n_questions
    FROM {_KEPT} k LEFT JOIN q ON q.chapter_id = k.id""")
def _(s, d):
    return lifecycle.published_tables(table(s, d, "books"), table(s, d, "chapters"), _questions(s, d))[1].drop("title", "content")


@query("finalized_questions", f"""
    SELECT sha256('question:' || id) AS id, sha256('chapter:' || chapter_id) AS chapter_id, sha256('book:' || book_id) AS book_id, question_text FROM {QUESTIONS} WHERE chapter_id IN (SELECT id FROM {_KEPT})""")
def _(s, d):
    return lifecycle.published_tables(table(s, d, "books"), table(s, d, "chapters"), _questions(s, d))[2].select("id", "chapter_id", "book_id", "question_text")


@query("nested_chapters", f"""
    SELECT c.id AS chapter_id, coalesce(q.ids, '') AS question_ids, array_to_string(list_transform(coalesce(c.vocabulary_words, []), lambda v: v.word), ',') AS vocabulary
    FROM chapters c LEFT JOIN (SELECT chapter_id, string_agg(id, ',' ORDER BY order_index NULLS FIRST, id) AS ids FROM {QUESTIONS} GROUP BY chapter_id) q ON q.chapter_id = c.id""")
def _(s, d):
    rows = lifecycle.nested_chapters(table(s, d, "chapters"), _questions(s, d))
    return rows.select("chapter_id", F.array_join("question_ids", ",").alias("question_ids"), F.array_join(F.transform("vocabulary", lambda v: v["word"]), ",").alias("vocabulary"))


_ANEW = "(SELECT id, book_id FROM chapters WHERE chapter_number = 2)"
_LEVELS = f"(SELECT id, unnest(CASE WHEN len({_GRADES.replace('{0}', 'tags')}) > 0 THEN {_GRADES.replace('{0}', 'tags')} ELSE [reading_level] END) AS g FROM books)"


@query("regenerated_tables", f"""
    SELECT 'question' AS kind, id, CAST(NULL AS VARCHAR) AS grade, CAST(NULL AS INTEGER) AS number FROM {QUESTIONS} WHERE chapter_id IS NULL OR chapter_id NOT IN (SELECT id FROM {_ANEW})
    UNION ALL SELECT 'vocabulary', id, CAST(len(CASE WHEN id IN (SELECT id FROM {_ANEW}) THEN [] ELSE vocabulary_words END) AS VARCHAR), NULL FROM chapters WHERE vocabulary_words IS NOT NULL
    UNION ALL SELECT 'task', id, NULL, NULL FROM {TASKS} WHERE NOT (status = 'queued' AND task_type = 'questions' AND coalesce(chapter_id, '') IN (SELECT id FROM {_ANEW}))
    UNION ALL SELECT 'new task', c.id, l.g, n FROM {_ANEW} c JOIN {_LEVELS} l ON l.id = c.book_id, unnest([1, 2, 3]) AS u(n)""")
def _(s, d):
    chapters = table(s, d, "chapters")
    chapters, questions, queue, new = lifecycle.regenerated(chapters.filter("chapter_number = 2"), table(s, d, "books"), chapters, _questions(s, d), _tasks(s, d))
    none, number = F.lit(None).cast("string").alias("grade"), F.lit(None).cast("int").alias("number")
    out = questions.select(F.lit("question").alias("kind"), "id", none, number)
    out = out.unionByName(chapters.filter("vocabulary_words IS NOT NULL").select(F.lit("vocabulary").alias("kind"), "id", F.size("vocabulary_words").cast("string").alias("grade"), number))
    out = out.unionByName(queue.select(F.lit("task").alias("kind"), "id", none, number))
    return out.unionByName(new.select(F.lit("new task").alias("kind"), F.col("chapter_id").alias("id"), F.col("grade_level").alias("grade"), F.col("question_number").alias("number")))


_HAD = f"(SELECT book_id, list(DISTINCT json_extract_string(payload, '$.grade_level')) FILTER (json_extract_string(payload, '$.grade_level') IS NOT NULL) AS grades FROM {TASKS} GROUP BY book_id)"


@query("reconciled_tasks", f"""
    WITH n AS (SELECT b.id, {_GRADES.replace("{0}", "b.tags")} AS new, list_filter({_GRADES.replace("{0}", "b.tags")}, lambda g: NOT list_contains(coalesce(h.grades, []), g)) AS added FROM books b LEFT JOIN {_HAD} h ON h.book_id = b.id)
    SELECT c.book_id, c.id AS chapter_id, w.g AS grade_level, 3 AS num_questions, 3 AS priority FROM chapters c JOIN (SELECT id, unnest(list_distinct(CASE WHEN len(added) > 0 THEN added ELSE new END)) AS g FROM n) w ON w.id = c.book_id""")
def _(s, d):
    had = _tasks(s, d).groupBy("book_id").agg(F.collect_set(tasks.payload(tasks.GRADE)).alias("grades"))
    return lifecycle.reconciled(table(s, d, "books"), table(s, d, "chapters"), had)


@query("dispatched_tasks", f"""
    SELECT id, CASE WHEN k IN ('tags', 'descriptions', 'questions') THEN k END AS handler, CASE WHEN k IN ('tags', 'descriptions', 'questions') THEN status ELSE 'error' END AS status,
      CASE k WHEN 'tags' THEN 1 WHEN 'descriptions' THEN 2 WHEN 'questions' THEN 3 ELSE 4 END AS type_priority FROM (SELECT id, status, CASE WHEN attempts > 1 THEN 'other' ELSE task_type END AS k FROM {TASKS})""")
def _(s, d):
    queue = _tasks(s, d).withColumn("task_type", F.when(F.col("attempts") > 1, "other").otherwise(F.col("task_type")))
    return lifecycle.dispatched(queue).select("id", "handler", "status", lifecycle.type_priority(F.col("task_type")).alias("type_priority"))


@query("touched_books", f"SELECT id, CASE WHEN id IN (SELECT book_id FROM chapters WHERE content IS NULL) THEN TIMESTAMP '{NOW}' ELSE created_at END AS created_at FROM books")
def _(s, d):
    books, chapters = table(s, d, "books"), table(s, d, "chapters")
    now = F.lit(NOW).cast(books.schema["created_at"].dataType)
    return lifecycle.touched_parents(books, chapters, chapters.filter("content IS NULL"), "created_at", now).select("id", "created_at")


@query("wanted_grades", f"""
    SELECT b.id AS book_id, array_to_string(list_sort(CASE WHEN len(a.added) > 0 THEN a.added ELSE n.grades END), ',') AS wanted
    FROM books b JOIN {_HAD} o ON o.book_id = b.id, LATERAL (SELECT {_GRADES.replace("{0}", "b.tags")} AS grades) n, LATERAL (SELECT list_filter(n.grades, lambda g: NOT list_contains(o.grades, g)) AS added) a WHERE o.grades IS NOT NULL""")
def _(s, d):
    old = _tasks(s, d).groupBy("book_id").agg(F.collect_set(tasks.payload(tasks.GRADE)).alias("old")).filter("size(old) > 0")
    rows = table(s, d, "books").select(F.col("id").alias("book_id"), lifecycle.grades(F.col("tags")).alias("new")).join(old, "book_id")
    return rows.select("book_id", F.array_join(tasks.grade_changes(F.col("old"), F.col("new"))["wanted"], ",").alias("wanted"))


@query("reading_half_hours", "SELECT grade, lo * 30 AS words_low, hi * 30 AS words_high, CAST(round(lo * 30 / 250.0, 1) AS DOUBLE) AS pages_low, CAST(round(hi * 30 / 250.0, 1) AS DOUBLE) AS pages_high FROM (VALUES ('1st', 80, 80), ('5th', 150, 160), ('9th', 200, 230), ('Adult', 238, 260)) t(grade, lo, hi)")
def _(s, d):
    rows = s.createDataFrame([("1st", 80, 80), ("5th", 150, 160), ("9th", 200, 230), ("Adult", 238, 260)], "grade string, lo int, hi int")
    return rows.select("grade", (F.col("lo") * 30).alias("words_low"), (F.col("hi") * 30).alias("words_high"), *[F.round(F.col(c) * 30 / 250.0, 1).cast("double").alias(f"pages_{n}") for c, n in (("lo", "low"), ("hi", "high"))])


@query("removed_tags", "SELECT id, array_to_string(list_filter(tags, lambda t: t <> 'humor'), ',') AS tags FROM books WHERE tags IS NOT NULL")
def _(s, d):
    return table(s, d, "books").filter("tags IS NOT NULL").select("id", F.array_join(T.without_tag(F.col("tags"), F.lit("humor")), ",").alias("tags"))


@query("task_labels", f"SELECT id, CASE task_type WHEN 'tags' THEN 'Tags' WHEN 'descriptions' THEN 'Descriptions' WHEN 'questions' THEN 'Questions' ELSE task_type END AS label FROM {TASKS}")
def _(s, d):
    return _tasks(s, d).select("id", T.task_label(F.col("task_type")).alias("label"))


@query("selective_deletion_branches", f"""
    SELECT 'both' AS by, count(*) AS n FROM {TASKS} WHERE NOT (book_id = (SELECT min(book_id) FROM queue_tasks) AND chapter_id IS NOT DISTINCT FROM (SELECT min(chapter_id) FROM queue_tasks) AND chapter_id IS NOT NULL)
    UNION ALL SELECT 'book and type', count(*) FROM {TASKS} WHERE NOT (book_id = (SELECT min(book_id) FROM queue_tasks) AND task_type = 'tags')
    UNION ALL SELECT 'book', count(*) FROM {TASKS} WHERE NOT (book_id = (SELECT min(book_id) FROM queue_tasks))
    UNION ALL SELECT 'chapter', count(*) FROM {TASKS} WHERE chapter_id IS NULL OR chapter_id <> (SELECT min(chapter_id) FROM queue_tasks)
    UNION ALL SELECT 'none', count(*) FROM {TASKS}""")
def _(s, d):
    queue = _tasks(s, d)
    least = F.broadcast(queue.agg(F.min("book_id").alias("b"), F.min("chapter_id").alias("c")))  # one row
    none = F.lit(None).cast("string")
    rows = queue.join(least)
    kept = lambda book, chapter, kind: F.count_if(~F.coalesce(tasks.selected_for_deletion(book, chapter, kind), F.lit(False)))
    b, c, k = F.col("b"), F.col("c"), F.lit("tags")
    counts = rows.agg(kept(b, c, none).alias("both"), kept(b, none, k).alias("book and type"), kept(b, none, none).alias("book"), kept(none, c, none).alias("chapter"), kept(none, none, none).alias("none"))
    return counts.select(F.explode(F.create_map(*[x for n in counts.columns for x in (F.lit(n), F.col(f"`{n}`"))])).alias("by", "n"))
