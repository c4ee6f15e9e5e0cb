"""The life of a draft: its state, publishing with children and nested vocabulary, and regeneration of its questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill import config
from quillmill.functions import text as T
from quillmill.operators import library, tasks

ACTIVE = ("queued", "processing", "error")
#: Priorities of task types, and the types that a worker knows.
PRIORITIES = {"tags": 1, "descriptions": 2, "questions": 3}


def no_grades() -> Column:
    return F.array().cast("array<string>")


def grades(tags: Column) -> Column:
    return F.coalesce(T.grade_tags(tags), no_grades())


def derived_id(kind: str, own: Column) -> Column:
    """An id that follows from the old one, so that parents and children are remapped alike without a join."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), own), 256)


def book_status(books: DataFrame, queue: DataFrame) -> DataFrame:
    """(book_id, tag_status, description_status): the newest active task's status, else ready if there is data, else pending."""
    active = queue.filter(F.col("status").isin(*ACTIVE) & F.col("chapter_id").isNull() & F.col("task_type").isin("tags", "descriptions"))
    newest = library.latest(active, ["book_id", "task_type"], [F.desc("created_at"), F.desc("id")])
    own = newest.groupBy(F.col("book_id").alias("_b")).agg(*[F.max(F.when(F.col("task_type") == t, F.col("status"))).alias(f"_{t}") for t in ("tags", "descriptions")])
    status = lambda task, data: F.coalesce(task, F.when(data, "ready").otherwise("pending"))
    joined = books.join(own, books["id"] == F.col("_b"), "left")
    has_text = F.coalesce(T.strip(F.col("description")), F.lit("")) != ""
    return joined.select(books["id"].alias("book_id"), status(F.col("_tags"), F.size(F.coalesce("tags", no_grades())) > 0).alias("tag_status"), status(F.col("_descriptions"), has_text).alias("description_status"))


def chapter_status(chapters: DataFrame, books: DataFrame, questions: DataFrame, queue: DataFrame, per_grade: int = config.QUESTIONS_PER_CHAPTER) -> DataFrame:
    """(chapter_id, state): pending without grades; else processing before queued before error; else ready at enough questions."""
    graded = books.select(F.col("id").alias("book_id"), F.size(grades(F.col("tags"))).alias("n_grades"))
    rank = F.when(F.col("status") == "processing", 3).when(F.col("status") == "queued", 2).otherwise(1)
    active = queue.filter(F.col("status").isin(*ACTIVE) & (F.col("task_type") == "questions")).groupBy(F.col("chapter_id").alias("_c")).agg(F.max(rank).alias("_rank"))
    counted = questions.groupBy(F.col("chapter_id").alias("_q")).agg(F.count("*").alias("_n"))
    rows = chapters.select("id", "book_id").join(graded, "book_id", "left").join(active, F.col("id") == F.col("_c"), "left").join(counted, F.col("id") == F.col("_q"), "left")
    working = F.when(F.col("_rank") == 3, "processing").when(F.col("_rank") == 2, "queued").when(F.col("_rank") == 1, "error")
    done = F.when(F.coalesce("_n", F.lit(0)) >= F.col("n_grades") * per_grade, "ready").otherwise("pending")
    return rows.select(F.col("id").alias("chapter_id"), F.when(F.coalesce("n_grades", F.lit(0)) == 0, "pending").otherwise(F.coalesce(working, done)).alias("state"))


def nested_vocabulary(vocabulary: Column) -> Column:
    """JSON text of a chapter's vocabulary; a missing list is an empty one."""
    return F.coalesce(F.to_json(vocabulary, {"ignoreNullFields": "false"}), F.lit("[]"))


def published_tables(books: DataFrame, chapters: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, chapters, questions) under derived ids; chapters carry their vocabulary as JSON, and children their counts.

    Chapters and questions without a parent are left out. Ids follow from the old ones: no map has to be kept or joined.
    """
    parents = books.select(F.col("id").alias("book_id"))
    kept = chapters.join(parents, "book_id", "left_semi")
    counted = questions.groupBy(F.col("chapter_id").alias("_q")).agg(F.count("*").alias("n_questions"))
    new_chapters = kept.join(counted, kept["id"] == F.col("_q"), "left").select(
        derived_id("chapter", kept["id"]).alias("id"), derived_id("book", kept["book_id"]).alias("book_id"), "chapter_number", "title", "content",
        T.word_count(F.coalesce("content", F.lit(""))).alias("word_count"), nested_vocabulary(F.col("vocabulary_words")).alias("vocabulary"), F.coalesce("n_questions", F.lit(0)).alias("n_questions"),
    )
    new_questions = questions.join(kept.select(F.col("id").alias("chapter_id")), "chapter_id", "left_semi")
    new_questions = new_questions.withColumns({"id": derived_id("question", F.col("id")), "chapter_id": derived_id("chapter", F.col("chapter_id")), "book_id": derived_id("book", F.col("book_id"))})
    totals = new_chapters.groupBy(F.col("book_id").alias("_b")).agg(F.count("*").alias("_c"), F.sum("word_count").alias("_w"), F.sum("n_questions").alias("_n"))
    own = books.select(derived_id("book", F.col("id")).alias("id"), "title", "author").join(totals, F.col("id") == F.col("_b"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.select("id", "title", "author", zero("_c").alias("total_chapters"), zero("_w").alias("word_count"), zero("_n").alias("n_questions")), new_chapters, new_questions


def nested_chapters(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """(chapter_id, question_ids ARRAY, vocabulary ARRAY<STRUCT>): children nested by one join; no children give empty lists."""
    own = questions.groupBy("chapter_id").agg(F.sort_array(F.collect_list(F.struct("order_index", "id"))).alias("q"))  # a chapter's few questions
    rows = chapters.select(F.col("id").alias("chapter_id"), "vocabulary_words").join(own, "chapter_id", "left")
    empty = F.filter("vocabulary_words", lambda _: F.lit(False))
    return rows.select("chapter_id", F.coalesce(F.transform("q", lambda x: x["id"]), no_grades()).alias("question_ids"), F.coalesce("vocabulary_words", empty).alias("vocabulary"))


def regenerated(doomed: DataFrame, books: DataFrame, chapters: DataFrame, questions: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chapters, questions, queue, new tasks) after the chapters ``doomed`` (id) are asked to be made anew.

    Their questions, vocabulary and waiting question tasks go; each gets the tasks of its book's grades again.
    """
    gone = doomed.select(F.col("id").alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    marked = chapters.join(gone, chapters["id"] == F.col("_gone"), "left")
    new_chapters = marked.withColumn("vocabulary_words", F.when(F.col("_hit"), F.filter("vocabulary_words", lambda _: F.lit(False))).otherwise(F.col("vocabulary_words"))).select(*chapters.columns)
    new_questions = questions.join(gone, questions["chapter_id"] == F.col("_gone"), "left_anti")
    waiting = queue.filter("status = 'queued' AND task_type = 'questions'").join(gone, F.col("chapter_id") == F.col("_gone"), "left_semi").select(F.col("id").alias("_t")).distinct()
    left = queue.join(waiting, queue["id"] == F.col("_t"), "left_anti")
    return new_chapters, new_questions, left, tasks.fan_out(marked.filter("_hit").select(*chapters.columns), books)


def reconciled(books: DataFrame, chapters: DataFrame, had: DataFrame, per_grade: int = config.QUESTIONS_PER_CHAPTER) -> DataFrame:
    """Tasks (book_id, chapter_id, grade_level, num_questions) after a book's grades changed; had: (book_id, grades).

    One task for each chapter and wanted grade: the added grades, or all if none was added.
    """
    now = books.select(F.col("id").alias("book_id"), grades(F.col("tags")).alias("_new")).join(had, "book_id", "left")
    wanted = now.select("book_id", F.explode(tasks.grade_changes(F.coalesce("grades", no_grades()), F.col("_new"))["wanted"]).alias("grade_level"))
    return chapters.select(F.col("id").alias("chapter_id"), "book_id").join(wanted, "book_id").select("book_id", "chapter_id", "grade_level", F.lit(per_grade).alias("num_questions"), F.lit(PRIORITIES["questions"]).alias("priority"))


def dispatched(queue: DataFrame) -> DataFrame:
    """Tasks with the handler of their type; an unknown or missing type becomes an error."""
    known = F.coalesce(F.col("task_type").isin(*PRIORITIES), F.lit(False))
    text = F.concat(F.lit("Unknown task type: "), F.coalesce("task_type", F.lit("null")))
    return queue.withColumns({"handler": F.when(known, F.col("task_type")), "status": F.when(known, F.col("status")).otherwise("error"), "error_message": F.when(known, F.col("error_message")).otherwise(text)})


def type_priority(kind: Column) -> Column:
    """The priority of a task type; unknown types come last."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])[kind], F.lit(max(PRIORITIES.values()) + 1))


def touched_parents(books: DataFrame, children: DataFrame, doomed: DataFrame, column: str, value: Column) -> DataFrame:
    """Sets ``column`` of the books to which one of the children ``doomed`` (id) belongs: an update by subquery, as a semi-join."""
    hit = children.join(doomed.select(F.col("id").alias("_d")).distinct(), children["id"] == F.col("_d"), "left_semi").select(F.col("book_id").alias("_b")).distinct().withColumn("_hit", F.lit(True))
    joined = books.join(hit, books["id"] == F.col("_b"), "left")
    return joined.select(*[F.when(F.col("_hit"), value).otherwise(books[c]).alias(c) if c == column else books[c] for c in books.columns])
