"""The task table in batch form: order of work, fan-out, deduplication, timeouts, latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill import config
from quillmill.operators import dml, library

GRADE, NUMBER = "$.grade_level", "$.question_number"


def payload(name: str) -> Column:
    return F.get_json_object("payload", name)


def distinct_tasks(tasks: DataFrame) -> DataFrame:
    """Each task once, as rows are delivered twice: the same id is the same task."""
    return tasks.dropDuplicates(["id"])


def waiting(tasks: DataFrame, n: int = 100) -> DataFrame:
    """The next tasks by priority, age and id: a top-k, not a sort of the whole table."""
    return tasks.filter("status = 'queued'").orderBy("priority", "created_at", "id").limit(n)


def assigned(tasks: DataFrame, now: Column, n_workers: int, minutes: int = config.TASK_TIMEOUT_MINUTES) -> DataFrame:
    """The first ``n_workers`` waiting tasks as they are once taken: processing, one more attempt, a timeout."""
    taken = waiting(tasks, n_workers)
    changed = {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_at": now, "timeout_at": now + F.expr(f"INTERVAL {minutes} MINUTES"), "started_at": F.coalesce("started_at", now)}
    return taken.withColumns(changed)


def timed_out(tasks: DataFrame, now: Column, message: str = "Task timed out") -> DataFrame:
    """All tasks, with those in work beyond their timeout as errors."""
    late = (F.col("status") == "processing") & (F.col("timeout_at") < now)
    return tasks.withColumns({"status": F.when(late, "error").otherwise(F.col("status")), "error_message": F.when(late, message).otherwise(F.col("error_message"))})


def status_counts(tasks: DataFrame, statuses: tuple[str, ...] = ("queued", "processing", "ready", "error")) -> DataFrame:
    """One row with the count of each status, 0 where there is none."""
    return tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def with_titles(tasks: DataFrame, books: DataFrame) -> DataFrame:
    """Tasks with their book's title; null where the book is unknown."""
    return tasks.join(books.select(F.col("id").alias("_b"), F.col("title").alias("book_title")), F.col("book_id") == F.col("_b"), "left").drop("_b")


def fan_out(chapters: DataFrame, books: DataFrame, per_chapter: int = config.QUESTIONS_PER_CHAPTER, vocabulary: int = config.VOCABULARY_PER_CHAPTER) -> DataFrame:
    """One question task per chapter, grade of its book and question number; the first also asks for vocabulary."""
    from quillmill.functions import text as T

    graded = books.select(F.col("id").alias("book_id"), F.explode(T.grades_or_level(F.col("tags"), F.col("reading_level"))).alias("grade_level"))
    rows = chapters.select(F.col("id").alias("chapter_id"), "book_id").join(graded, "book_id").withColumn("question_number", F.explode(F.sequence(F.lit(1), F.lit(per_chapter))))
    count = F.when(F.col("question_number") == 1, vocabulary).otherwise(0)
    return rows.select("book_id", "chapter_id", "grade_level", "question_number", count.alias("vocab_count"), F.lit(1).alias("num_questions"), F.lit(3).alias("priority"), F.to_json(F.struct("grade_level", F.lit(1).alias("num_questions"), "question_number")).alias("payload"))


def enqueue(existing: DataFrame, incoming: DataFrame, with_number: bool = False) -> DataFrame:
    """Incoming tasks that a unique key over waiting ones lets in. With the question number in the key, or as strict as without."""
    key = ["task_type", "book_id", "chapter_id", "grade"] + ["question_number"] * with_number
    named = lambda df: df.withColumns({"grade": F.coalesce(payload(GRADE), F.lit("")), "question_number": F.coalesce(payload(NUMBER), F.lit("")), "chapter_id": F.coalesce("chapter_id", F.lit(""))})
    return dml.insert_or_ignore(named(existing.filter("status IN ('queued', 'processing')")), named(incoming), key, ["created_at", "id"])


def replaced(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Waiting tasks of the same kind, book and chapter give way to incoming ones."""
    keys = ["task_type", "book_id", "chapter_id"]
    doomed = incoming.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys]).distinct()
    old = existing.withColumns({f"_{k}": F.coalesce(k, F.lit("")) for k in keys})
    hit = (F.col("status") == "queued") & F.col("_hit")
    joined = old.join(doomed.select(*[F.col(k).alias(f"_{k}") for k in keys]).withColumn("_hit", F.lit(True)), [f"_{k}" for k in keys], "left")
    return joined.filter(~F.coalesce(hit, F.lit(False))).select(*existing.columns).unionByName(incoming)


def latest_by_book(tasks: DataFrame) -> DataFrame:
    """The newest task of each book and kind among those of whole books."""
    return library.latest(tasks.filter("chapter_id IS NULL"), ["book_id", "task_type"], [F.desc("created_at"), F.desc("id")])


def chapter_states(tasks: DataFrame) -> DataFrame:
    """The state of each chapter by its tasks: in work before waiting before failed before done."""
    rank = F.when(F.col("status") == "processing", 3).when(F.col("status") == "queued", 2).when(F.col("status") == "error", 1).otherwise(0)
    out = tasks.filter("chapter_id IS NOT NULL").groupBy("chapter_id").agg(F.max(rank).alias("r"), F.count_if(F.col("status") == "ready").alias("n_ready"))
    return out.select("chapter_id", F.element_at(F.array(*map(F.lit, ("ready", "error", "queued", "processing"))), F.col("r") + 1).alias("state"), "n_ready")


def selected_for_deletion(book: Column, chapter: Column, kind: Column) -> Column:
    """The most specific of the given criteria: book and chapter, book and kind, book, chapter, or kind."""
    own = lambda name, value: F.col(name) == value
    return (
        F.when(book.isNotNull() & chapter.isNotNull(), own("book_id", book) & own("chapter_id", chapter))
        .when(book.isNotNull() & kind.isNotNull(), own("book_id", book) & own("task_type", kind))
        .when(book.isNotNull(), own("book_id", book))
        .when(chapter.isNotNull(), own("chapter_id", chapter))
        .when(kind.isNotNull(), own("task_type", kind))
        .otherwise(False)
    )


def grade_changes(old: Column, new: Column) -> Column:
    """STRUCT<removed, added, wanted>: wanted are the added grades, or all new ones where none was added."""
    added = F.array_except(new, old)
    return F.struct(F.sort_array(F.array_except(old, new)).alias("removed"), F.sort_array(added).alias("added"), F.sort_array(F.when(F.size(added) > 0, added).otherwise(new)).alias("wanted"))


def newest_state(events: DataFrame) -> DataFrame:
    """The last state of each task over delivered rows; ties go to the greater status."""
    w = W.partitionBy("id").orderBy(F.desc_nulls_last(F.coalesce("completed_at", "started_at", "created_at")), F.desc("status"))
    return events.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
