"""Changes of tables as transformations from one snapshot to the next; the result is to be written under a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import library


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows whose keys exist already are rejected; nulls never match."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti"), incoming.join(existing.select(*keys).distinct(), keys, "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows, replaced by the last incoming row of the same key; new keys are added."""
    both = existing.withColumn("_s", F.lit(0)).unionByName(incoming.withColumn("_s", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc("_s"), F.desc(order), F.desc("id"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_s")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows that survive a unique key: the first of each key, unless the key exists."""
    first = incoming.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def overlay(existing: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets the given columns where a change has a value; all else stays."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = existing.join(new, existing[key] == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_{c}", existing[c]).alias(c) if c in columns else existing[c] for c in existing.columns])


def recount_words(existing: DataFrame, contents: DataFrame) -> DataFrame:
    """New contents by id, with the word count recomputed where the content changed."""
    out = overlay(existing, contents.withColumn("word_count", T.word_count(F.col("content"))), "id", ["content", "word_count"])
    return out


def delete_cascade(doomed: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Removes rows level by level. tables: (rows, parent column, own id column), parents first; doomed: (id).

    Each level loses the rows whose parent is gone; the ids of a level that go are those of the next level's parents.
    """
    out, gone = [], doomed.select(F.col("id").alias("_gone"))
    for rows, parent, own in tables:
        hit = rows.join(gone, rows[parent] == F.col("_gone"), "left_semi")
        out.append(rows.join(gone, rows[parent] == F.col("_gone"), "left_anti"))
        gone = hit.select(F.col(own).alias("_gone")).distinct()
    return out


def append_ordered(existing: DataFrame, incoming: DataFrame, group: str, order: list[str], name: str = "order_index") -> DataFrame:
    """Incoming rows with numbers that continue each group's greatest; rows without a group are numbered too, as one group."""
    greatest = existing.groupBy(F.col(group).alias("_g")).agg(F.max(name).alias("_m"))
    rows = library.numbered(incoming.drop(name), group, order, "_r")
    rows = rows.join(greatest, rows[group].eqNullSafe(F.col("_g")), "left")
    return rows.withColumn(name, F.coalesce("_m", F.lit(0)) + F.col("_r")).drop("_m", "_r", "_g")


def with_item_grade(items: DataFrame, task_grade: Column, column: str = "grade_level") -> DataFrame:
    """Items without a grade of their own get that of their task."""
    return items.withColumn(column, F.coalesce(F.when(F.trim(column) != "", F.col(column)), task_grade))


def replace_groups(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that come again replace the old ones whole; an empty group replaces nothing."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def deleted_with(existing: DataFrame, ids: DataFrame, tasks: DataFrame, key: str = "chapter_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, removed rows, tasks left): removes rows by id and the queued tasks that were for them."""
    doomed = ids.select(F.col("id").alias("_d")).distinct()
    removed = existing.join(doomed, existing["id"] == F.col("_d"), "left_semi")
    kept = existing.join(doomed, existing["id"] == F.col("_d"), "left_anti")
    purged = tasks.filter("status = 'queued'").join(doomed, F.col(key) == F.col("_d"), "left_semi").select(F.col("id").alias("_t")).distinct()
    return kept, removed, tasks.join(purged, tasks["id"] == F.col("_t"), "left_anti")


def published(books: DataFrame, chapters: DataFrame, per_minute: int = 200) -> DataFrame:
    """Finished books with their counts: chapters, words, and minutes rounded down. Ids are derived, so runs agree."""
    words = chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum(T.word_count(F.coalesce("content", F.lit("")))).alias("n_words"))
    rows = books.join(words, books["id"] == words["book_id"], "left").select(books["id"], books["title"], F.coalesce("n_chapters", F.lit(0)).alias("total_chapters"), F.coalesce("n_words", F.lit(0)).alias("word_count"))
    return rows.select(F.sha2(F.concat(F.lit("book:"), F.col("id")), 256).alias("published_id"), F.col("id").alias("draft_id"), "title", "total_chapters", "word_count", F.floor(F.col("word_count") / per_minute).cast("int").alias("minutes"))
