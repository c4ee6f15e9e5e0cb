"""Reads over books, chapters and questions: counts, nested views, tags, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill import config
from quillmill.functions import text as T
from quillmill.tables import cut_lineage


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "n_children") -> DataFrame:
    """Each parent with the number of its children, 0 where it has none; children are counted before the join."""
    counts = children.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    return parents.join(counts, parents["id"] == F.col("_key"), "left").select(parents["*"], F.coalesce("_n", F.lit(0)).alias(name))


def book_stats_fanout(books: DataFrame, chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """Counts over a join of both children: every question counts once for each chapter of its book."""
    c = chapters.groupBy(F.col("book_id").alias("cb")).agg(F.count("*").alias("c"), F.count_distinct("id").alias("cd"))
    q = questions.groupBy(F.col("book_id").alias("qb")).agg(F.count("id").alias("q"))
    joined = books.join(c, books["id"] == F.col("cb"), "left").join(q, books["id"] == F.col("qb"), "left")
    n_questions = F.coalesce("q", F.lit(0)) * F.greatest(F.coalesce("c", F.lit(0)), F.lit(1))
    return joined.select(books["id"].alias("book_id"), F.coalesce("cd", F.lit(0)).alias("n_chapters"), n_questions.alias("n_questions"))


def book_stats(books: DataFrame, chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """Chapters and questions of each book, each counted for itself."""
    out = child_counts(books.select("id", "title"), chapters, "book_id", "n_chapters")
    return child_counts(out, questions, "book_id", "n_questions").withColumnRenamed("id", "book_id")


def source_stats(texts: DataFrame, text_col: str = "text", per_minute: int = config.WORDS_PER_MINUTE) -> DataFrame:
    """Texts, words and reading minutes per source."""
    rows = texts.select("source", T.word_count(F.coalesce(text_col, F.lit(""))).alias("n"))
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"), F.sum(T.reading_minutes(F.col("n"), per_minute)).alias("minutes"))


def nested_books(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row per book with its chapters in order, by one join instead of a lookup per book. A book's chapters form one row."""
    own = chapters.groupBy(F.col("book_id")).agg(F.sort_array(F.collect_list(F.struct("chapter_number", "id"))).alias("c"))
    return books.select(F.col("id").alias("book_id"), "title").join(own, "book_id", "left").select("book_id", "title", F.coalesce(F.transform("c", lambda x: x["id"]), F.array().cast("array<string>")).alias("chapter_ids"))


def numbered(df: DataFrame, group: str, order: list[str], name: str = "number") -> DataFrame:
    """Numbers rows within groups, from 1, by columns that order them fully.

    Rows are spread by ranges of group and order, so that a group which holds a third of all rows is sorted by many tasks.
    Each row counts within its range and group; what the ranges before hold of the group is added. The ranges are written
    once, as both steps must see the same ones.
    """
    ranged = cut_lineage(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy("_range", group).orderBy(*order)))
    before = W.partitionBy("_g").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    held = ranged.groupBy(F.col(group).alias("_g"), "_range").agg(F.count("*").alias("_n"))  # at most one row a range and group
    held = held.select("_g", F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = local.join(held, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_local") + F.col("_before")).cast("int").alias(name))


def matter_flags(chapters: DataFrame) -> DataFrame:
    """Position of each chapter in its book, whether it lies in the first or last fifth, and whether it is front or back matter."""
    placed = numbered(chapters.select("id", "book_id", "title", "chapter_number"), "book_id", ["chapter_number", "id"])
    totals = chapters.groupBy(F.col("book_id").alias("_b")).agg(F.count("*").alias("total"))
    rows = placed.join(totals, F.col("book_id").eqNullSafe(F.col("_b"))).withColumn("pos", F.col("number") - 1)
    return rows.select("id", "pos", (F.col("pos") < F.col("total") * 0.2).alias("in_front"), (F.col("pos") > F.col("total") * 0.8).alias("in_back"), T.is_matter(F.col("title"), F.col("pos"), F.col("total")).alias("is_matter"))


def unique_grades(books: DataFrame) -> DataFrame:
    return books.select(F.explode(T.grade_tags(F.col("tags"))).alias("grade")).distinct()


def first_of(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; tasks keep n of a group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order with ties broken by the caller."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def colours(chapters: DataFrame, n: int = 5) -> DataFrame:
    """Colour numbers dealt in turn over a book's chapters."""
    return numbered(chapters.select("id", "book_id", "chapter_number"), "book_id", ["chapter_number", "id"]).select("id", ((F.col("number") - 1) % n).alias("colour"))
