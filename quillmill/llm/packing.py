"""Problem 7: filling containers of fixed capacity with whole items.

The plan is made over a histogram of lengths, not over documents: best fit, longest first, on counts. The histogram has at
most ``capacity`` rows whatever the corpus, and it alone goes to the driver. The plan says which ranks within a length go
to which containers; documents take their slots by joining on (length, rank within length).

Defined cases: null texts, empty texts and texts of no tokens are left out; a document longer than the capacity is divided
into full containers and a rest, which is packed like any item (so nothing shorter is ever divided); repeated ids are items
of their own; ties of length are ordered by id. An empty input gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.tokens import DEFAULT_VOCABULARY, token_counts
from quillmill.tables import cut_lineage

CAPACITY = 2048
PLAN_SCHEMA = "length int, first_rank bigint, last_rank bigint, per_container bigint, first_container bigint"


@dataclass(frozen=True)
class Slot:
    """Items of ``length`` with ranks first_rank..last_rank fill containers from ``first_container`` on, ``per`` in each."""

    length: int
    first_rank: int
    last_rank: int
    per: int
    first_container: int


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Best-fit decreasing on counts. Containers with equal room are kept as (first id, count) spans."""
    room: dict[int, list[tuple[int, int]]] = {}
    plan: list[Slot] = []
    containers = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(span: tuple[int, int], space: int) -> tuple[int, int] | None:
            """Fills a span's containers as far as items are left; gives back the untouched part."""
            nonlocal left, rank
            first, count = span
            per = space // length
            for each in (per, left - left // per * per if left < count * per else 0):
                use = min(count, left // each) if each else 0
                if each != per:
                    use = min(use, 1)
                if use:
                    plan.append(Slot(length, rank, rank + use * each - 1, each, first))
                    if space > each * length:
                        room.setdefault(space - each * length, []).append((first, use))
                    rank, left, first, count = rank + use * each, left - use * each, first + use, count - use
            return (first, count) if count else None

        for space in sorted(s for s in room if s >= length):
            if not left:
                break
            spans, kept = room.pop(space), []
            for span in spans:
                rest = place(span, space) if left else span
                if rest:
                    kept.append(rest)
            if kept:
                room.setdefault(space, []).extend(kept)
        if left:
            per = capacity // length
            need = -(-left // per)
            first = containers
            containers += need
            place((first, need), capacity)
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """items (id, n_tokens) -> (id, piece_no, token_start, n_tokens, container_id).

    Every piece except a full one comes from the plan. Ranks within a length are counted per bucket of ids and shifted by
    the buckets before, so that a length shared by a third of all items is still ranked by many tasks.
    """
    spark = items.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = items.filter(F.col("n_tokens") > 0).select("id", F.col("n_tokens").cast("int").alias("size"))
    whole = F.floor(F.col("size") / capacity).cast("int")
    rest = sized.withColumn("full", whole).withColumn("length", (F.col("size") - whole * capacity).cast("int"))
    rest = rest.filter("length > 0").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    counts = cut_lineage(rest.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = best_fit_plan(histogram, capacity)
    packed = max((s.first_container + (s.last_rank - s.first_rank) // s.per for s in plan), default=-1) + 1
    slots = spark.createDataFrame([(s.length, s.first_rank, s.last_rank, s.per, s.first_container) for s in plan], PLAN_SCHEMA)
    before = counts.withColumn("shift", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("shift", F.lit(0)).alias("shift"))
    ranked = rest.withColumn("local", F.row_number().over(W.partitionBy("length", "bucket").orderBy("id", "size")) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("shift"))
    # The plan has a few rows per length: its size follows the capacity, not the corpus.
    placed = (
        ranked.join(F.broadcast(slots.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
        .select("id", F.col("full").alias("piece_no"), (F.col("full") * capacity).alias("token_start"), F.col("length").alias("n_tokens"), (F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_container"))).cast("bigint").alias("container_id"))
    )
    # Full pieces take containers of their own after the planned ones, numbered by partition of ids and then within it.
    long = sized.filter(F.col("size") >= capacity).withColumn("full", whole).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    spans = long.groupBy("bucket").agg(F.sum("full").alias("n"))
    spans = spans.select("bucket", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))  # as many rows as buckets
    own = W.partitionBy("bucket").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    full = long.withColumn("local", F.coalesce(F.sum("full").over(own), F.lit(0))).join(spans, "bucket")
    full = full.select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"), (F.col("local") + F.col("shift") + packed).alias("base"))
    full = full.select("id", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.lit(capacity).alias("n_tokens"), (F.col("base") + F.col("piece_no")).cast("bigint").alias("container_id"))
    return placed.unionByName(full)


def packed_documents(spark: SparkSession, documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Query p7_containers: (doc_id, piece_no, token_start, n_tokens, container_id)."""
    real = documents.filter(F.length("text") > 0).select("doc_id", "text")
    sizes = cut_lineage(token_counts(real, vocabulary=vocabulary))
    return pack(sizes, capacity).withColumnRenamed("id", "doc_id")
