"""Finding passages again in paragraphs, and titles that are nearly alike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillmill.functions import text as T


def passages(excerpts: DataFrame, documents: DataFrame, key: str, n_words: int = 50, n_chars: int = 100, least: int = 10, words_each: int = 100) -> DataFrame:
    """Where each excerpt begins among the paragraphs of the same key, and the paragraphs it goes on over.

    excerpts (key, id, text), documents (key, p ARRAY of paragraphs) -> (id, idx). One join on the key; paragraphs stay in
    their row, and the first one that contains the beginning counts.
    """
    plain = T.for_matching(F.col("text"))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    asked = excerpts.select(F.col(key).alias("k"), "id", F.substring(F.array_join(F.slice(words, 1, n_words), " "), 1, n_chars).alias("pattern"), F.size(words).alias("n"), F.length(plain).alias("len")).filter(F.col("len") >= least)
    joined = asked.join(documents.select(F.col(key).alias("k"), "p"), "k")
    at = F.array_position(F.transform("p", lambda x: F.contains(T.for_matching(x), F.col("pattern"))), True) - 1
    first = joined.select("id", "n", at.cast("int").alias("at"), F.size("p").alias("of")).filter("at >= 0")
    reach = F.least(F.col("at") + F.greatest(F.ceil(F.col("n") / words_each), F.lit(1)) - 1, F.col("of") - 1)
    return first.select("id", F.explode(F.sequence(F.col("at"), reach.cast("int"))).alias("idx"))


def last_writer(matches: DataFrame, order: str) -> DataFrame:
    """One owner per paragraph: of those that match it the one processed last."""
    return matches.groupBy("key", "idx").agg(F.max_by("id", F.struct(order, "id")).alias("id"))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts with their words sorted: twice the longest common subsequence over both lengths, in percent."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        s, t = (" ".join(sorted(v.lower().split())) for v in (x, y))
        if not s and not t:
            return 100.0
        # One bit a place of s: a row of the table of common subsequences is one addition of long integers.
        places: dict[str, int] = {}
        for i, c in enumerate(s):
            places[c] = places.get(c, 0) | 1 << i
        full = row = (1 << len(s)) - 1
        for c in t:
            hit = row & places.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        return 200.0 * (len(s) - row.bit_count()) / (len(s) + len(t))

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def edit_likeness(a: Column, b: Column) -> Column:
    return 100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """0.6 of the normalised edit similarity and 0.4 of the token sort ratio, in percent."""
    return 0.6 * edit_likeness(a, b) + 0.4 * token_sort_ratio(a, b)


def claimed(left: DataFrame, right: DataFrame, key: str, threshold: float = 78.0) -> DataFrame:
    """left (key, id, pos, text) x right (key, idx, text) of one key: the first by position that is alike claims a row.

    Pairs whose lengths, and then whose edits, already rule the threshold out are dropped before Python sees them.
    """
    a, b = left.alias("a"), right.alias("b")
    bound = F.least(F.length("a.text"), F.length("b.text")) * 100.0 / F.greatest(F.length("a.text"), F.length("b.text"), F.lit(1))
    near = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).filter(0.6 * bound + 40 >= threshold).filter(0.6 * edit_likeness(F.col("a.text"), F.col("b.text")) + 40 >= threshold)
    hits = near.filter(likeness(F.col("a.text"), F.col("b.text")) >= threshold)
    w = W.partitionBy(f"b.{key}", "b.idx").orderBy("a.pos", "a.id")
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col(f"b.{key}").alias(key), "idx", "id")
