"""Cutting long documents into pages and sections. Folds keep paragraph numbers only; texts are joined back at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill import config
from quillmill.functions import text as T


def fixed_pages(text: Column, size: int = config.PAGE_WORDS) -> Column:
    """ARRAY of pages of ``size`` words, joined by one blank; no words, no pages."""
    pages = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(w, i * size + 1, F.lit(size)), " "))
    return T.let(T.words(text), lambda w: F.when(F.size(w) > 0, pages(w)).otherwise(F.array().cast("array<string>")))


def _spans(parts: Column, starts: Column) -> Column:
    """Joins paragraphs of each span that begins at a number in starts (from 0)."""
    last = F.size(starts)
    return F.transform(starts, lambda a, i: F.array_join(F.slice(parts, a + 1, F.when(i + 1 < last, F.get(starts, i + 1)).otherwise(F.size(parts)) - a), "\n\n"))


def greedy_pages(text: Column, most: int = config.GREEDY_PAGE_WORDS, separator: str = r"\n\n+") -> Column:
    """Whole paragraphs per page up to ``most`` words; a longer paragraph alone; a text without paragraphs as it is."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, p: Column) -> Column:
        n = T.word_count(p)
        fresh = (F.size(acc["starts"]) == 0) | (acc["n"] + n > most)
        return F.struct((acc["i"] + 1).alias("i"), F.when(fresh, n).otherwise(acc["n"] + n).alias("n"), F.when(fresh, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"))

    return T.let(T.paragraphs(text, separator), lambda parts: F.when(F.size(parts) > 0, T.let(F.aggregate(parts, start, step)["starts"], lambda s: _spans(parts, s))).otherwise(F.array(text)))


def section_spans(parts: Column, level: str = config.DEFAULT_LEVEL) -> Column:
    """Folds paragraph structs into ARRAY<STRUCT<first, n, words>> of sections, short ones included."""
    least, most = config.level_target(level)
    span = "struct<first:int,n:int,words:int>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(False).alias("talk"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        skip = (p["word_count"] < 5) & (p["type"] == "heading") & (acc["n"] == 0)
        mid_talk = acc["talk"] & ~p["ends_dialogue"]
        over = (acc["words"] >= most) & (((p["type"] == "narrative") & ~acc["talk"]) | p["ends_dialogue"])
        split = (acc["words"] >= least) & ~mid_talk & (p["has_scene_break"] | (p["type"] == "heading") | over) & (acc["n"] > 0)
        talk = F.when(p["starts_dialogue"], True).when(p["ends_dialogue"], False).otherwise(acc["talk"])
        closed = F.array_append(acc["out"], F.struct(acc["first"].alias("first"), acc["n"].alias("n"), acc["words"].alias("words")))
        kept = F.struct((acc["i"] + 1).alias("i"), acc["first"].alias("first"), acc["n"].alias("n"), acc["words"].alias("words"), acc["talk"].alias("talk"), acc["out"].alias("out"))
        moved = F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(split | (acc["n"] == 0), acc["i"]).otherwise(acc["first"]).alias("first"),
            F.when(split, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(split, p["word_count"]).otherwise(acc["words"] + p["word_count"]).alias("words"),
            talk.alias("talk"),
            F.when(split, closed).otherwise(acc["out"]).alias("out"),
        )
        return F.when(skip, kept).otherwise(moved)

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.array_append(acc["out"], F.struct(acc["first"].alias("first"), acc["n"].alias("n"), acc["words"].alias("words")))).otherwise(acc["out"])

    return F.aggregate(parts, start, step, finish)


def sections(df: DataFrame, id_col: str, text_col: str, level: str = config.DEFAULT_LEVEL, least: int = config.MIN_SECTION_WORDS, separator: str = r"\n\n+") -> DataFrame:
    """(id, number, title, content, word_count, paragraph_count): sections of at least ``least`` words, numbered after that."""
    parts = df.select(F.col(id_col), F.transform(T.paragraphs(F.col(text_col), separator), T.paragraph_struct).alias("parts"))
    spans = parts.select(id_col, F.transform("parts", lambda p: p["text"]).alias("texts"), F.filter(section_spans(F.col("parts"), level), lambda s: s["words"] >= least).alias("spans"))
    rows = spans.select(id_col, "texts", F.posexplode_outer("spans").alias("pos", "s")).filter("s IS NOT NULL")
    number = F.col("pos") + 1
    rows = rows.select(id_col, number.alias("number"), F.array_join(F.slice("texts", F.col("s.first") + 1, F.col("s.n")), "\n\n").alias("content"), F.col("s.words").alias("word_count"), F.col("s.n").alias("paragraph_count"))
    return rows.withColumn("title", T.section_title(F.col("content"), F.col("number")))


def route_pages(pages: DataFrame, id_col: str, deleted: Column, metadata: Column) -> DataFrame:
    """pages (id, page from 1, text) -> (id, kind, first_page, last_page, content, title).

    Deleted pages vanish; content pages join into one row; runs of metadata pages between content pages join into one each,
    and deleted pages do not end a run.
    """
    kind = F.when(deleted, "deleted").when(metadata, "metadata").otherwise("content")
    rows = pages.withColumn("kind", kind).filter("kind <> 'deleted'")
    run = F.sum((F.col("kind") == "content").cast("int")).over(W.partitionBy(id_col).orderBy("page"))
    rows = rows.withColumn("run", F.when(F.col("kind") == "metadata", run).otherwise(-1))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n\n")
    out = rows.groupBy(id_col, "kind", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), ordered.alias("content"))
    line = F.get(F.filter(F.transform(F.split("content", "\n"), T.strip), lambda s: (F.length(s) > 3) & (F.length(s) < 100)), F.lit(0))
    return out.select(id_col, "kind", "first_page", "last_page", "content", F.when(F.col("kind") == "metadata", F.coalesce(line, F.lit("Metadata Section"))).alias("title"))
