"""Vocabulary notes in chapter markup. What is marked depends on the places before it, so this part is Python, by Arrow batch."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def note_first(text: str, vocabulary: list[dict]) -> str:
    """Marks the first place of each word, unless it lies in a tag or shortly behind another note."""
    for entry in vocabulary:
        word, meaning = (entry.get("word") or "").strip(), (entry.get("definition") or "").strip()
        place = re.search(rf"\b{re.escape(word)}\b", text, re.IGNORECASE) if word and meaning else None
        if place is None:
            continue
        before = text[: place.start()]
        if before.rfind("<") > before.rfind(">") or "<abbr" in before[-50:]:
            continue
        text = f'{before}<abbr title="{html.escape(meaning)}">{place.group()}</abbr>{text[place.end() :]}'
    return text


def noted(df: DataFrame, id_col: str, text_col: str, vocabulary_col: str) -> DataFrame:
    """(id, html): every text with the first place of each vocabulary word marked."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            words = [[w if isinstance(w, dict) else w.asDict() for w in (v if v is not None else [])] for v in rows["v"]]
            yield pd.DataFrame({"id": rows["id"], "html": [t if t is None else note_first(t, v) for t, v in zip(rows["t"], words)]})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(vocabulary_col).alias("v")).mapInPandas(run, f"id {id_type}, html string")


def by_length(vocabulary: Column) -> Column:
    """Longest words first; of equal ones the earlier first."""
    indexed = F.transform(vocabulary, lambda v, i: F.struct((-F.length(v["word"])).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(F.transform(indexed, lambda x: F.struct(x["n"], x["i"]))), lambda x: F.get(vocabulary, x["i"]))


def note_all(text: Column, vocabulary: Column) -> Column:
    """Marks every place of every word, longest words first, with meaning and example as the note."""

    def step(acc: Column, v: Column) -> Column:
        note = F.concat(v["definition"], F.when(F.coalesce(v["example"], F.lit("")) != "", F.concat(F.lit(" Example: "), v["example"])).otherwise(""))
        safe = F.regexp_replace(note, r"([\\$])", r"\\$1")
        return F.regexp_replace(acc, F.concat(F.lit(r"(?i)\b("), F.lit(r"\Q"), v["word"], F.lit(r"\E"), F.lit(r")\b")), F.concat(F.lit('<abbr title="'), safe, F.lit('">$1</abbr>')))

    usable = F.filter(F.coalesce(vocabulary, F.array()), lambda v: v["word"].isNotNull() & v["definition"].isNotNull())
    return F.aggregate(by_length(usable), text, step)
