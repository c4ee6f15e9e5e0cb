"""Problem 1: cutting oversized texts into pieces at natural boundaries, with an overlap.

Words are longest runs of characters that are not Unicode white space. For each oversized text the word offsets and the
word numbers at which paragraphs and sentences end are built once as sorted arrays; every cut is a binary search for the
last boundary under the limit, then a step back by the overlap. Without a boundary in reach the cut is hard, at the limit.

Order of preference in the reach of a piece: a blank line; a closing block tag of markup or a line break after a
closing mark; the end of a sentence; the limit. A boundary counts only if the piece brings words beyond the overlap.

Defined cases: null, empty and short texts give no pieces; a row delivered twice gives its pieces twice from ``pieces``
(the queries remove repeats by id); the stored word_count is never read; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.tokens import slices

LIMIT, OVERLAP = 800, 50
_WHITE = np.zeros(0x110000, bool)
_WHITE[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
#: Marks that close a sentence, signs that may follow them, signs that may open the next one.
_STOPS = ".!?…。！？।؟۔"
_CLOSERS = "\"'”’»)]}›」』）"
_OPENERS = "\"'“‘«([{‹「『（—–-¿¡„"
_ENDS = re.compile(rf"[{re.escape(_STOPS)}][{re.escape(_CLOSERS)}]*(?:</[a-z]+>)*$")
_SHORT = {"mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "no", "vol", "fig", "ch", "pp", "p", "approx", "capt", "mt", "co", "inc", "dept", "rev", "gen", "col", "e.g", "i.e", "cf"}
_BLOCK = re.compile(r"</(?:p|div|h[1-6]|li|section|blockquote)>$")


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of every word, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = np.concatenate([[False], ~_WHITE[points], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[0::2], edges[1::2]


def _sentence_end(word: str, following: str) -> bool:
    if not _ENDS.search(word):
        return False
    bare = word.strip(_CLOSERS + _OPENERS)
    if bare.endswith("."):
        stem = bare[:-1].lower()
        if stem in _SHORT or (len(stem) == 1 and stem.isalpha() and stem != "i"):
            return False
    lead = following.lstrip(_OPENERS)[:1]
    return not lead.islower()


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word numbers after which a blank line, a lesser paragraph break, and a sentence end lie."""
    strong, weak, sentence = [], [], []
    n = len(starts)
    gaps = np.flatnonzero(starts[1:] - ends[:-1] > 1) + 1
    wide = {int(k): text[ends[k - 1] : starts[k]].count("\n") for k in gaps}
    newline = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
    after = np.searchsorted(ends, newline, side="right")
    single = {int(k) for k in after if 0 < k < n}
    for k in range(1, n):
        last = text[starts[k - 1] : ends[k - 1]]
        tail = last[-1]
        if wide.get(k, 0) >= 2:
            strong.append(k)
        elif tail == ">" and _BLOCK.search(last):
            weak.append(k)
        elif tail in _STOPS or tail in _CLOSERS or tail == ">":
            if _sentence_end(last, text[starts[k] : ends[k]]):
                (weak if k in single else sentence).append(k)
    return np.asarray(strong, np.int64), np.asarray(weak, np.int64), np.asarray(sentence, np.int64)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first word, word after the last) of every piece; [] where the text is within the limit."""
    starts, ends = word_spans(text)
    n = len(starts)
    if n <= limit:
        return []
    levels = boundaries(text, starts, ends)
    out, begin, fresh = [], 0, 0
    while n - begin > limit:
        stop = begin + limit
        for level in levels:
            k = int(np.searchsorted(level, stop, side="right")) - 1
            if k >= 0 and level[k] > fresh and level[k] - begin > overlap:
                stop = int(level[k])
                break
        out.append((begin, stop))
        fresh, begin = stop, stop - overlap
    out.append((begin, n))
    return out


SCHEMA = "id {}, piece_no int, start_pos int, end_pos int, first_word int, word_count int, piece string"


def pieces(df: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each text of more than ``limit`` words; start_pos and end_pos are code-point offsets.

    Texts too short to hold more than ``limit`` words are dropped in the scan, before Python sees them.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece_no", "start_pos", "end_pos", "first_word", "word_count", "piece"]
        for batch in slices(batches):
            rows: list[list] = [[] for _ in names[1:]]
            owner: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                spans = cut(text, limit, overlap)
                if not spans:
                    continue
                starts, ends = word_spans(text)
                for number, (a, b) in enumerate(spans):
                    owner.append(row)
                    p, q = int(starts[a]), int(ends[b - 1])
                    for column, value in zip(rows, (number, p, q, a, b - a, text[p:q])):
                        column.append(value)
            ids = batch.column(0).take(pa.array(owner, pa.int32()))
            kinds = [pa.int32()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rows, kinds))], names)

    long = df.filter(F.length(text_col) > 2 * limit).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return long.mapInArrow(run, SCHEMA.format(id_type))


def oversized(chapters: DataFrame) -> DataFrame:
    """Query p1_found: (chapter_id) of the chapters that the operator cuts, each once."""
    return pieces(chapters).filter("piece_no = 0").select(F.col("id").alias("chapter_id")).distinct()


def chapter_pieces(chapters: DataFrame) -> DataFrame:
    """Query p1_pieces: every piece of the oversized chapters, each chapter once."""
    return pieces(chapters.dropDuplicates(["id"])).withColumnRenamed("id", "chapter_id")
