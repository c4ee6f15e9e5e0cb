"""Problem 6: encoding a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works on code-point class arrays: runs of one class are found with shifted comparisons, so no
regular expression walks the text and no scan is needed. The resulting slices go through a cache of merged pieces.
Byte offsets of the tokens can be kept, so every slice of the text can be decoded again.

Defined cases: null text and empty text give an empty list; rows are kept one for one, repeated rows included; extra
columns do not matter, only ``id_col`` and ``text_col`` are read. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Pieces kept ready merged in each worker; the cache starts anew when full, so its memory has a bound.
CACHE_PIECES = 300_000
LONG_PIECE = 64

_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
_encoders: dict[int, "Encoder"] = {}


def classes() -> np.ndarray:
    """The class of each code point, built once a process."""
    global _classes
    if _classes is None:
        first = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[_WHITE] = SPACE
        _classes = table
    return _classes


def piece_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start positions of all pre-tokens in the joined code points of many texts.

    ``doc_starts`` holds the position of the first code point of each non-empty text.
    """
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    last_of_run = np.ones(n, bool)
    last_of_run[:-1] = run[1:]
    doc_end = np.ones(n, bool)
    doc_end[:-1] = first[1:]
    white = kind == SPACE
    # The last white character before a word is split from its run: a blank joins the word, any other stands alone.
    before_word = white & last_of_run & ~doc_end
    blank = before_word & (points == 0x20)
    start = run.copy()
    start |= before_word
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1]
    start &= ~joined
    # Contractions: an apostrophe that is a run of its own, opens a piece, and is followed by the given letters.
    quote = np.flatnonzero((points == 0x27) & run & last_of_run & start & ~doc_end)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        two_left = np.zeros(len(quote), bool)
        inside = quote + 2 < n
        two_left[inside] = ~first[quote[inside] + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = two_left & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        hit = one | two
        at = quote[hit]
        width = np.where(one[hit], 2, 3)
        start[at + 1] = False
        after = at + width
        keep = after < n
        start[after[keep]] = True
    return np.flatnonzero(start)


class Encoder:
    """Byte-pair merging over a rank file, with a bounded cache of merged pieces."""

    def __init__(self, rank_file: bytes):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        size = max(self.ranks.values()) + 1
        self.widths = np.zeros(size, np.int32)
        for token, rank in self.ranks.items():
            self.widths[rank] = len(token)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge_long(piece) if len(piece) > LONG_PIECE else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == 1 << 30:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
        return tuple(self.ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges from a heap over a linked list: n log n for runs without any blank."""
        get, n = self.ranks.get, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            k = before[i]
            if k >= 0 and (r := get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and the offsets of each text in it."""
        full = [t or "" for t in texts]
        lengths = np.fromiter(map(len, full), np.int64, len(full))
        offsets = np.zeros(len(full) + 1, np.int64)
        joined = "".join(full)
        if not joined:
            return np.zeros(0, np.int32), offsets
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        starts_of_docs = (ends - lengths)[lengths > 0]
        cuts = piece_starts(points, starts_of_docs)
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache, out = self.cache, []
        bounds = cuts.tolist()
        bounds.append(len(joined))
        sizes = []
        for a, b in zip(bounds, bounds[1:]):
            piece = joined[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= LONG_PIECE:
                    cache[piece] = ids
            out += ids
            sizes.append(len(ids))
        tokens_up_to = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        offsets[1:] = tokens_up_to[np.searchsorted(cuts, ends, side="left")]
        return np.asarray(out, np.int32), offsets


def encoder(key: int, rank_file: bytes) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(os.path.realpath(path), "rb") as file:
        return file.read()


def slices(batches: Iterator[pa.RecordBatch], most_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one holds about ``most_chars`` bytes of text in its last column, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0), np.int64)
        groups = np.cumsum(sizes) // most_chars if len(sizes) else sizes
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids ARRAY<INT>[, byte_starts ARRAY<INT>]) of every row. The vocabulary (under 1 MB) is broadcast from the driver."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    key = hash((vocabulary, len(sent.value)))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(key, sent.value)
        for batch in slices(batches):
            ids, ends = enc.encode_batch(batch.column(1).to_pylist())
            arrays = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))]
            if offsets:
                widths = enc.widths[ids]
                begin = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
                own = np.repeat(begin[ends[:-1]], np.diff(ends))
                arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((begin[:-1] - own).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, ["id", "ids", "byte_starts"][: len(arrays)])

    schema = f"id {id_type}, ids array<int>" + ", byte_starts array<int>" * offsets
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens INT): the lengths alone, without sending the ids back to the JVM."""
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    key = hash((vocabulary, len(sent.value)))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(key, sent.value)
        for batch in slices(batches):
            _, ends = enc.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int32))], ["id", "n_tokens"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens int")


def corpus_ids(spark: SparkSession, documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Query p6_ids: (doc_id, ids)."""
    return encode(documents, vocabulary=vocabulary).select(F.col("id").alias("doc_id"), "ids")
