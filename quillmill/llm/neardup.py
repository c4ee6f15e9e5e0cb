"""Problem 3: near-duplicate records, as a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row per document and a column per n-gram. Columns are spread over tasks in blocks; each block
multiplies its columns with themselves, so that every document pair in a column adds one to the pair's overlap. Overlaps
are summed over the blocks, and pairs below bounds that follow from the documents' sizes are discarded.

* Texts: the columns are the ``sketch`` six-word sequences of lowest hash per text. If two texts share half of their
  distinct three-word sequences, a third of their six-word sequences or more is common too, and so are about as many of the
  lowest ones. Pairs whose sketches share at least a ``SHARE``-th go to the exact Jaccard coefficient of all three-word
  sequences, over the whole texts.
* Titles: four-letter sequences of the normalised title (three-letter ones too, if it is short, and what remains of a very
  short one without any two letters) are columns; pairs with two in common, or with as many as mistyped letters leave of a
  long title, are then compared letter by letter.

All documents have their columns in one order, the most popular ones last as a top-k summary knows them. A pair that shares
enough columns shares one before the last few, so those are not multiplied. Each row brings the columns behind it as short
numbers: within a column, only documents that share one of these too are paired, and the pair is counted on the spot.

A column of more than ``wide`` documents is first multiplied with its ``hubs`` documents of lowest priority in each class of
size, the same priority in all columns. When the groups of the pairs found so far are known, it is multiplied in full, but for
pairs within one group, which would not change the groups, for texts whose three-word sequences cannot be half the same by the
slots of a hash that they take (drawn with the columns, so no text is read or moved for it), and for titles with too many letters
of their own. So ``wide`` and ``hubs`` decide on time, not on results; what
stays quadratic is a column whose documents share enough others too without belonging together (one notice in many texts).
Columns of more than SKEWED documents are spread over tasks, by every two of their parts for the full product.

Only the groups are asked for: each document's best candidate is checked first, then all candidates between different
components. Exact copies are one row of the matrix and return as members. ``wide=None`` multiplies every column in full at once.

What this can miss: a pair near the threshold whose sketches by chance share less than a ``SHARE``-th.

Defined cases: null, empty and short texts (under 40 words) and null or blank titles belong to no group; a row delivered
twice counts once (by id); the words are runs of letters and digits of the lower-cased text; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.tokens import slices
from quillmill.tables import cut_lineage

THRESHOLD, LEAST_WORDS, SHINGLE = 0.5, 40, 3
COLUMN_WORDS, SKETCH, SHARE, WIDE, HUBS, HUB_SHARE = 6, 32, 7, 64, 12, 4
TITLE_EDITS, TITLE_GRAM, SHORT_TITLE, VERY_SHORT_TITLE, TITLE_RATIO, TITLE_WIDE, TITLE_HUBS = 4, 4, 24, 12, 0.6, 16, 2
#: Items that the summary of popular columns keeps, least rows of those used, and rows from which a column is spread over tasks.
TRACKED, LISTED, SKEWED = 1 << 15, 8, 1 << 14
FILTER_SLOTS = 1 << 20
#: Characters of text hashed at once, and slots of a text's marks for each of its sequences (at least).
CHUNK, MARK_SLOTS = 1 << 17, 2
_WORD = re.compile(r"[^\W_]+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Hashes:
    """Hashes of the words (as of _WORD) of many texts at once.

    A word's hash is the sum of its characters' numbers times powers of an odd base, modulo 2^64: a difference of running
    sums, multiplied by the inverse power of the word's start.
    """

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.numbers = np.zeros(0, np.uint64)
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grow(self, chars: int, code: int) -> None:
        if code >= len(self.numbers):
            every = np.arange(1 << max(int(code).bit_length(), 12))
            inside = np.fromiter((chr(c).isalnum() for c in every.tolist()), bool, len(every))
            # No character of a word has the number 0.
            self.numbers = np.where(inside, _mixed(every + 1) | np.uint64(1), np.uint64(0))
        if chars > len(self.powers):
            size = 1 << (chars - 1).bit_length()
            self.powers, self.inverses = (np.cumprod(np.full(size, b, np.uint64)) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The words' hashes of each text, in order."""
        held, chars = [], 0
        for text in texts:
            held.append(text.lower())
            chars += len(held[-1])
            if chars > CHUNK:
                yield from self._chunk(held)
                held, chars = [], 0
        if held:
            yield from self._chunk(held)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        # A lone half of a surrogate pair belongs to no word, as it is no letter.
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self._grow(len(codes), int(codes.max()))
        numbers = self.numbers[codes]
        inside = numbers != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2] + 1, edges[1::2]
        sums = np.cumsum(numbers * self.powers[: len(codes)])
        hashes = _mixed((sums[ends] - sums[starts - 1]) * self.inverses[starts])
        return np.split(hashes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[:-1]]))) if texts else []


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(words) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for i in range(n if m > 0 else 0):
        out = (out ^ words[i : i + m]) * _MIX[i % 3]
        out ^= out >> np.uint64(29)
    return out * _MIX[0] if m > 0 else out


class _Sets(dict):
    """Sorted distinct three-word sequences of the texts met last, as joined rows repeat the text of a hub or a hot group."""

    def __init__(self) -> None:
        super().__init__()
        self.words = _Hashes()

    def learn(self, records: list, texts: list[str]) -> None:
        """Has the sets of all these records at hand."""
        if len(self) >= 512:
            self.clear()
        new = {r: t for r, t in zip(records, texts) if r not in self}
        for record, words in zip(new, self.words.of(list(new.values()))):
            self[record] = np.unique(sequence_hashes(words, SHINGLE))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    at = np.searchsorted(x, y)
    both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) else 0
    return both / max(len(x) + len(y) - both, 1)


def sketches(df: DataFrame, id_col: str, text_col: str, sketch: int = SKETCH) -> DataFrame:
    """(id, copy_key, size, columns, mark): size counts distinct three-word sequences; copies share the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in slices(batches):
            keep, keys, sizes, columns, marks = [], [], [], [], []
            for row, words in enumerate(known.of(batch.column(1).to_pylist())):
                if len(words) < LEAST_WORDS:
                    continue
                keep.append(row)
                keys.append(xxhash.xxh3_128_digest(words.tobytes()))
                ordered = np.sort(sequence_hashes(words, SHINGLE))
                sizes.append(1 + int(np.count_nonzero(ordered[1:] != ordered[:-1])))
                columns.append(_least(sequence_hashes(words, COLUMN_WORDS), sketch).view(np.int64))
                marks.append(_mark(ordered, sizes[-1]))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int32)
            flat = np.concatenate(columns) if columns else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(marks, pa.binary())], ["id", "copy_key", "size", "columns", "mark"])

    real = df.filter(F.length(text_col) >= 2 * LEAST_WORDS - 1).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return real.mapInArrow(run, "id string, copy_key binary, size int, columns array<bigint>, mark binary")


def _least(hashes: np.ndarray, number: int) -> np.ndarray:
    """The ``number`` lowest different ones, in order."""
    if len(hashes) > 8 * number:
        # Hashes are spread evenly, so twice that share of them is nearly always enough.
        low = np.unique(hashes[hashes < np.uint64(2**64 * (2 * number / len(hashes)))])
        if len(low) >= number:
            return low[:number]
    return np.unique(hashes)[:number]


def _mark(sequences: np.ndarray, size: int) -> bytes:
    """Which slots a text's sequences, ``size`` different ones, have by their hash: a bit each, 4 KB at most."""
    slots = 1 << min(max(MARK_SLOTS * size - 1, 63).bit_length(), 15)
    bits = np.zeros(slots, bool)
    bits[(sequences >> np.uint64(8)).astype(np.int64) & (slots - 1)] = True
    return np.packbits(bits).tobytes()


def popular(entries: DataFrame) -> dict[int, int]:
    """Estimated numbers of rows of the most popular columns, TRACKED columns at most (so bounded on the driver)."""
    part = entries.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(column, {TRACKED})").alias("state"))
    # By a constant, as no entries must give no summary.
    top = part.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(state, {TRACKED})").alias("state"))
    items = top.select(F.explode(F.expr(f"approx_top_k_estimate(state, {TRACKED})")).alias("i")).select("i.item", "i.count").filter(F.col("count") >= LISTED)
    return {r[0]: r[1] for r in items.collect()}


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = x.view(np.uint64) * _MIX[k]
    return (x ^ (x >> np.uint64(32))) * _MIX[(k + 1) % 3]


def _entries(known: dict[int, int], blocks: bool, skew: float):
    """Rows (doc, size, need, columns) -> (column, row, doc): the columns of a document that a pair of it can have as its first common one.

    The columns of all documents are in one order, those of ``known`` last, by number of rows. Who shares ``need`` columns
    has the first common one among all but the last need - 1 of them. The row holds the columns behind it as 16-bit numbers.
    A column of more than ``skew`` rows is
    spread: with the same hubs in each part, or, for ``blocks``, over blocks of every two parts, and nothing else comes out.
    """
    items = np.array(sorted(known), np.int64)
    counts = np.array([known[i] for i in items.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            doc, size, need = (np.asarray(batch.column(i), t) for i, t in enumerate((np.int64, np.int32, np.int64)))
            lists = batch.column(3)
            flat, ends = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths(), np.int64).cumsum()
            if not len(flat):
                continue
            k = np.diff(ends, prepend=0)
            owner = np.repeat(np.arange(len(k)), k)
            at = np.minimum(np.searchsorted(items, flat), len(items) - 1) if len(items) else np.zeros(len(flat), np.int64)
            count = np.where(items[at] == flat, counts[at], 0) if len(items) else at
            order = np.lexsort((flat, count, owner))
            flat, count = flat[order], count[order]
            behind = ends[owner] - np.arange(len(flat)) - 1
            own_need = need[owner]
            kept = np.flatnonzero((behind >= own_need - 1) & ((count > skew) | (not blocks)))
            tail = behind[kept]
            column = flat[kept].copy()
            # Parts of skewed columns: the row goes into its own, a hub into every one, or it meets every other part.
            skewed = count[kept] > skew
            parts = np.where(skewed, count[kept] // SKEWED + 1, 1)
            mine = _mixed(doc[owner[kept]])
            own = (mine % parts.astype(np.uint64)).astype(np.int64)
            hub = skewed & (mine.astype(np.float64) * count[kept] < 64 * 2.0**64)
            copies = parts if blocks else np.where(hub, parts, 1)
            other = _ranges(np.zeros(len(kept), np.int64), copies)
            kept, column, tail, skewed, own, copies_of = (np.repeat(x, copies) for x in (kept, column, tail, skewed, own, copies))
            if blocks:
                part = np.minimum(own, other) * 65536 + np.maximum(own, other)
            else:
                part = np.where(copies_of > 1, other, own)
            column = np.where(skewed, column ^ _mixed(part + 1, 1).view(np.int64), column)
            head = np.zeros((len(kept), 8), np.uint16)
            d = owner[kept]
            head[:, :4] = doc[d].view(np.uint16).reshape(-1, 4)
            head[:, 4:6] = size[d].view(np.uint16).reshape(-1, 2)
            head[:, 6], head[:, 7] = np.minimum(k[d], 65535), np.minimum(need[d], 32767) + 32768 * skewed
            out_ends = np.concatenate([[0], np.cumsum(8 + tail)])
            body = np.empty(out_ends[-1], np.uint16)
            body[out_ends[:-1, None] + np.arange(8)] = head
            short = (_mixed(flat, 2) % np.uint64(65534)).astype(np.uint16)
            body[_ranges(out_ends[:-1] + 8, tail)] = short[_ranges(kept + 1, tail)]
            rows = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer((2 * out_ends).astype(np.int32)), pa.py_buffer(body)])
            for i in range(0, len(kept), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(column[i : i + (1 << 16)]), rows.slice(i, 1 << 16), pa.array(doc[d[i : i + (1 << 16)]])][: 2 + blocks], ["column", "row", "doc"][: 2 + blocks])

    return run


class _Rows:
    """Rows of a block as arrays; tails are padded by 65534."""

    def __init__(self, rows: pa.Array, column: np.ndarray, label: np.ndarray | None = None, mark: pa.Array | None = None, edits: int | None = None) -> None:
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64) // 2
        body = np.frombuffer(rows.buffers()[2], np.uint16, ends[-1])
        head = body[ends[:-1, None] + np.arange(8)]
        self.doc, self.size = head[:, :4].copy().view(np.int64)[:, 0], head[:, 4:6].copy().view(np.int32)[:, 0].astype(np.int64)
        self.k, self.need, self.skewed = head[:, 6].astype(np.int64), (head[:, 7] & 32767).astype(np.int64), head[:, 7] >= 32768
        self.tail = np.diff(ends) - 8
        self.short = np.full((len(rows), max(int(self.tail.max(initial=0)), 1)), 65534, np.uint16)
        self.short[np.repeat(np.arange(len(rows)), self.tail), _ranges(np.zeros(len(rows), np.int64), self.tail)] = body[_ranges(ends[:-1] + 8, self.tail)]
        self.run = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        self.label = self.doc if label is None else label
        self.letters, self.edits = letter_counts(mark) if mark is not None and edits is not None else None, edits
        self.marks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.slots = np.zeros(len(rows), np.int64)
        if mark is None or edits is not None:
            return
        self.slots = 8 * np.asarray(pc.binary_length(mark).fill_null(0), np.int64)
        finer = None
        for slots in sorted(set(self.slots[self.slots > 0].tolist()), reverse=True):
            # A row's slots are halved by laying them over one another, for pairs with a text of fewer slots.
            own = np.flatnonzero(self.slots == slots)
            table = np.frombuffer(b"".join(mark.take(pa.array(own)).to_pylist()), np.uint64).reshape(len(own), slots // 64)
            if finer is not None:
                above, more = finer
                while more.shape[1] > slots // 64:
                    more = more[:, : more.shape[1] // 2] | more[:, more.shape[1] // 2 :]
                near = self.slots[above] <= 4 * slots
                own, table = np.concatenate([own, above[near]]), np.concatenate([table, more[near]])
            finer = own, table
            row_in = np.full(len(rows), -1)
            row_in[own] = np.arange(len(own))
            self.marks[slots] = table, row_in, np.bitwise_count(table).sum(axis=1, dtype=np.int64)

    def possible(self, p: np.ndarray, q: np.ndarray, ratio: float) -> np.ndarray:
        """Whether the marks leave room for a pair.

        Texts have in common at most one sequence for each slot of both, and as many as either has beyond one a slot. Each
        mistyped letter of a title changes the numbers of letters by two.
        """
        good = np.ones(len(p), bool)
        if self.letters is not None:
            for b in range(0, len(p), 1 << 14):
                x, y = self.letters[p[b : b + (1 << 14)]], self.letters[q[b : b + (1 << 14)]]
                good[b : b + (1 << 14)] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64) <= 2 * self.edits
        both = np.minimum(self.slots[p], self.slots[q])
        for slots, (table, row_in, taken) in self.marks.items():
            at = np.flatnonzero(both == slots)
            i, j = row_in[p[at]], row_in[q[at]]
            at, i, j = (x[(i >= 0) & (j >= 0)] for x in (at, i, j))
            beyond = self.size[p[at]] - taken[i], self.size[q[at]] - taken[j]
            for b in range(0, len(at), 8192):
                a = at[b : b + 8192]
                most = np.bitwise_count(table[i[b : b + 8192]] & table[j[b : b + 8192]]).sum(axis=1, dtype=np.int64) + np.minimum(*(x[b : b + 8192] for x in beyond))
                good[a] = most * (1 + ratio) + 1e-6 >= ratio * (self.size[p[a]] + self.size[q[a]])
        return good

    def close(self, p: np.ndarray, q: np.ndarray, ratio: float, share: int) -> pa.RecordBatch:
        """(kind 0, x, y, n) of those pairs that can be alike, n being their common columns from here on."""
        x, y = self.size[p], self.size[q]
        fit = (np.minimum(x, y) >= ratio * np.maximum(x, y)) & (self.label[p] != self.label[q]) & (self.doc[p] != self.doc[q])
        p, q = p[fit], q[fit]
        if self.marks or self.letters is not None:
            fit = self.possible(p, q, ratio)
            p, q = p[fit], q[fit]
        n = np.ones(len(p), np.int32)
        for i in range(0, len(p), 1 << 15):
            v, w = self.short[p[i : i + (1 << 15)]], self.short[q[i : i + (1 << 15)]]
            w[w == 65534] = 65535
            for j in range(w.shape[1]):
                n[i : i + (1 << 15)] += (v == w[:, j : j + 1]).any(axis=1)
        least = -(-np.minimum(self.k[p], self.k[q]) // share) if share else np.maximum(self.need[p], self.need[q])
        fit = n >= least
        x, y = self.doc[p[fit]], self.doc[q[fit]]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int8)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(n[fit]), pa.nulls(len(x), pa.binary())], ["kind", "x", "y", "n", "row"])

    def every(self, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows ``among`` with this column and a further one in common and of different labels."""
        first = np.minimum(self.tail[among] - self.need[among] + 2, self.tail[among])
        owner = np.repeat(among, first)
        key = self.run[owner] << 17 | self.short[owner, _ranges(np.zeros(len(among), np.int64), first)]
        # Where one common column is enough, there is no second one to meet in.
        alone = among[self.need[among] == 1]
        owner, key = np.concatenate([owner, alone]), np.concatenate([key, self.run[alone] << 17 | 65536])
        order = np.lexsort((self.label[owner], key))
        owner, key = owner[order], key[order]
        label = self.label[owner]
        new_key = np.concatenate([key[1:] != key[:-1], [True]])[: len(key)]
        new_label = new_key | np.concatenate([label[1:] != label[:-1], [True]])[: len(key)]
        ends, own_ends = np.flatnonzero(new_key) + 1, np.flatnonzero(new_label) + 1
        here = np.arange(len(key))
        end, start = ends[np.searchsorted(ends, here, "right")], own_ends[np.searchsorted(own_ends, here, "right")]
        total = np.concatenate([[0], np.cumsum(end - start)])
        for base in range(0, int(total[-1]), 1 << 20):
            # Pairs base .. base + 2^20 of the list of all.
            number = np.arange(base, min(base + (1 << 20), total[-1]))
            i = np.searchsorted(total, number, "right") - 1
            p, q = owner[i], owner[start[i] + number - total[i]]
            code = np.unique(np.minimum(p, q) * len(self.doc) + np.maximum(p, q))
            yield code // len(self.doc), code % len(self.doc)

    def hubs(self, among: np.ndarray, ratio: float, hubs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows ``among`` and the hubs of lowest priority of their column in their own and the neighbouring classes of size."""
        level = np.floor(np.log(np.maximum(self.size[among], 1)) / -math.log(ratio)).astype(np.int64)
        key = self.run[among] * 256 + level + 1
        order = np.lexsort((_mixed(self.doc[among]), key))
        among, key = among[order], key[order]
        for step in (-1, 0, 1):
            start, end = np.searchsorted(key, key + step), np.searchsorted(key, key + step, "right")
            for h in range(hubs):
                has = start + h < end
                yield among[has], among[(start + h)[has]]


def _multiply(wide: int | None, hubs: int, ratio: float, share: int, edits: int | None = None):
    """Multiplies the columns of one block; rows (column, row[, label[, mark]]) come sorted by column.

    Pairs come out as kind 0. Columns of more than ``wide`` rows are multiplied with their hubs only, and their rows come
    out as kind 1 with the column in x. With ``wide`` None every column is multiplied in full.
    """

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        column = np.asarray(table.column(0).combine_chunks(), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]])
        length = np.repeat(np.diff(edges), np.diff(edges))
        shared = np.flatnonzero(length > 1)
        if not len(shared):
            return
        table, column, length = table.take(pa.array(shared)), column[shared], length[shared]
        coded = pa.concat_arrays(table.column(1).chunks)
        rows = _Rows(coded, column, np.asarray(table.column(2).combine_chunks(), np.int64) if table.num_columns > 2 else None, table.column(3).combine_chunks() if table.num_columns > 3 else None, edits)
        is_wide = length > wide if wide is not None else np.zeros(len(length), bool)
        for p, q in rows.every(np.flatnonzero(~is_wide)):
            yield rows.close(p, q, ratio, share)
        if is_wide.any():
            for p, q in rows.hubs(np.flatnonzero(is_wide), ratio, hubs):
                yield rows.close(p, q, ratio, HUB_SHARE if share else 0)
            left = np.flatnonzero(is_wide & ~rows.skewed)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(left), np.int8)), pa.array(column[left]), pa.array(rows.doc[left]), pa.array(np.zeros(len(left), np.int32)), coded.take(pa.array(left))], ["kind", "x", "y", "n", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            column = np.asarray(batch.column(0), np.int64)
            cut = int(np.searchsorted(column, column[-1]))
            # The last column may go on in the next batch.
            if held and (cut or held[-1].column(0)[-1].as_py() != column[-1]):
                yield from block(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from block(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from block(pa.Table.from_batches(held))

    return run


def _product(rows: DataFrame, wide: int | None, hubs: int, ratio: float, share: int, edits: int | None = None) -> DataFrame:
    out = rows.repartition("column").sortWithinPartitions("column").mapInArrow(_multiply(wide, hubs, ratio, share, edits), "kind tinyint, x bigint, y bigint, n int, row binary")
    return cut_lineage(out)


def _pairs(out: DataFrame) -> DataFrame:
    return out.filter("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max("n").alias("n"))


def overlaps(docs: DataFrame, ratio: float, share: int, wide: int | None = WIDE, hubs: int = HUBS, marks: DataFrame | None = None, edits: int | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame | None]]:
    """docs (doc, size, need, columns) -> candidate pairs (a, b, n), and what finds the rest once components are known.

    The first has all candidates of columns of up to ``wide`` rows and those with hubs of the others. The second takes
    labels (doc, label) and returns all candidates of the other columns whose ends have different labels, or None.
    There, ``marks`` (doc, mark) rule out pairs that cannot reach ``ratio``; for titles they are the keys, which rule out
    pairs that are more than ``edits`` mistyped letters apart.
    A candidate shares a ``share``-th of the columns of the shorter list, or as many as either needs if ``share`` is 0. Texts
    that share less than a HUB_SHARE-th with a hub are left to the second.
    """
    docs = docs.select("doc", "size", "need", "columns")
    known = popular(docs.select(F.explode("columns").alias("column")))
    skew = math.inf if wide is None else SKEWED
    first = _product(docs.mapInArrow(_entries(known, False, skew), "column bigint, row binary"), wide, hubs, ratio, share)

    def rest(labels: DataFrame) -> DataFrame | None:
        wide_rows = first.filter("kind = 1").select(F.col("x").alias("column"), F.col("y").alias("doc"), "row")
        if max(known.values(), default=0) > skew:
            blocks = docs.mapInArrow(_entries(known, True, skew), "column bigint, row binary, doc bigint")
            wide_rows = wide_rows.unionByName(blocks)
        elif wide_rows.isEmpty():
            return None
        labelled = wide_rows.join(labels, "doc", "left").select("column", "row", F.coalesce("label", "doc").alias("label"), "doc")
        labelled = labelled.join(marks, "doc", "left").drop("doc") if marks else labelled.drop("doc")
        return _pairs(_product(labelled, None, hubs, ratio, share, edits))

    return _pairs(first), rest


def merged(labels: DataFrame | None, pairs: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs (id_a, id_b, n) -> (id, label): components of ``labels`` and the pairs that ``check`` keeps.

    Every record's pair of greatest n is checked first; then all pairs whose ends are still in different components.
    """
    ends = pairs.select(F.col("id_a").alias("id"), F.struct("n", F.col("id_b").alias("other")).alias("p")).unionByName(pairs.select(F.col("id_b").alias("id"), F.struct("n", F.col("id_a").alias("other")).alias("p")))
    best = ends.groupBy("id").agg(F.max_by("p.other", "p").alias("other"))
    best = cut_lineage(best.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct())
    labels = components(check(best)) if labels is None else _joined(labels, best, check)
    return _joined(labels, pairs.join(best, ["id_a", "id_b"], "left_anti"), check)


def _joined(labels: DataFrame, pairs: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """labels (id, label) with those components made one that a pair of ``pairs`` joins."""
    x, y = (labels.select(F.col("id").alias(f"id_{s}"), F.col("label").alias(f"label_{s}")) for s in "ab")
    own = lambda s: F.coalesce(f"label_{s}", f"id_{s}")
    rest = pairs.join(x, "id_a", "left").join(y, "id_b", "left").filter(own("a") != own("b"))
    rest = cut_lineage(rest.select("id_a", "id_b", own("a").alias("label_a"), own("b").alias("label_b")))
    if rest.isEmpty():
        return labels
    more = cut_lineage(check(rest.select("id_a", "id_b")).withColumnsRenamed({"a": "id_a", "b": "id_b"}).join(rest, ["id_a", "id_b"]))
    if more.isEmpty():
        return labels
    joined = components(more.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    own_ids = more.select(F.col("id_a").alias("id"), F.col("label_a").alias("label")).union(more.select("id_b", "label_b"))
    every = labels.unionByName(own_ids).distinct()
    return cut_lineage(every.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of strings -> (id, label): label is the least id of the component."""
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).select(both["a"].alias("id"), "label")
        # Pointer jumping: the label of one's label halves the distance to the least id.
        jumped = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.id")).select(F.col("x.id").alias("id"), F.col("y.label").alias("label"))
        new = labels.unionByName(heard).unionByName(jumped).groupBy("id").agg(F.min("label").alias("label"))
        new = cut_lineage(new)
        moved = new.join(labels, ["id", "label"], "left_anti").isEmpty()
        labels = new
        if moved:
            return labels


def group_pairs(members: DataFrame) -> DataFrame:
    """members (id, label) -> (id_a, id_b): all pairs of each group, as the task's result form asks."""
    x, y = members.alias("x"), members.alias("y")
    return x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))


def with_copies(drawn: DataFrame, reps: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(id, label) of all rows of ``drawn`` (id, keys) whose representative has copies or a group; reps is (keys, rep, copied)."""
    own = reps.select(*keys, "rep", "copied").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").filter(F.col("copied") | F.col("label").isNotNull())
    return drawn.select("id", *keys).join(own, keys).select("id", F.coalesce("label", "rep").alias("label")).distinct()


def text_groups(df: DataFrame, id_col: str = "id", text_col: str = "content", threshold: float = THRESHOLD, sketch: int = SKETCH, wide: int | None = WIDE, hubs: int = HUBS) -> DataFrame:
    """(id, label) of all texts that belong with another one, copies included. ``wide=None`` multiplies every column in full."""
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    drawn = cut_lineage(sketches(texts, "id", "text", sketch).withColumn("doc", F.xxhash64("id")))
    reps = representatives(drawn)
    # A text half as long has as many distinct six-word sequences as three-word ones, less three; its columns are no fewer.
    fewest = F.least(F.size("columns"), F.greatest(F.ceil(F.col("size") * threshold).cast("int") - 3, F.lit(1)))
    docs = reps.select("doc", "size", F.ceil(fewest / SHARE).cast("int").alias("need"), "columns")
    # An id that came with different texts has no mark.
    marks = reps.groupBy("doc").agg(F.when(F.count(F.lit(1)) == 1, F.first("mark")).alias("mark"))
    close, rest = overlaps(docs, threshold, SHARE, wide, hubs, marks)
    named = lambda p: cut_lineage(p.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "n"))
    check = lambda p: verified(p, texts.withColumn("id", F.xxhash64("id")), threshold)
    labels = merged(None, named(close), check)
    more = rest(labels.select(F.col("id").alias("doc"), "label"))
    if more is not None:
        more = named(more)
        labels = labels if more.isEmpty() else merged(labels, more, check)
    # Labels of numbers become the least id of their group.
    names = reps.select("copy_key", "doc", F.col("id").alias("rep"), "copied")
    by_id = cut_lineage(labels.withColumnRenamed("id", "doc").join(names.select("doc", F.col("rep").alias("id")).distinct(), "doc"))
    least = by_id.groupBy("label").agg(F.min("id").alias("least"))
    return with_copies(drawn, names, by_id.join(least, "label").select("id", F.col("least").alias("label")), ["copy_key"])


def representatives(drawn: DataFrame) -> DataFrame:
    """drawn (id, doc, copy_key, ...) -> one row for each key, that of the least id, and whether it was ``copied``.

    A filter of at most FILTER_SLOTS numbers keeps most rows whose key no other row has out of the shuffle.
    """
    slot = F.pmod(F.xxhash64("copy_key"), F.lit(FILTER_SLOTS)).cast("int").alias("slot")
    repeated = cut_lineage(drawn.groupBy("copy_key").count().filter("count > 1").select(slot).distinct())
    columns = [c for c in drawn.columns if c != "copy_key"]
    single = drawn.withColumn("slot", slot).join(F.broadcast(repeated), "slot", "left_anti").select("copy_key", *columns, F.lit(False).alias("copied"))
    several = drawn.withColumn("slot", slot).join(F.broadcast(repeated), "slot", "left_semi").groupBy("copy_key")
    several = several.agg(F.min(F.struct(*columns)).alias("r"), F.max("id").alias("greatest")).select("copy_key", "r.*", (F.col("greatest") != F.col("r.id")).alias("copied"))
    return single.unionByName(several)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard over all three-word sequences of the whole texts; keeps (a, b) of at least the threshold."""
    wanted = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct()
    # A filter of at most FILTER_SLOTS numbers keeps most texts without a candidate out of the shuffle.
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_SLOTS)).cast("int").alias("slot")
    likely = texts.withColumn("slot", slot).join(F.broadcast(cut_lineage(wanted.select(slot).distinct())), "slot", "left_semi").filter("text IS NOT NULL").drop("slot")
    own = likely.dropDuplicates(["id"])
    x, y = own.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), own.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for batch in (s.slice(i, 256) for s in slices(batches) for i in range(0, s.num_rows, 256)):
            i, j, p, q = (batch.column(k).to_pylist() for k in range(4))
            sets.learn(i + j, p + q)
            good = [jaccard(sets[a], sets[b]) >= threshold for a, b in zip(i, j)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])

    joined = pairs.join(x, "id_a").join(y, "id_b").select("id_a", "id_b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint, good boolean").filter("good").select("a", "b")


# Titles ------------------------------------------------------------------------------------------------------------

_ACCENTED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1]
_NUMBERS = "one two three four five six seven eight nine ten i ii iii iv v vi vii viii ix x"
_NOTE = r"(?:(?:\w+ ){0,3}edition|(?:un)?abridged(?: \w+)?|(?:fully )?illustrated(?: \w+)?|annotated(?: \w+)?|large print(?: \w+)?|revised(?: \w+)?|reprint(?:ed)?|paperback|hardcover|hardback|e-?book|audiobook|anniversary(?: \w+)?)"


def title_key(title: Column) -> Column:
    """STRUCT<words, key, volume>: the title in plain letters without notes, articles at its ends and punctuation; key without blanks."""
    plain = F.translate(title, "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED))
    plain = F.regexp_replace(F.lower(F.regexp_replace(plain, r"[̀-ͯ]", "")), r"[\s\u0085   -​    　﻿]+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[.\s!?]+$", ""), r"^\s+", "")
    # A bracket without a number at the end, or what follows a slash, is a note however it is spelt.
    plain = F.regexp_replace(plain, r"(?<=\S)\s*(?:[(\[{][^()\[\]{}0-9]*[)\]}]|\s/\s[^/0-9]*)\s*$", "")
    plain = F.regexp_replace(plain, rf"\s*[-–—:/,;|]\s*(?:an? |the )?{_NOTE}\s*$", "")
    volume_pattern = rf"[\s,:;(\[–—-]+(?:(?:book|volume|vol\.?|part|number|no\.?|#)\s*)(\d{{1,4}}|{'|'.join(_NUMBERS.split())})[)\]]?$|\s(\d{{1,3}})$"
    volume = F.concat(F.regexp_extract(plain, volume_pattern, 1), F.regexp_extract(plain, volume_pattern, 2))
    words = _NUMBERS.split()
    numbers = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, str(i % 10 + 1))])
    volume = F.coalesce(numbers[volume], F.regexp_replace(volume, "^0+", ""))
    bare = F.regexp_replace(plain, volume_pattern, "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^(?:the|an?) ", ""), r", ?(?:the|an?)$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[&+]", " and "), r"\b(?:from|by)\b", "of")
    words = F.trim(F.regexp_replace(F.regexp_replace(bare, "['’]", ""), r"[^\p{L}\p{N}]+", " "))
    return F.struct(words.alias("words"), F.replace(words, F.lit(" "), F.lit("")).alias("key"), volume.alias("volume"))


def letter_edits(a: str, b: str) -> int:
    """Inserted, lost, changed and swapped neighbouring letters between two words."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


def same_title(a: str, b: str, edits: int = TITLE_EDITS) -> bool:
    """At most ``edits`` mistyped letters in all, and in each word few enough to leave it the same word."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return letter_edits(a.replace(" ", ""), b.replace(" ", "")) <= min(edits, 2)
    left = edits
    for v, w in zip(x, y):
        if v != w:
            d = letter_edits(v, w)
            left -= d
            # A short word of which two letters are changed is another word; doubled or lost letters leave it.
            if left < 0 or d > max(1, max(len(v), len(w)) // 3 + (len(v) != len(w))):
                return False
    return True


def title_columns(key: Column, volume: Column, edits: int = TITLE_EDITS) -> Column:
    """ARRAY<BIGINT>: columns of a title. Two common ones make a candidate."""
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(n)))
    without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    # A very short title meets all that are two lost, changed or swapped letters away: any two of its letters are left out.
    once = F.array_append(without(key), key)
    left = F.array_distinct(F.flatten(F.transform(once, lambda t: F.array_append(F.when(F.length(t) > 1, without(t)).otherwise(F.array().cast("array<string>")), t))))
    twice = F.flatten(F.transform(left, lambda t: F.array(F.concat(t, F.lit("\x011")), F.concat(t, F.lit("\x012")))))
    none = F.array().cast("array<string>")
    size = F.length(key)
    every = F.concat(grams(TITLE_GRAM), F.when(size <= SHORT_TITLE, grams(TITLE_GRAM - 1)).otherwise(none), F.when(size <= VERY_SHORT_TITLE, twice).otherwise(none))
    return F.array_distinct(F.transform(every, lambda g: F.xxhash64(g, volume)))


def letter_counts(keys: pa.Array) -> np.ndarray:
    """Numbers of letters of each key by the last five bits of their code points, a row each."""
    every = [k.decode() for k in keys.to_pylist()]
    codes = np.frombuffer("".join(every).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    owner = np.repeat(np.arange(len(every)), [len(k) for k in every])
    return np.bincount(owner * 32 + codes, minlength=len(every) * 32).astype(np.int16).reshape(-1, 32)


def title_groups(df: DataFrame, id_col: str = "id", title_col: str = "title", edits: int = TITLE_EDITS, wide: int | None = TITLE_WIDE, hubs: int = TITLE_HUBS) -> DataFrame:
    """(id, label) of all titles that are another one's, written the same or differently."""
    keyed = df.filter(F.col(title_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), title_key(F.col(title_col)).alias("k")).select("id", "k.*")
    keyed = cut_lineage(keyed.filter("key <> ''").dropDuplicates(["id"]))
    reps = cut_lineage(keyed.groupBy("key", "volume").agg(F.min("id").alias("rep"), F.min("words").alias("words"), (F.max("id") != F.min("id")).alias("copied")).withColumn("doc", F.xxhash64("key", "volume")))
    cut_up = reps.select("doc", F.length("key").alias("size"), title_columns(F.col("key"), F.col("volume"), edits).alias("columns"))
    marks = reps.select("doc", F.col("key").cast("binary").alias("mark"))
    # A mistyped letter, or two swapped, changes five four-letter sequences at most.
    need = F.when(F.col("size") > SHORT_TITLE + edits, F.greatest(F.size("columns") - 5 * edits, F.lit(2))).otherwise(2)
    near, rest = overlaps(cut_lineage(cut_up.withColumn("need", need)), TITLE_RATIO, 0, wide, hubs, marks, edits)
    x, y = (reps.select(F.col("doc").alias(s), F.col("key").alias(f"key_{s}"), F.col("words").alias(f"words_{s}"), F.col("volume").alias(f"volume_{s}"), F.col("rep").alias(f"rep_{s}")) for s in "ab")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [same_title(s, t, edits) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])

    def linked(pairs: DataFrame) -> DataFrame:
        close = pairs.join(x, "a").join(y, "b").filter("volume_a = volume_b").filter(F.abs(F.length("key_a") - F.length("key_b")) <= edits)
        # A swap counts two here; the exact count of mistyped letters follows.
        close = close.filter(F.levenshtein("key_a", "key_b", 2 * edits) >= 0).select("rep_a", "rep_b", "words_a", "words_b")
        return cut_lineage(close.mapInArrow(exact, "a string, b string, good boolean").filter("good").select("a", "b"))

    links = linked(near)
    labels = components(links)
    by_rep = labels.join(reps.select(F.col("rep").alias("id"), "doc"), "id").select("doc", F.xxhash64("label").alias("label"))
    more = rest(by_rep)
    if more is not None:
        more = linked(more)
        labels = labels if more.isEmpty() else components(links.unionByName(more))
    return with_copies(keyed, reps, labels, ["key", "volume"])


def found(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Query p3_found: (field, id_a, id_b)."""
    content = group_pairs(text_groups(chapters)).select(F.lit("content").alias("field"), "id_a", "id_b")
    title = group_pairs(title_groups(books)).select(F.lit("title").alias("field"), "id_a", "id_b")
    return content.unionByName(title)


def membership(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Query p3_groups: (field, id, group_id) of every record that belongs to a group."""
    content = text_groups(chapters).select(F.lit("content").alias("field"), "id", F.col("label").alias("group_id"))
    return content.unionByName(title_groups(books).select(F.lit("title").alias("field"), "id", F.col("label").alias("group_id")))
