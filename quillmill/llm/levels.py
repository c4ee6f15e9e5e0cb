"""Problem 4: the reading level of each text, from a sentence classifier with character and word features.

A multinomial logistic model, L2-regularised, is fitted on the sentences of the labelled passages. A sentence's features
are the means over its words of hashed word and character n-gram indicators; hence a word adds one fixed vector of three
numbers, kept per distinct word, and scoring a text is a lookup and a sum per sentence. Sentence probabilities, weighted by
words, add up to the distribution of a chapter or a book, so that a book needs only sums, taken before the shuffle. The
distribution becomes a difficulty between 0 and 2, whose two cut points are calibrated on the labelled passages.

Defined cases: null, empty and wordless texts have no level (chapters: no row; books without such chapters: no row); rows
of a chapter delivered twice count once; a text without closing marks is taken in stretches of 30 words; unknown or
missing statements (null, empty, ``unknown``, ``all ages``) contradict nothing; extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.tokens import slices

LEVELS = ["beginner", "intermediate", "advanced"]
FEATURES, GRAMS, STRETCH = 4096, (3, 4), 30
#: Most labelled passages that are fitted on.
MOST_SAMPLES = 5000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?。！？।؟]+")
_MARKS = set(".!?。！？।؟")


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word: itself and the character sequences of its bounded form."""
    bounded = f"<{word}>"
    parts = [f"w:{word}"] * 2 + [bounded[i : i + n] for n in GRAMS for i in range(len(bounded) - n + 1)]
    return [zlib.crc32(p.encode()) % FEATURES for p in parts]


def _segments(text: str) -> tuple[list[str], np.ndarray]:
    """Words of a text, and the number of the sentence that each is in."""
    tokens = _TOKEN.findall(text.lower())
    marks = np.fromiter((t[0] in _MARKS for t in tokens), bool, len(tokens))
    sentence = np.cumsum(marks)[~marks]
    words = [t for t, m in zip(tokens, marks.tolist()) if not m]
    if len(sentence):
        begins = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        within = np.arange(len(sentence)) - np.repeat(begins, np.diff(np.append(begins, len(sentence))))
        change = np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (within[1:] % STRETCH == 0)])
        sentence = np.cumsum(change) - 1
    return words, sentence


@dataclass
class LevelModel:
    """weights: FEATURES x 3, bias: 3; cuts: difficulties at which the next level begins."""

    weights: np.ndarray
    bias: np.ndarray
    cuts: tuple[float, float] = (0.5, 1.5)

    def vector(self, word: str) -> np.ndarray:
        f = word_features(word)
        return self.weights[f].sum(axis=0) / len(f)


class Scorer:
    """A model with the vectors of the words met so far; starts anew at ``most`` words, so its memory has a bound."""

    def __init__(self, model: LevelModel, most: int = 500_000):
        self.model, self.most = model, most
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 3))

    def distribution(self, text: str) -> np.ndarray | None:
        """Sums of (words x probability) of the three levels over the sentences; None without words."""
        words, sentence = _segments(text)
        if not words:
            return None
        if len(self.known) > self.most:
            self.known.clear()
        ids = []
        for w in words:
            i = self.known.get(w)
            if i is None:
                i = self.known[w] = len(self.known)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[i] = self.model.vector(w)
            ids.append(i)
        begins = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        counts = np.diff(np.append(begins, len(sentence)))
        logits = np.add.reduceat(self.table[ids], begins, axis=0) / counts[:, None] + self.model.bias
        return counts @ softmax(logits)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, str]], penalty: float = 1e-4, steps: int = 150, rate: float = 100.0) -> LevelModel:
    """Gradient descent with momentum on the mean cross-entropy of sentences; then the cuts from whole passages."""
    if not samples:
        raise ValueError("no labelled passages")
    rows, labels = [], []
    for text, level in samples:
        words, sentence = _segments(text)
        for k in range(int(sentence[-1]) + 1 if len(words) else 0):
            own = [w for w, s in zip(words, sentence) if s == k]
            row = np.zeros(FEATURES, np.float32)
            for w in own:
                f = word_features(w)
                np.add.at(row, f, 1 / len(f) / len(own))
            rows.append(row)
            labels.append(LEVELS.index(level))
    x, y = np.stack(rows), np.eye(3, dtype=np.float32)[labels]
    share = y.mean(axis=0)
    weight = (y / np.maximum(share, 1e-9)).sum(axis=1, keepdims=True)
    weight /= weight.mean()
    w, b = np.zeros((FEATURES, 3), np.float32), np.zeros(3, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        gap = (softmax(x @ w + b) - y) * weight / len(x)
        vw = 0.9 * vw - rate * (x.T @ gap + penalty * w)
        vb = 0.9 * vb - 0.5 * gap.sum(axis=0)
        w, b = w + vw, b + vb
    model = LevelModel(w, b)
    scorer = Scorer(model)
    scored = [(difficulty(d), LEVELS.index(level)) for text, level in samples if (d := scorer.distribution(text)) is not None]
    cuts = []
    for k in (1, 2):
        low, high = sorted(s for s, y in scored if y == k - 1), sorted(s for s, y in scored if y == k)
        # The middle between the upper tail of the lower level and the lower tail of the next.
        cuts.append(float((np.quantile(low, 0.9) + np.quantile(high, 0.1)) / 2) if low and high else k - 0.5)
    model.cuts = (cuts[0], cuts[1])
    return model


def difficulty(sums: np.ndarray) -> float:
    return float((sums * [0, 1, 2]).sum() / max(sums.sum(), 1e-12))


def fit_on(level_samples: DataFrame, most: int = MOST_SAMPLES) -> LevelModel:
    """Fits on at most ``most`` labelled passages (the table has 90), read to the driver."""
    rows = level_samples.filter(F.col("reading_level").isin(LEVELS) & F.col("text").isNotNull()).select("sample_id", "text", "reading_level").orderBy("sample_id").limit(most).collect()
    return fit([(r["text"], r["reading_level"]) for r in rows])


def scored(df: DataFrame, model: LevelModel, id_col: str = "id", key_col: str = "book_id", text_col: str = "content") -> DataFrame:
    """(id, key, words, p0, p1, p2): the sums of each text's sentence distributions."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            keep, sums = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                d = scorer.distribution(text) if text else None
                if d is not None:
                    keep.append(row)
                    sums.append(d)
            table = np.asarray(sums).reshape(-1, 3)
            take = pa.array(keep, pa.int32())
            arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(table.sum(axis=1).round().astype(np.int64)), *(pa.array(table[:, k].copy()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "words", "p0", "p1", "p2"])

    real = df.filter(F.length(text_col) > 0).select(F.col(id_col).cast("string").alias("id"), F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return real.mapInArrow(run, "id string, key string, words bigint, p0 double, p1 double, p2 double")


def _level(model: LevelModel) -> tuple[Column, Column]:
    score = (F.col("p1") + 2 * F.col("p2")) / (F.col("p0") + F.col("p1") + F.col("p2"))
    return score, F.when(score < model.cuts[0], LEVELS[0]).when(score < model.cuts[1], LEVELS[1]).otherwise(LEVELS[2])


def chapter_levels(chapters: DataFrame, level_samples: DataFrame) -> DataFrame:
    """Query p4_chapters: (chapter_id, level, difficulty, share of each level)."""
    model = fit_on(level_samples)
    score, level = _level(model)
    total = F.col("p0") + F.col("p1") + F.col("p2")
    shares = [F.round(F.col(f"p{k}") / total, 4).alias(name) for k, name in enumerate(LEVELS)]
    return scored(chapters, model).dropDuplicates(["id"]).select(F.col("id").alias("chapter_id"), level.alias("level"), F.round(score, 4).alias("difficulty"), *shares)


def book_levels(chapters: DataFrame, level_samples: DataFrame) -> DataFrame:
    """Query p4_books: (book_id, level, difficulty, n_words) of every book that has chapters with text."""
    model = fit_on(level_samples)
    score, level = _level(model)
    each = scored(chapters, model).dropDuplicates(["id"]).filter(F.col("key").isNotNull())
    sums = each.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("words", "p0", "p1", "p2")])
    return sums.select(F.col("key").alias("book_id"), level.alias("level"), F.round(score, 4).alias("difficulty"), F.col("words").alias("n_words"))


def stated_level(reading_level: Column) -> Column:
    """The level that a freely spelled reading_level names, else null."""
    low = F.lower(reading_level)
    return F.when(F.contains(low, F.lit("beginner")), "beginner").when(F.contains(low, F.lit("intermediate")), "intermediate").when(F.contains(low, F.lit("advanced")), "advanced")


def stated_age_level(age_range: Column) -> Column:
    """The level of an age range by its lower bound: under 8, 8 to 11, from 12; else null."""
    age = F.expr("try_cast(regexp_extract(age_range, '[0-9]+', 0) AS INT)") if age_range is None else F.regexp_extract(age_range, "[0-9]{1,3}", 0).try_cast("int")
    return F.when(age < 8, "beginner").when(age < 12, "intermediate").when(age >= 12, "advanced")


def found(chapters: DataFrame, books: DataFrame, level_samples: DataFrame) -> DataFrame:
    """Query p4_found: (book_id) of the books whose stated level or age contradicts their chapters."""
    shown = book_levels(chapters, level_samples)
    stated = books.select(F.col("id").cast("string").alias("book_id"), stated_level(F.col("reading_level")).alias("by_name"), stated_age_level(F.col("age_range")).alias("by_age"))
    both = stated.filter("by_name IS NOT NULL OR by_age IS NOT NULL").join(shown, "book_id")
    return both.filter("by_name <> level OR by_age <> level").select("book_id").distinct()
