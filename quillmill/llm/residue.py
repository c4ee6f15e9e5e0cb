"""Problem 5: template residue, filler, error messages and demands for scripts where real text should be.

Labelling functions (phrases, response statuses, shapes of slots) give weak labels to a bounded sample of texts. Real texts
of the sample also return with an unfilled slot, or with a harmless sign (a blank, a price, a bracketed number), put in
place of a word. A logistic model with L2 penalty is fitted on hashed n-grams, on the shapes of signs, on lengths and on
whether a text repeats its own title. It reads every segment of every text, and the few words around the word of greatest
weight by themselves, so that a slot is not drowned by a long sentence; a text counts by its worst part. The score alone
decides, from LIKELY on. ``validation`` fits without one source (the host of a record) at a time, on a sample of the same
size, and reports how far the score agrees with the weak labels on every text of that source.

Defined cases: null, empty and blank texts are no case and have no score; a row delivered twice counts once (by id); very
long texts are scored segment by segment, whole; extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.tokens import slices

BUCKETS = 1 << 16
#: Most texts of the rare label, and most of all, that the model is fitted on, for each of the two fields.
MOST_POSITIVE, MOST_NEGATIVE = 3000, 8000
#: A text is residue from this score on.
LIKELY = 0.55
#: Words on either side of the weightiest one that are scored by themselves, and texts of the sample that return changed.
AROUND, CHANGED = 3, 2500

#: Names that templates give to their slots.
SLOT_NAMES = "author|title|book_title|chapter_title|character|character_name|hero_name|noun|verb|adjective|place|event|setting|grade_level|name|topic|subject"
#: Shapes of unfilled or wrongly filled slots.
SLOTS = [
    r"\{\{[^{}]{0,60}\}\}", r"\$\{[^{}]{0,60}\}", r"#\{[^{}]{0,60}\}", r"\{%[^{}]{0,60}%\}", r"<<[^<>]{1,60}>>", r"<%=?[^%]{0,60}%>", r"\[\[[^\[\]]{1,60}\]\]",
    r"\[insert [^\[\]]{1,60}\]", r"\[your [^\[\]]{1,60}\]", r"%\(\w{1,60}\)[sd]", r"%(?:\d\$)?[sd]\b", r"(?<![_\w])__[a-z]\w{0,60}?__", r"@@\w{1,60}@@", r"\$[a-z]\w{0,60}\$",
    r"\{\d\}", rf"\{{(?:{SLOT_NAMES})\}}", rf"\[(?:{SLOT_NAMES})\]", rf"<(?:{SLOT_NAMES})>", r"\[object object\]", r"(?-i:(?<![\w-])(?:undefined|null|NaN|UNDEFINED|NULL|NAN)(?![\w-]))", r"(?-i:^[^A-Z]*(?<![\w-])nan(?![\w-]))",
]
#: Filler and instructions left from templates.
FILLER = [
    r"\blorem ipsum\b", r"\b(?:adipiscing elit|eiusmod tempor|incididunt ut|ut labore et dolore|dolore magna|magna aliqua|enim ad minim|minim veniam|quis nostrud|nostrud exercitation|exercitation ullamco|ullamco laboris|laboris nisi|nisi aliquip|aliquip ex|ex ea commodo|commodo consequat|dolor sit amet)\b",
    r"^todo\b", r"\btodo:", r"\bsample question \d", r"\bdummy text\b", r"\bquestion text goes here\b", r"\btype your (?:question|text|answer) here\b", r"\binsert an? \w+ (?:about|on|for) .{1,40} here\b", r"\bdescription coming soon\b",
    r"\byour text here\b", r"\badd (?:a )?(?:description|text|question) here\b", r"\bn/a - fill in later\b", r"\breplace before publishing\b", r"^\W*(?:tbd|xxx+|placeholder|n/a|test(?: test)+|asdf(?: asdf)*|qwerty|foo bar)\W*$",
]
#: Messages of servers and programs, with response statuses.
STATUSES = "internal server error|not found|too many requests|service unavailable|bad gateway|gateway timeout|forbidden|unauthorized|bad request"
ERRORS = [
    rf"\b[45]\d\d (?:{STATUSES})\b", rf"\bhttp [45]\d\d\b", rf"\"status\": ?[45]\d\d", rf"\bthe gateway says: (?:{STATUSES})", r"\bupstream returned \d+", r"\btraceback \(most recent call last\)", r"\brequest timed out\b", r"\bserver took too long to answer\b",
    r"\bcannot read property '", r"^\W*error:", r"\berror \d+\. please go back\b", r"\bsomething went wrong on our side\b", r"\bconnection refused\b", r"\bpágina no encontrada\b", r"\bseite nicht gefunden\b", r"\bpage est introuvable\b",
    r"\baccess to this page has been denied\b", r"\bwe are down for maintenance\b", r"\bsession has expired\b", r"\bpage you requested could not be found\b", r"\bquota used up\b", r"\bnullpointerexception\b", r"\bstack trace\b", r"<title>[45]\d\d",
]
#: Demands for scripts or browser checks.
SCRIPTS = [
    r"\b(?:enable|activate|activer|aktivieren|disabled|requires?|needs?|allow|turn on|without)\b.{0,30}\bjavascript\b", r"\bjavascript\b.{0,30}\b(?:disabled|required|needed|off|aktivieren)\b", r"<noscript>", r"\bturn on scripts\b", r"\ballow scripts\b", r"\bwithout scripting support\b", r"\bchecking your browser\b", r"\benable cookies\b", r"\bverify (?:that )?you are (?:a )?human\b",
]
RULES = re.compile("|".join(f"(?:{p})" for p in [*SLOTS, *FILLER, *ERRORS, *SCRIPTS]), re.IGNORECASE)
_SEGMENT = re.compile(r"(?<=[.!?])[\s”\"’)]+")
_TOKEN = re.compile(r"[^\W_]+|_+|[^\w\s]+")
_SIGNS = re.compile(r"[^\w\s.,;:!?“”‘’\"'()—–…-]")
#: Ways to write a slot, and signs that real texts have in place of a word.
SLOT_SHAPES = ["{{%s}}", "{{ %s }}", "${%s}", "#{%s}", "{%% %s %%}", "<<%s>>", "<%%= %s %%>", "[[%s]]", "[insert %s]", "[your %s]", "%%(%s)s", "__%s__", "@@%s@@", "$%s$", "{%s}", "[%s]", "<%s>"]
WRONGLY_FILLED = ["[object Object]", "undefined", "NaN", "null", "{0}", "{1}", "%s", "%d", "%1$s"]
HARMLESS = ["____", "__", "_______", "[3]", "[sic]", "[2, 5]", "$12.99", "$5", "100%", "7%", "#1", "{a, b}", "<3", "(x)", "&amp;", "@home", "Null Street", "Null Hill", "Mr. Null", "Nan", "[Abridged]", "[Audio book]", "“error”", "“not found”", "“access denied”", "“ERROR”", "placeholder", "JavaScript", "script", "🙂", "★", "→", "½", "No. 7", "(p. 12)", "*", "3 + __ = 7", "[of the page]", "<em>this</em>", "{round}"]


#: Parts of which notices of programs and templates are made, so that a small sample knows such wording too.
THINGS = "page link file request server session connection service document image".split()
FAILED = ["could not be found", "is not available", "has expired", "timed out", "was refused", "is broken", "failed to load", "is down for maintenance", "cannot be reached", "was denied"]
AFTER = ["", " Please try again later.", " Please log in again.", " Go back and reload.", " (code 17)", " Contact support."]
ASKED = ["enable", "activate", "turn on", "allow"]
MEANS = ["JavaScript", "scripts", "cookies"]
WHY = ["to continue.", "in your browser.", "to view this content.", "and reload.", "to run this app."]


def notices() -> list[str]:
    """Made-up notices, all of them residue."""
    out = [f"{start} {thing} {failed}.{AFTER[(i + j) % len(AFTER)]}" for start in ("The", "Sorry, this", "Your") for i, thing in enumerate(THINGS) for j, failed in enumerate(FAILED) if (i + j) % 3 == 0]
    out += [f"{start}{verb} {means} {why}" for start in ("Please ", "You must ", "") for verb in ASKED for means in MEANS for why in WHY]
    codes = zip((500, 404, 429, 503, 502, 504, 403, 401, 400), STATUSES.split("|"))
    out += [form.format(code, status.title()) for code, status in codes for form in ("{0} {1}", "HTTP {0}: {1}", "Error {0}: {1}", '{{"status": {0}, "error": "{1}"}}', "<title>{0} {1}</title>")]
    out += ["Lorem ipsum dolor sit amet", "consectetur adipiscing elit, sed do eiusmod tempor", "TODO", "TODO: fill in", "TBD", "placeholder", "xxx", "test", "test test", "asdf", "N/A", "Text goes here.", "Add text here.", "Coming soon."] * 3
    return out


def segments(text: str) -> list[str]:
    """Sentences of a text, as far as marks show them; a slot or message keeps its own marks together."""
    return [s for s in _SEGMENT.split(text) if s.strip()] or [text]


@lru_cache(1 << 18)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _single(token: str) -> str:
    """The feature of one word; a capitalised one is another word than the same in small or all capital letters."""
    return "1:" + (token if token.istitle() and len(token) > 1 else re.sub(r"\d", "0", token.lower()))


def features(segment: str, n_segments: int, titled: bool, whole: bool = True) -> list[int]:
    """Hashed n-grams and sign shapes of a segment or of a part of it; of a whole one also length classes and the title feature."""
    raw = _TOKEN.findall(segment)
    tokens = [re.sub(r"\d", "0", t.lower()) if not t.isalpha() else t.lower() for t in raw]
    ends = ("^", "$") if whole else ("", "")
    out = [_single(t) for t in raw] + [f"2:{a} {b}" for a, b in zip([ends[0], *tokens], [*tokens, ends[1]])] + [f"3:{a} {b} {c}" for a, b, c in zip(tokens, tokens[1:], tokens[2:])]
    if _SIGNS.search(segment):
        low = segment.lower()
        for chunk in re.findall(r"[^\w\s]*[\[\]{}<>%#$@_\\|~][^\s]*(?: [^\s\[\]{}<>]{1,30}){0,2}[^\s]*", low):
            shape = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+(?:_[^\W\d_]+)*", "a", chunk))
            out += [f"s:{shape[:12]}"] * 2 + [f"s:{shape[:3]}", f"c:{chunk[:24]}"]
        out += [f"b:{m}" for m in re.findall(r"[\[{<%#$@_]{1,2}|[\]}>%@_]{1,2}", low)]
    if whole:
        out += [f"l:{min(len(tokens) // 3, 6)}", f"n:{min(n_segments, 3)}:{min(len(tokens) // 6, 3)}", f"t:{titled}"]
    return [_bucket(f) for f in out]


def part_around(segment: str, place: int) -> str:
    """The words around the one at a character."""
    spans = [m.span() for m in re.finditer(r"\S+", segment)]
    i = next((k for k, (_, end) in enumerate(spans) if end > place), len(spans) - 1)
    return segment[spans[max(i - AROUND, 0)][0] : spans[min(i + AROUND, len(spans) - 1)][1]]


@dataclass
class ResidueModel:
    weights: np.ndarray
    bias: float

    def _sum(self, f: list[int]) -> float:
        return float(self.weights[f].sum() / np.sqrt(len(f))) + self.bias if f else -np.inf

    def weightiest(self, segment: str) -> str | None:
        """The words around the token of greatest weight, if the segment is longer than these."""
        tokens = list(_TOKEN.finditer(segment))
        if len(tokens) <= 2 * AROUND + 2:
            return None
        own = [_bucket(_single(m[0])) for m in tokens]
        return part_around(segment, tokens[int(np.argmax(self.weights[own]))].start())

    def score(self, text: str, title: str | None = None) -> float:
        """Probability that the worst part is residue."""
        parts = segments(text)
        titled = bool(title) and title in text
        best = -np.inf
        for s in dict.fromkeys(parts):
            best = max(best, self._sum(features(s, len(parts), titled)))
            near = self.weightiest(s)
            if near is not None:
                best = max(best, self._sum(features(near, 1, False, whole=False)))
        return float(1 / (1 + np.exp(-best)))


def labelled(texts: list[tuple[str, str | None]]) -> tuple[list[list[int]], list[int], list[str]]:
    """Rows of features and their weak labels, of whole segments and of parts of them; then the segments without residue."""
    rows, labels, plain = [], [], []

    def add(row: list[int], label: bool) -> None:
        if row:
            rows.append(row)
            labels.append(int(label))

    def put(segment: str, sign: str, label: bool, seed: int) -> None:
        """A segment in which one word is replaced."""
        words = segment.split(" ")
        k = seed % len(words)
        changed = " ".join([*words[:k], sign, *words[k + 1 :]])
        add(features(changed, 1, False), label)
        add(features(part_around(changed, len(" ".join(words[:k])) + 1), 1, False, whole=False), label)

    for text, title in texts:
        parts = segments(text)
        titled = bool(title) and title in text
        hits = [RULES.search(s) for s in parts]
        over = not any(hits) and bool(RULES.search(text))
        for s, h in zip(parts, hits):
            add(features(s, len(parts), titled), bool(h or over))
            if h:
                add(features(part_around(s, h.start()), 1, False, whole=False), True)
            elif not over:
                plain.append(s)
                add(features(part_around(s, zlib.crc32(s.encode()) % len(s)), 1, False, whole=False), False)
    for notice in notices():
        add(features(notice, 1, False), True)
    names = SLOT_NAMES.split("|")
    for i, s in enumerate(plain[:: max(len(plain) // CHANGED, 1)][:CHANGED]):
        seed = zlib.crc32(s.encode())
        shape = seed % (len(SLOT_SHAPES) + 4)
        put(s, SLOT_SHAPES[shape] % names[seed // 32 % len(names)] if shape < len(SLOT_SHAPES) else WRONGLY_FILLED[seed // 32 % len(WRONGLY_FILLED)], True, seed // 512)
        put(s, HARMLESS[i % len(HARMLESS)], False, seed // 512)
        put(f"{HARMLESS[i * 7 % len(HARMLESS)]} {s}", HARMLESS[i * 3 % len(HARMLESS)], False, seed // 512)
    return rows, labels, plain


def _descend(rows: list[list[int]], labels: list[int], start: ResidueModel, penalty: float, steps: int, rate: float) -> ResidueModel:
    """Logistic regression by gradient descent with momentum."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
    starts = np.cumsum(sizes) - sizes
    norm = 1 / np.sqrt(sizes)
    y = np.asarray(labels, float)
    w, b, vw, vb = start.weights.astype(float), start.bias, np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = np.add.reduceat(w[flat], starts) * norm + b
        gap = (1 / (1 + np.exp(-z)) - y) / len(y)
        vw = 0.9 * vw - rate * (np.bincount(flat, np.repeat(gap * norm, sizes), BUCKETS) + penalty * w)
        vb = 0.9 * vb - rate * 0.1 * gap.sum()
        w, b = w + vw, b + vb
    return ResidueModel(w.astype(np.float32), float(b))


def fit(texts: list[tuple[str, str | None]], penalty: float = 1e-6, steps: int = 250, rate: float = 30.0) -> ResidueModel:
    """Two rounds: the second also learns from the weightiest parts of segments without residue, by the first's weights."""
    rows, labels, plain = labelled(texts)
    none = ResidueModel(np.zeros(BUCKETS, np.float32), 0.0)
    if not rows:
        return ResidueModel(none.weights, -10.0)
    model = _descend(rows, labels, none, penalty, steps, rate)
    near = [p for p in map(model.weightiest, dict.fromkeys(plain)) if p]
    rows += [features(p, 1, False, whole=False) for p in near]
    return _descend(rows, [*labels, *[0] * len(near)], model, penalty, steps, rate)


def _java(pattern: str) -> str:
    return "(?iu)" + pattern


def texts_of(books: DataFrame, questions: DataFrame) -> DataFrame:
    """(field, record_id, source, title, text) of both text columns, each record once."""
    a = books.select(F.lit("description").alias("field"), F.col("id").alias("record_id"), "source", "title", F.col("description").alias("text"))
    b = questions.select(F.lit("question_text").alias("field"), F.col("id").alias("record_id"), "source", F.lit(None).cast("string").alias("title"), F.col("question_text").alias("text"))
    return a.unionByName(b).filter(F.length(F.trim("text")) > 0)


def training_texts(texts: DataFrame, positive: int = MOST_POSITIVE, negative: int = MOST_NEGATIVE) -> list:
    """At most ``positive`` texts of the rare weak label and ``negative`` of all, for either field, by a hash of their ids."""
    own = texts.select("source", "title", "text", "field", F.xxhash64("record_id").alias("h"))
    # Only the search for the rare label reads every text with the patterns; the rest of the sample is labelled once it is drawn.
    named = own.filter(F.col("text").rlike(_java("|".join(f"(?:{p})" for p in [*SLOTS, *FILLER, *ERRORS, *SCRIPTS]))))
    rare, plain = [], []
    for field in ("description", "question_text"):
        rare += named.filter(F.col("field") == field).orderBy("h", "text").limit(positive).collect()
        plain += own.filter(F.col("field") == field).orderBy("h", "text").limit(negative).collect()
    drawn = {(r["field"], r["h"], r["text"]): r for r in [*rare, *plain]}
    return [drawn[k] for k in sorted(drawn)]


def scores(spark: SparkSession, texts: DataFrame, model: ResidueModel) -> DataFrame:
    """(field, record_id, source, score, residue) of all texts."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            texts = batch.column(4).to_pylist()
            found = [model.score(t, title) for t, title in zip(texts, batch.column(3).to_pylist())]
            bad = [s >= LIKELY for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.float64()), pa.array(bad, pa.bool_())], ["field", "record_id", "source", "score", "residue"])

    return texts.select("field", "record_id", "source", "title", "text").mapInArrow(run, "field string, record_id string, source string, score double, residue boolean")


def scored(spark: SparkSession, books: DataFrame, questions: DataFrame) -> DataFrame:
    texts = texts_of(books, questions)
    return scores(spark, texts, fit([(r["text"], r["title"]) for r in training_texts(texts)]))


def found(spark: SparkSession, books: DataFrame, questions: DataFrame) -> DataFrame:
    """Query p5_found: (field, record_id)."""
    return scored(spark, books, questions).filter("residue").select("field", "record_id").distinct()


def clean(spark: SparkSession, books: DataFrame, questions: DataFrame) -> DataFrame:
    """Query p5_clean: (field, record_id) of the texts that remain."""
    return scored(spark, books, questions).filter("NOT residue").select("field", "record_id").distinct()


def samples_without(texts: DataFrame, sources: list[str], positive: int = MOST_POSITIVE, negative: int = MOST_NEGATIVE) -> tuple[list[tuple[str, str | None]], dict[str, list[int]]]:
    """The texts (text, title) of all samples, and for each source the places of what ``training_texts`` draws from the others."""
    own = texts.select(F.coalesce("source", F.lit("")).alias("source"), "title", "text", "field", F.xxhash64("record_id").alias("h"))
    named = own.filter(F.col("text").rlike(_java("|".join(f"(?:{p})" for p in [*SLOTS, *FILLER, *ERRORS, *SCRIPTS]))))
    order = F.row_number().over(W.partitionBy("field", "source").orderBy("h", "text"))
    wanted: dict[str, dict[tuple, tuple]] = {s: {} for s in sources}
    for rows, most in ((named, positive), (own, negative)):
        lowest = sorted(rows.withColumn("r", order).filter(F.col("r") <= most).collect(), key=lambda r: (r["h"], r["text"]))
        for s in sources:
            for field in ("description", "question_text"):
                rest = [r for r in lowest if r["field"] == field and r["source"] != s][:most]
                wanted[s] |= {(field, r["h"], r["text"]): (r["text"], r["title"]) for r in rest}
    every: dict[tuple, tuple] = {}
    for drawn in wanted.values():
        every |= drawn
    place = {k: i for i, k in enumerate(sorted(every))}
    return [every[k] for k in place], {s: sorted(place[k] for k in drawn) for s, drawn in wanted.items()}


def validation(spark: SparkSession, books: DataFrame, questions: DataFrame) -> DataFrame:
    """Query p5_validation: agreement with the weak labels on each source, by a model fitted without it.

    One row per source over all its texts, null as the empty name: (source, n_texts, n_weak, n_found, n_agree). n_found
    counts by the score, as ``found`` does.
    """
    texts = texts_of(books, questions)
    sources = sorted(r["source"] for r in texts.select(F.coalesce("source", F.lit("")).alias("source")).distinct().collect())
    schema = "source string, n_texts int, n_weak int, n_found int, n_agree int"
    if not sources:
        return spark.createDataFrame([], schema)
    drawn = spark.sparkContext.broadcast(samples_without(texts, sources))

    def fitted(source: str) -> tuple[str, ResidueModel]:
        every, places = drawn.value
        return source, fit([every[i] for i in places[source]])

    models = spark.sparkContext.broadcast(dict(spark.sparkContext.parallelize(sources, len(sources)).map(fitted).collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_source = models.value
        for batch in slices(batches):
            own, titles, texts = (batch.column(i).to_pylist() for i in (2, 3, 4))
            got = [by_source[s].score(t, title) >= LIKELY for s, title, t in zip(own, titles, texts)]
            weak = [bool(RULES.search(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(got, pa.bool_()), pa.array(weak, pa.bool_())], ["field", "record_id", "source", "got", "weak"])

    rows = texts.select("field", "record_id", F.coalesce("source", F.lit("")).alias("source"), "title", "text")
    each = rows.mapInArrow(run, "field string, record_id string, source string, got boolean, weak boolean").dropDuplicates(["field", "record_id"])
    counts = [F.count("*"), F.count_if("weak"), F.count_if("got"), F.count_if(F.col("got") == F.col("weak"))]
    return each.groupBy("source").agg(*[c.cast("int").alias(n) for c, n in zip(counts, ("n_texts", "n_weak", "n_found", "n_agree"))])
