"""Problem 2: texts that were cut off by a field limit or in transfer, and how often each source does it.

Per source and column, histograms of text lengths in characters and in bytes show each limit as a spike of texts without a
closing mark, at the greatest length or, if it changed, among smaller ones. Texts at a spike without closing mark are
flagged unless the corpus shows a complete text. Texts cut in transfer have no common length, so a second stage follows for
all unclosed texts: what those at a spike have in common, that they stop where sentences of the corpus do not stop, is the
evidence whatever the length (``p2_sources`` counts both kinds apart): counts over all finished sentences tell, for the words before a place, how often a sentence ends there and how
often it goes on; words that are no words elsewhere, unclosed brackets, tags and entities, and names that only begin a
name of the same book, show a cut within a word or mark.

Defined cases: null, empty and blank texts are never cut; a closed text is never cut, nor one closed by an ellipsis, sign or
remark in brackets; a row delivered twice counts once (by id); records that hold template residue are left out; a text
whose end the corpus does not know is cut only if it lies at a spike; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm import residue
from quillmill.tables import cut_lineage

#: A spike: at least LEAST texts, and TIMES the mean number of unclosed texts of the other lengths; at most BEYOND of a source longer.
#: A spike below the greatest length: INNER texts, and TIMES the mean of the NEIGHBOURS lengths on either side.
LEAST, TIMES, BEYOND, INNER, NEIGHBOURS = 4, 8.0, 0.002, 12, 12
#: A place ends sentences if at least this share of its occurrences does.
CAN_END = 0.2
#: Sentences of one beginning that end fewer texts than this share are followed by another one: at a limit, and elsewhere,
#: where at least SEEN of them must be known.
RARE_LAST, NEVER_LAST, SEEN = 0.03, 0.002, 30
FILTER_SLOTS = 1 << 20
#: A word is known if it stands inside texts this often.
KNOWN = 2
WS = r"\s\u0085   -     　"
_CLOSED = rf"[.!?…。！？؟।]['\"”’»)\]]*$"
#: Half a sign: two of three dots, or what stands for a character of which bytes are missing.
_HALF = r"(?:^|[^.])\.\.$|\uFFFD$"
#: Texts shortened after any word end so; what stands before is no end of a sentence.
_SHORTENED = r"(?:\.{2,}|…)['\"”’»)\]]*$"
_WORD = r"[\p{L}\p{M}\p{N}]+(?:[’'][\p{L}]+)?"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"[{WS}]+$", ""), rf"^[{WS}]+", "")


def closed(text: Column) -> Column:
    """Whether a trimmed text ends in a closing mark, a closed remark, or a sign that is no letter, digit or opening mark."""
    whole = text.rlike(_CLOSED) | text.rlike(r"[^\p{L}\p{M}\p{N}\s,;:&<>/(\[{“„«‘'\"’”»\-–—)\]]$") | text.rlike(r"[(\[][^()\[\]]*[)\]]$")
    return whole & ~text.rlike(_HALF)


def broken_mark(text: Column) -> Column:
    """Whether a trimmed text stops within a mark: after an opening or joining sign, in a tag, entity, bracket or quotation."""
    count = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    return (
        text.rlike(r"[,;:&<(\[{“„«‘–—-]$") & ~text.rlike(r"&\w+;$")
        | text.rlike(_HALF)
        | text.rlike(r"<[^<>]{0,30}$")
        | text.rlike(r"&#?\w{0,8}$")
        | (count("(") > count(")"))
        | (count("“") > count("”"))
        | (count("«") > count("»"))
        | (F.size(F.regexp_extract_all(text, F.lit(r"<(\w+)>"), F.lit(0))) > F.size(F.regexp_extract_all(text, F.lit(r"</(\w+)>"), F.lit(0))))
    )


def without_markup(text: Column) -> Column:
    """Tags and entities are no words."""
    return F.regexp_replace(text, r"</?\w+>|&#?\w+;", " ")


def words(text: Column) -> Column:
    """Words in the form the counts use: digits as 0, capitalised words but the first as N, all others in lower case."""
    raw = F.regexp_extract_all(without_markup(text), F.lit(_WORD), F.lit(0))
    return F.transform(raw, lambda w, i: F.when(w.rlike(r"^\p{N}"), F.lit("0")).when((i > 0) & w.rlike(r"^\p{Lu}"), F.lit("N")).otherwise(F.lower(w)))


def sentences(text: Column) -> Column:
    return F.split(text, rf"(?<=[.!?…][”\"’)]{{0,2}})[{WS}]+(?=[\p{{Lu}}\p{{N}}“\"(])")


def _opening(w: Column) -> Column:
    return F.concat_ws(" ", F.try_element_at(w, F.lit(1)), F.coalesce(F.try_element_at(w, F.lit(2)), F.lit("^")))


def _text_key(field: Column, w: Column) -> Column:
    """Key of the sentences of one beginning; counted is whether they end their text."""
    return F.xxhash64(F.lit("t"), field, _opening(w))


def _keys(w: Column, i: Column) -> Column:
    """Keys of five kinds for the place after word i (from 1): the opening words with the last three, two and one; the last three; the last."""
    at = lambda k: F.when(i >= k, F.try_element_at(w, F.greatest(i - (k - 1), F.lit(1)))).otherwise("^")
    opening = _opening(w)
    return F.array(
        F.xxhash64(F.lit("a"), opening, at(3), at(2), at(1)), F.xxhash64(F.lit("b"), opening, at(2), at(1)), F.xxhash64(F.lit("c"), opening, at(1)), F.xxhash64(F.lit("d"), at(3), at(2), at(1)), F.xxhash64(F.lit("e"), at(1)),
    )


def place_counts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, ends, goes_on) over all finished sentences of all texts, for the keys that are asked for.

    A filter of at most FILTER_SLOTS numbers keeps most other keys out of the shuffle.
    """
    slot = F.pmod("key", F.lit(FILTER_SLOTS)).cast("int").alias("slot")
    wanted = F.broadcast(asked.select(slot).distinct())
    parts = texts.select("field", sentences(F.col("text")).alias("parts"))
    units = parts.select("field", F.size("parts").alias("of"), F.posexplode("parts").alias("number", "s")).filter(F.col("s").rlike(_CLOSED) & ~F.col("s").rlike(_SHORTENED)).select("field", (F.col("number") + 1 == F.col("of")).cast("int").alias("last"), words(F.col("s")).alias("w")).filter("size(w) > 1")
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(_keys(F.col("w"), i), lambda k: F.struct(k.alias("key"), (i == F.size("w")).cast("int").alias("end")))))
    whole = F.array(F.struct(_text_key(F.col("field"), F.col("w")).alias("key"), F.col("last").alias("end")))
    rows = units.select(F.explode(F.concat(places, whole)).alias("p")).select("p.key", "p.end")
    rows = rows.withColumn("slot", slot).join(wanted, "slot", "left_semi")
    return rows.groupBy("key").agg(F.sum("end").alias("ends"), F.sum(1 - F.col("end")).alias("goes_on"))


def limits(texts: DataFrame) -> DataFrame:
    """(field, source, spikes ARRAY<STRUCT<unit, most, n_at_limit>>): the lengths at which a source cuts; unit is chars or bytes."""
    own = texts.select("field", "source", "unclosed", F.length("raw").alias("chars"), F.octet_length("raw").alias("bytes"))
    long = own.select("field", "source", "unclosed", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "n"))
    hist = long.groupBy("field", "source", "unit", "n").agg(F.count("*").alias("texts"), F.count_if("unclosed").alias("open"))
    part = W.partitionBy("field", "source", "unit")
    near = part.orderBy("n").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    ranked = (
        hist.withColumn("beyond", F.coalesce(F.sum("texts").over(part.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("texts").over(part))
        .withColumn("mean", (F.sum("open").over(part) - F.col("open")) / F.greatest(F.count("*").over(part) - 1, F.lit(1)))
        .withColumn("around", (F.sum("open").over(near) - F.col("open")) / (2 * NEIGHBOURS))
        .withColumn("greatest_open", F.max("open").over(part))
    )
    last = (F.col("open") == F.col("greatest_open")) & (F.col("open") >= LEAST) & (F.col("open") >= TIMES * F.col("mean")) & (F.col("beyond") <= BEYOND * F.col("total") + 1)
    inner = (F.col("open") >= INNER) & (F.col("open") >= TIMES * F.col("around")) & (F.col("open") * 2 > F.col("texts"))
    spikes = ranked.filter(last | inner).select("field", "source", F.struct("unit", F.col("n").alias("most"), F.col("open").alias("n_at_limit")).alias("s"))
    # Lengths of the two units within a twentieth are one limit: the one with the higher spike is what the source cuts by.
    every = spikes.groupBy("field", "source").agg(F.sort_array(F.collect_list("s")).alias("all"))  # a few lengths a source
    stronger = lambda x, y: (x["unit"] != y["unit"]) & (F.abs(x["most"] - y["most"]) <= F.greatest(F.lit(3), y["most"] / 20)) & ((y["n_at_limit"] > x["n_at_limit"]) | ((y["n_at_limit"] == x["n_at_limit"]) & (y["unit"] > x["unit"])))
    return every.select("field", "source", F.filter("all", lambda x: ~F.exists("all", lambda y: stronger(x, y))).alias("spikes"))


def classified(spark: SparkSession, books: DataFrame, questions: DataFrame) -> DataFrame:
    """(field, record_id, source, cut BOOLEAN, at_limit BOOLEAN) of every text without residue."""
    a = books.select(F.lit("description").alias("field"), F.col("id").alias("record_id"), "source", F.col("id").alias("book_id"), F.col("description").alias("raw"))
    b = questions.select(F.lit("question_text").alias("field"), F.col("id").alias("record_id"), "source", "book_id", F.col("question_text").alias("raw"))
    texts = a.unionByName(b).withColumn("text", trimmed(F.col("raw"))).filter(F.length("text") > 0).dropDuplicates(["field", "record_id"])
    bad = residue.found(spark, books, questions)
    texts = cut_lineage(texts.join(bad, ["field", "record_id"], "left_anti").withColumn("unclosed", ~closed(F.col("text"))))
    marks = limits(texts)
    reached = lambda x: F.when(x["unit"] == "bytes", F.octet_length("raw").between(x["most"] - 3, x["most"])).otherwise(F.length("raw") == x["most"])
    near = F.exists("spikes", reached)
    open_ = texts.filter("unclosed").join(F.broadcast(marks), ["field", "source"], "left").withColumn("at_limit", F.coalesce(near, F.lit(False)))  # one row a source
    last = F.try_element_at(sentences(F.col("text")), F.lit(-1))
    open_ = open_.select("field", "record_id", "source", "book_id", "at_limit", broken_mark(F.col("text")).alias("broken"), last.alias("unit_text"), F.regexp_extract("text", rf"({_WORD})[^\p{{L}}\p{{N}}]*$", 1).alias("end_word"))
    mixed = F.col("unit_text").rlike(r"\p{Ll}") & (F.col("unit_text").rlike(r"\p{Lu}"))
    open_ = cut_lineage(open_.withColumn("w", words(F.col("unit_text"))).withColumn("mixed", mixed).withColumn("name", F.col("end_word").rlike(r"^\p{Lu}") & (F.size("w") > 1) & mixed))
    # Words that stand inside texts in lower case.
    inner = texts.select(F.explode(F.regexp_extract_all(without_markup(F.col("text")), F.lit(r"(?<![\p{L}\p{M}\p{N}’'])([\p{Ll}\p{M}’']+)(?=[^\p{L}\p{M}\p{N}’'])"), F.lit(1))).alias("word"))
    vocabulary = inner.groupBy("word").agg(F.count("*").alias("seen")).filter(F.col("seen") >= KNOWN)
    # In texts of one case a word unknown in lower case is taken for a name.
    flat = open_.filter("NOT mixed").select("field", "record_id", F.posexplode("w").alias("i", "word")).join(vocabulary.filter("seen >= 20"), "word", "left")
    flat = flat.groupBy("field", "record_id").agg(F.sort_array(F.collect_list(F.struct("i", F.when(F.col("seen").isNull(), F.lit("N")).otherwise(F.col("word")).alias("word")))).alias("p"))
    flat = flat.select("field", "record_id", F.transform("p", lambda x: x["word"]).alias("w2"))
    open_ = open_.join(flat, ["field", "record_id"], "left").withColumn("w", F.coalesce("w2", "w")).drop("w2").withColumn("name", F.col("name") | (F.try_element_at("w", F.lit(-1)) == "N"))
    # What the corpus knows of the place.
    keys = F.concat(_keys(F.col("w"), F.size("w")), F.array(_text_key(F.col("field"), F.col("w"))))
    keyed = open_.filter("size(w) > 0").select("field", "record_id", F.posexplode(keys).alias("level", "key"))
    enough = (F.col("level") < 5) & (F.col("ends") + F.col("goes_on") >= F.when(F.col("level") == 4, 1).otherwise(2))
    known = keyed.join(place_counts(texts, keyed), "key").groupBy("field", "record_id")
    known = known.agg(F.min(F.when(enough, F.struct("level", "ends", "goes_on"))).alias("place"), F.max(F.when(F.col("level") == 5, F.col("ends") / (F.col("ends") + F.col("goes_on")))).alias("ends_texts"), F.max(F.when(F.col("level") == 5, F.col("ends") + F.col("goes_on"))).alias("of_texts"))
    # What is known of the last word, and of names of the same book that begin with it.
    ends = open_.select("field", "record_id", F.lower("end_word").alias("word")).join(vocabulary, "word").select("field", "record_id", F.lit(True).alias("is_word"))
    names = texts.select("book_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{M}\p{N}])(\p{Lu}[\p{L}\p{M}]+)(?=[^\p{L}\p{M}\p{N}])"), F.lit(1))).alias("n")).select("book_id", F.lower("n").alias("n")).distinct()
    asked = open_.filter("name").select("field", "record_id", "book_id", F.lower(F.regexp_replace("end_word", "[’'].*$", "")).alias("end"))
    wanted = names.join(asked.select("book_id").distinct(), "book_id", "left_semi")
    begun = wanted.select("book_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("n")), lambda k: F.substring("n", F.lit(1), k))).alias("end"))
    begun = begun.groupBy("book_id", "end").agg(F.bool_or(F.col("n") == F.col("end")).alias("whole"))
    named = asked.join(begun, ["book_id", "end"]).select("field", "record_id", "whole")
    all_ = open_.join(known, ["field", "record_id"], "left").join(ends, ["field", "record_id"], "left").join(named, ["field", "record_id"], "left")
    share = F.col("place.ends") / (F.col("place.ends") + F.col("place.goes_on"))
    can_end = F.when(F.col("place").isNull(), ~F.col("at_limit")).otherwise(share >= CAN_END)
    part_of_word = F.when(F.col("name"), F.coalesce(~F.col("whole"), F.col("at_limit"))).otherwise(F.col("is_word").isNull() & ~F.col("end_word").rlike(r"^\p{N}"))
    more_follows = F.when(F.col("at_limit"), F.col("ends_texts") < RARE_LAST).otherwise((F.col("ends_texts") < NEVER_LAST) & (F.col("of_texts") >= SEEN))
    cut = F.col("broken") | part_of_word | ~can_end | F.coalesce(more_follows, F.lit(False))
    judged = all_.select("field", "record_id", F.coalesce(cut, F.col("at_limit")).alias("cut"), "at_limit")
    out = texts.select("field", "record_id", "source").join(judged, ["field", "record_id"], "left")
    return out.select("field", "record_id", "source", F.coalesce("cut", F.lit(False)).alias("cut"), F.coalesce("at_limit", F.lit(False)).alias("at_limit"))


def found(spark: SparkSession, books: DataFrame, questions: DataFrame) -> DataFrame:
    """Query p2_found: (field, record_id)."""
    return classified(spark, books, questions).filter("cut").select("field", "record_id")


def report(spark: SparkSession, books: DataFrame, questions: DataFrame) -> DataFrame:
    """Query p2_sources: per field and source the texts, the cut ones, their share, and those of them at a length limit."""
    own = classified(spark, books, questions).groupBy("field", "source")
    return own.agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("int")), 4).alias("share_cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("n_at_limit"))
