"""Problem 8: sentence boundaries across languages and scripts, in SQL expressions only.

Dots of decimals, addresses, initials, abbreviations and ellipses, and all marks inside quotations and inside brackets
within a sentence, are masked by private-use characters, one for one, so that offsets stay those of the text. Terminator
patterns per script then put a separator after each sentence, and the pieces' lengths give the offsets; the sentence texts
are cut out of the original text, which restores every mask.

Defined cases: null, empty and blank texts give no row; private-use characters already in a text count as plain signs;
repeated rows give their sentences again; an unclosed quotation runs to the end of its paragraph; extra columns are
dropped. Offsets are Unicode code points from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, SOFT, OPEN, CLOSE, CUT, PLAIN = "\ue000", "\ue003", "\ue008", "\ue009", "\ue010", "\ue01f"
WS = "\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
GREEK = "\u037e"
STRONG = "!?！？。｡؟।॥۔‼⁇⁈⁉" + GREEK
#: Everything that can end a sentence; inside quotations and brackets it is masked.
TERMINATORS = "." + SOFT + STRONG

#: Abbreviations that never end a sentence.
PREFIX = (
    "Mr Mrs Ms Sr Dr Prof St Mt Capt Col Gen Lt Sgt Rev Hon Gov Sen Rep Pres Messrs approx vs Sept Oct Nov Dec Jan Feb Aug ca cf "
    "N.B MM Mlle Mgr env c.-à-d Hr Fr Hrn bzw evtl ggf Abb z. B z.B d. h d.h u. a u.a i. d. R Sra Srta Dra Dña Ud Uds a. m "
    "EE. UU проф ул им акад гр т. е т.е г гг σελ π.χ δηλ Δρ κ κα د أ डॉ पं पृ प्रो श्री i.e e.g"
).replace("z. B", "z.~B").replace("d. h", "d.~h").replace("u. a", "u.~a").replace("i. d. R", "i.~d.~R").replace("a. m", "a.~m").replace("EE. UU", "EE.~UU").replace("т. е", "т.~е")
#: Abbreviations that never end a sentence before a number.
NUMBERED = "No Nos no nos Nr nr p P pp Pp ch Ch chap Chap vol Vol Vols fig Fig Figs apt sec Sec art Art pág págs Pág núm h стр Стр рис Рис гл д S ص т"
#: Abbreviations that end a sentence if the next one plainly begins.
FREE = "etc Inc Co Corp Ltd Jr Bros U.K U.S U.S.A A.D B.C a.m p.m usw u.~s.~w т.~д т.~п др κ.λπ κ.ά إلخ km kg"
#: German words before ordinal numbers, and months after them.
ORDINAL_BEFORE = "Am am Die die Der der Das das Den den Dem dem Des des Im im Vom vom Zum zum Zur zur Beim beim Ab ab Seit seit Bis bis"
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"
#: Verbs of speaking after a quotation in scripts without capitals.
SAID_HAN = "说|問|问|道|喊|叫|答|想|説"
SAID_HINDI = "कहा|पूछा|बोला|बोली|चिल्लाया|सोचा"
SAID_ARABIC = "قال|قالت|سأل|سألت|صاح|صاحت|همس|همست|أجاب|أجابت"
SAID_LATIN = "said|cried|asked|whispered|shouted|replied|answered|called|thought|exclaimed|added"


def _alternatives(words: str) -> str:
    forms = [w.replace("~", " ?").split("\x00")[0] for w in words.split()]
    return "|".join(sorted((f.replace(".", "\\.") for f in forms), key=len, reverse=True))


def _mask_dots(text: Column, before: str, after: str = "", mask: str = MASK) -> Column:
    """Masks dots by what stands before and after them. The search goes from dot to dot; what precedes is looked back at."""
    return F.regexp_replace(text, f"\\.(?<={before}\\.){after}", mask)


def _masked_abbreviations(text: Column) -> Column:
    edge = f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}{MASK}])"
    inner = f"[.{MASK}]"
    out = F.regexp_replace(text, "\\.(?:(?=\\.)|(?<=\\.\\.))", MASK)  # ellipses: their last dot below
    out = _mask_dots(out, MASK)
    out = _mask_dots(out, "\\p{N}", "(?=\\p{N})")  # decimals, dates, versions
    out = _mask_dots(out, "[\\p{L}\\p{N}_]", "(?=[\\p{Ll}\\p{N}][\\p{L}\\p{N}_.@/-]*)")  # file names, sites, inner dots of lower-case abbreviations
    for first, second in (("z", "B"), ("d", "h"), ("u", "[as]"), ("i", "d"), ("т", "[едп]"), ("[ap]", "m"), ("EE", "UU")):
        out = _mask_dots(out, f"(?<!\\p{{L}}){first}", f"(?= ?{second}\\.)")
    out = _mask_dots(out, f"{edge}(?:{_alternatives(FREE).replace(chr(92) + '.', inner)})", mask=SOFT)
    out = _mask_dots(out, f"{edge}(?iu:{_alternatives(PREFIX).replace(chr(92) + '.', inner)})")
    out = _mask_dots(out, f"(?<![\\p{{L}}\\p{{M}}\\p{{N}}])(?:{_alternatives(NUMBERED)})", f"(?=[{WS}]*\\p{{N}})")
    out = _mask_dots(out, f"(?<!\\p{{L}})(?:{'|'.join(ORDINAL_BEFORE.split())})[{WS}]\\p{{N}}{{1,3}}", f"(?=[{WS}])")
    out = _mask_dots(out, f"(?<![\\p{{N}}{MASK}])\\p{{N}}{{1,2}}", f"(?=[{WS}]+(?:{'|'.join(MONTHS.split())}))")
    # List markers open a paragraph or a line after a finished one.
    out = _mask_dots(out, f"(?:\\A|[{TERMINATORS}:…{CLOSE})”][ \\t]{{0,4}}\\n)[ \\t]{{0,8}}\\(?(?:\\p{{N}}{{1,3}}|\\p{{L}})", f"(?=[{WS}])")
    # Initials, alone or in a row.
    out = _mask_dots(out, "(?<![\\p{L}\\p{M}\\p{N}])\\p{Lu}", f"(?=[{WS}]{{0,2}}-?\\p{{Lu}})")
    # The Greek question mark is written as a semicolon too.
    return F.regexp_replace(out, f"(\\p{{IsGreek}}[)»{CLOSE}]?);(?=[{WS}]|$)", "$1" + GREEK)


def _quiet(text: Column) -> Column:
    return F.translate(text, TERMINATORS, MASK * len(TERMINATORS))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses; higher-order functions share no subexpressions."""
    return F.transform(F.array(value), use)[0]


def _masked_quotes(paragraph: Column) -> Column:
    """Quotation marks become one pair of signs; marks inside are masked but for those just before the closing sign."""
    out = F.regexp_replace(paragraph, "„([^„“”]*)[“”]", OPEN + "$1" + CLOSE)
    out = F.translate(out, "“”«»「」『』„", (OPEN + CLOSE) * 4 + OPEN)
    straight = F.transform(F.split(out, '"', -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.when(i % 2 == 1, F.lit(OPEN)).otherwise(F.lit(CLOSE)), x)))
    out = F.array_join(straight, "")

    def inside(x: Column, i: Column) -> Column:
        body = F.regexp_extract(x, f"(?s)^(.*?)[{TERMINATORS}]*[{WS}]?{CLOSE}[^{CLOSE}]*$", 1)
        closed = _let(body, lambda b: F.concat(F.lit(OPEN), _quiet(b), F.substring(x, F.length(b) + 1, F.length(x))))
        return F.when(i == 0, x).when(F.contains(x, F.lit(CLOSE)), closed).otherwise(F.concat(F.lit(OPEN), _quiet(x)))

    return F.array_join(F.transform(F.split(out, OPEN, -1), inside), "")


def _masked_brackets(paragraph: Column) -> Column:
    """Marks in a bracket that stands within a sentence are masked."""

    def remark(parts: Column, x: Column, i: Column) -> Column:
        before = F.element_at(parts, i)  # the part before, as i counts from 0
        alone = (F.trim(before) == "") | before.rlike(f"[{TERMINATORS}]{CLOSE}?[{WS}]*$") | (before.rlike(f"{CLOSE}[{WS}]*$") & ~before.rlike(f"[^{TERMINATORS}]{CLOSE}[{WS}]*$"))
        body = F.regexp_extract(x, "^[(（][^)）]*[)）]", 0)
        masked = _let(body, lambda b: F.concat(_quiet(b), F.substring(x, F.length(b) + 1, F.length(x))))
        return F.when((i == 0) | alone, x).otherwise(masked)

    return _let(F.split(paragraph, "(?=[(（])", -1), lambda parts: F.array_join(F.transform(parts, lambda x, i: remark(parts, x, i)), ""))


def _cut(paragraph: Column) -> Column:
    """Puts the separator behind every sentence of a masked paragraph."""
    end_tag = "(?:</\\p{L}+>)"
    closers = f"(?:[ \\u00A0\\u202F]?{CLOSE}|[)）\\]］】’›》]|{end_tag})*"
    quoted = f"(?:[ \\u00A0\\u202F]?{CLOSE}|’)[)）\\]’{CLOSE}]*"
    no_pause = f"(?![{WS}]*[,;:،、，；：])(?![{WS}]*[—–-][{WS}]*\\p{{Ll}})"
    item = f"(?=[{WS}]*\\n[ \\t]*\\p{{Ll}}[.){MASK}][{WS}])"
    no_lower = f"(?:(?![{WS}]*\\p{{Ll}})|{item})"
    name = "\\p{Lu}[\\p{L}\\p{M}'’-]*"
    not_said = (
        f"(?![^。！？{OPEN}{CLOSE}：:\\n]{{1,20}}(?:{SAID_HAN})[。，,！])(?!(?:と|って))"
        f"(?![{WS}]*[^।?!{OPEN}{CLOSE}\\n]{{1,40}}(?:{SAID_HINDI})[{WS}]*।)"
        f"(?![{WS}]*(?:{SAID_ARABIC})[{WS}][^:.؟!{OPEN}{CLOSE}\\n]*[.؟!])"
        f"(?![{WS}]+(?:{name}[{WS}]){{1,3}}(?:{SAID_LATIN})[ ,.;])"
    )
    opens = f"[\\p{{Lu}}\\p{{Lo}}{OPEN}‘¿¡(（《]"
    gap = f"(?=[{WS}]|{opens}|[—–])"
    out = F.regexp_replace(paragraph, f"([{TERMINATORS}]+{quoted})(?!\\z){no_pause}{no_lower}{not_said}", "$1" + CUT)
    wide = f"(?<=[！？。｡।॥][{CLOSE})）】》]{{0,3}})"
    out = F.regexp_replace(out, f"([{STRONG}][{TERMINATORS}]*(?![ \\u00A0\\u202F]?{CLOSE}|’){closers})(?!{CUT})(?!\\z){no_pause}(?:{gap}|{wide}(?![{TERMINATORS}]))", "$1" + CUT)
    out = F.regexp_replace(out, f"((?<![{STRONG}])[.{SOFT}](?![{STRONG}])(?![ \\u00A0\\u202F]?{CLOSE}|’){closers})(?!{CUT})(?!\\z){no_pause}{no_lower}{gap}", "$1" + CUT)
    # Thai: a blank between Thai signs that are no digits.
    thai = "\\u0E01-\\u0E4F\\u0E5A-\\u0E5B"
    return F.regexp_replace(out, f"([{thai}][{CLOSE})]?[ \\u00A0]+)(?=[{OPEN}(]?[{thai}])", "$1" + CUT)


def sentence_spans(text: Column) -> Column:
    """ARRAY<STRUCT<start_pos INT, end_pos INT>> of a text's sentences in order."""
    plain = F.regexp_replace(text, "[\\uE000-\\uE01F]", PLAIN)
    broken = F.regexp_replace(plain, f"(\\n[{WS}]*\\n[{WS}]*|\\u2029[{WS}]*)", "$1" + CUT)
    paragraphs = F.transform(F.split(broken, CUT, -1), lambda p: _cut(_masked_brackets(_masked_quotes(_masked_abbreviations(p)))))
    parts = F.split(F.array_join(paragraphs, CUT), CUT, -1)
    sized = F.transform(
        parts,
        lambda p: F.struct(F.length(p).alias("n"), (F.length(p) - F.length(F.regexp_replace(p, f"^[{WS}]+", ""))).alias("lead"), F.length(F.regexp_replace(p, f"[{WS}]+$", "")).alias("solid")),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_pos:int,end_pos:int>>").alias("spans"))
    merged = F.aggregate(
        sized,
        begin,
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["solid"] == 0, acc["spans"])
            .otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).cast("int").alias("start_pos"), (acc["at"] + p["solid"]).cast("int").alias("end_pos")))))
            .alias("spans"),
        ),
    )
    return merged["spans"]


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, start_pos, end_pos, sentence), one row per sentence of every row with text."""
    spans = df.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), sentence_spans(F.col(text_col)).alias("spans"))
    # The outer form: a plain explode makes the optimizer compute the spans three times, for a filter on their size.
    rows = spans.select("id", "text", F.posexplode_outer("spans").alias("sentence_no", "span")).filter("span IS NOT NULL")
    text = F.substring(F.col("text"), F.col("span.start_pos") + 1, F.col("span.end_pos") - F.col("span.start_pos"))
    return rows.select("id", "sentence_no", "span.start_pos", "span.end_pos", text.alias("sentence"))


def found(documents: DataFrame) -> DataFrame:
    """Query p8_found: (doc_id, start_pos, end_pos)."""
    return sentences(documents).select(F.col("id").alias("doc_id"), "start_pos", "end_pos")


def document_sentences(documents: DataFrame) -> DataFrame:
    """Query p8_sentences: every sentence with its number and text."""
    return sentences(documents).withColumnRenamed("id", "doc_id")
