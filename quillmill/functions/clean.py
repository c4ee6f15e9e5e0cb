"""Removal of boilerplate around and inside texts of a public-domain library, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import let, strip, word_count

#: Markers of the start, tried in this order.
START_MARKERS = [
    r"\*\*\* START OF (THIS|THE) PROJECT GUTENBERG EBOOK .+? \*\*\*",
    r"START OF (THIS|THE) PROJECT GUTENBERG EBOOK",
    r"\*\*\*START OF THE PROJECT GUTENBERG EBOOK",
    r"The Project Gutenberg eBook of .+?, by",
]
#: Markers of the end, tried in this order.
END_MARKERS = [
    r"\*\*\* END OF (THIS|THE) PROJECT GUTENBERG EBOOK .+? \*\*\*",
    r"END OF (THIS|THE) PROJECT GUTENBERG EBOOK",
    r"\*\*\*END OF THE PROJECT GUTENBERG EBOOK",
    r"End of (the )?Project Gutenberg",
]
#: Lines of licences.
LICENSE_LINES = [
    r"Project Gutenberg.{0,50}(License|Terms|Conditions)",
    r"Section \d+\..+?Information about.+?Project Gutenberg",
    r"Please check the Project Gutenberg.+?pages",
    r"donations? (are|is) gratefully accepted",
    r"www\.gutenberg\.(org|net)",
    r"Most people start at our (Web site|website)",
    r"Information about (Donations|the Mission)",
    r"HOW TO DONATE",
    r"Literary Archive Foundation",
    r"INDEMNITY.*?direct or indirect",
    r"This (Web site|website) includes information about Project Gutenberg",
]


def without_header(text: Column, markers: list[str] = START_MARKERS) -> Column:
    """What follows the first place of the first marker that occurs, without leading line breaks."""
    cases = [F.when(text.rlike(f"(?is){m}"), F.regexp_replace(F.regexp_replace(text, rf"(?is)\A.*?{m}", ""), r"\A\n+", "")) for m in markers]
    return F.coalesce(*cases, text)


def without_footer(text: Column, markers: list[str] = END_MARKERS) -> Column:
    """What precedes the first place of the first marker that occurs, without trailing line breaks."""
    cases = [F.when(text.rlike(f"(?is){m}"), F.regexp_replace(F.regexp_replace(text, rf"(?is){m}.*\z", ""), r"\n+\z", "")) for m in markers]
    return F.coalesce(*cases, text)


def without_licenses(text: Column, patterns: list[str] = LICENSE_LINES) -> Column:
    """Drops each licence line and the lines after it up to and including the next blank one."""
    rule = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        bad = line.rlike(rule)
        blank = strip(line) == ""
        skip = F.when(bad, True).when(acc["skip"] & blank, False).otherwise(acc["skip"])
        keep = ~bad & ~acc["skip"]
        return F.struct(skip.alias("skip"), F.when(keep, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"))

    # Texts without such a line are left alone: no fold over their lines.
    return F.when(text.rlike(rule), F.array_join(F.aggregate(F.split(text, "\n", -1), start, step)["kept"], "\n")).otherwise(text)


def normalized(text: Column) -> Column:
    """Single blanks, at most one blank line in a row, stripped lines, stripped text; in this order."""
    out = F.regexp_replace(F.regexp_replace(text, " +", " "), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(out, "\n", -1), strip), "\n"))


def cleaned(text: Column) -> Column:
    return let(without_footer(without_header(text)), lambda t: normalized(without_licenses(t)))


def cleaning_stats(text: Column) -> Column:
    """STRUCT<text, original_words, cleaned_words, removed_words, excessive>: excessive if over nine tenths went."""
    return let(
        cleaned(text),
        lambda t: F.struct(
            t.alias("text"), word_count(text).alias("original_words"), word_count(t).alias("cleaned_words"), (word_count(text) - word_count(t)).alias("removed_words"), (word_count(t) < word_count(text) * 0.1).alias("excessive")
        ),
    )
