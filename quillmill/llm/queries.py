"""The queries of the training-data operators, and DuckDB SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import levels, neardup, packing, pieces, residue, sentences, tokens, truncation
from quillmill.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: pieces.oversized(table(s, d, "chapters")),
    "p1_pieces": lambda s, d: pieces.chapter_pieces(table(s, d, "chapters")),
    "p2_found": lambda s, d: truncation.found(s, table(s, d, "books"), table(s, d, "questions")),
    "p2_sources": lambda s, d: truncation.report(s, table(s, d, "books"), table(s, d, "questions")),
    "p3_found": lambda s, d: neardup.found(table(s, d, "chapters"), table(s, d, "books")),
    "p3_groups": lambda s, d: neardup.membership(table(s, d, "chapters"), table(s, d, "books")),
    "p4_found": lambda s, d: levels.found(table(s, d, "chapters"), table(s, d, "books"), table(s, d, "level_samples")),
    "p4_books": lambda s, d: levels.book_levels(table(s, d, "chapters"), table(s, d, "level_samples")),
    "p4_chapters": lambda s, d: levels.chapter_levels(table(s, d, "chapters"), table(s, d, "level_samples")),
    "p5_found": lambda s, d: residue.found(s, table(s, d, "books"), table(s, d, "questions")),
    "p5_clean": lambda s, d: residue.clean(s, table(s, d, "books"), table(s, d, "questions")),
    "p5_validation": lambda s, d: residue.validation(s, table(s, d, "books"), table(s, d, "questions")),
    "p6_ids": lambda s, d: tokens.corpus_ids(s, table(s, d, "documents")),
    "p7_containers": lambda s, d: packing.packed_documents(s, table(s, d, "documents")),
    "p8_found": lambda s, d: sentences.found(table(s, d, "documents")),
    "p8_sentences": lambda s, d: sentences.document_sentences(table(s, d, "documents")),
}

#: White space in the Unicode sense, as one RE2 class.
_WS = r"[\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

ORACLE: dict[str, str] = {
    "p1_found": f"""
        SELECT DISTINCT id AS chapter_id FROM chapters
        WHERE len(list_filter(regexp_split_to_array(content, '{_WS}+'), lambda w: w <> '')) > 800""",
}
