"""Schemas of the library tables."""

from __future__ import annotations

from pyspark.sql import types as T

VOCABULARY = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("word", "definition", "example", "grade_level")]))
BATCH_CONFIG = "gutenberg_id INT, filepath STRING, age_range STRING, reading_level STRING, genre STRING, max_words INT, questions INT"
GENERATED = "questions ARRAY<STRUCT<text STRING, question STRING, keywords ARRAY<STRING>, difficulty STRING, questions ARRAY<STRUCT<text STRING, question STRING, keywords ARRAY<STRING>, difficulty STRING>>>>, vocabulary ARRAY<STRUCT<word STRING, definition STRING, example STRING>>, tags ARRAY<STRING>"
TASK = "id STRING, task_type STRING, priority INT, status STRING, book_id STRING, chapter_id STRING, payload STRING, attempts INT, locked_at TIMESTAMP_NTZ, timeout_at TIMESTAMP_NTZ, error_message STRING, created_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ"
