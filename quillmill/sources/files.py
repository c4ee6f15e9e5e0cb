"""Smaller sources and sinks: batch lists, prompt files, table snapshots, DDL scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.schemas import BATCH_CONFIG

#: Values for entries that leave them out.
BATCH_DEFAULTS = {"age_range": "8-12", "reading_level": "intermediate", "genre": "fiction", "questions": 3}


def batch_config(spark: SparkSession, path: str, defaults: dict = BATCH_DEFAULTS) -> DataFrame:
    """A JSON list of books to process, with defaults for what an entry leaves out."""
    rows = spark.read.schema(BATCH_CONFIG).option("multiLine", True).json(path)
    return rows.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()})


def write_prompts(prompts: DataFrame, path: str, column: str = "prompt") -> None:
    prompts.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Writes every table under its name; read back with ``restore``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in names}


def run_script(spark: SparkSession, script: str) -> int:
    """Runs the statements of a DDL script; gives their number. Statements end with a semicolon at a line's end."""
    statements = [s.strip() for s in script.replace(";\r\n", ";\n").split(";\n") if s.strip().strip(";")]
    for s in statements:
        spark.sql(s.rstrip(";"))
    return len(statements)


def alive(spark: SparkSession) -> str:
    """The version that answers, as a check that the session works."""
    return spark.sql("SELECT version() AS v").first()["v"]
