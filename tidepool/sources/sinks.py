"""Batch readers and writers around the tables: JSON-lines with file names,
append-only logs, full replaces, and publishing a bound JSON parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECISION_TYPE = "array<struct<patient_ids:string,decision:string,decided_by:string,decided_at:string,note:string>>"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Many JSON-lines files with a fixed schema (files missing a field give
    NULLs: union by name), plus the source file of each row."""
    return spark.read.schema(schema).json(path).withColumn("filename", F.col("_metadata.file_path"))


def append_log(df: DataFrame, path: str) -> None:
    """Append-only JSON-lines log: existing files are never rewritten."""
    df.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Recomputed table: replace all rows (dynamic partition overwrite when
    partitioned, so only the partitions written are replaced)."""
    w = df.write.mode("overwrite")
    if partition_by:
        df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def decisions_from_parameter(spark: SparkSession, decisions_json: str) -> DataFrame:
    """Rows of a decisions list passed as ONE bound parameter: the text is
    never spliced into SQL."""
    return spark.sql(
        f"SELECT d.* FROM (SELECT explode(from_json(:decisions, '{DECISION_TYPE}')) AS d)",
        args={"decisions": decisions_json},
    ).withColumn("decided_at", F.to_timestamp_ntz("decided_at"))


def publish_decisions(spark: SparkSession, decisions_json: str, path: str) -> int:
    """Replace the decisions table with the given list; returns its row count."""
    df = decisions_from_parameter(spark, decisions_json)
    replace_table(df, path)
    return spark.read.parquet(path).count()
