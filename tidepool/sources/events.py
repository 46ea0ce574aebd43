"""Event sources: Kafka or JSON-lines files, permissive parsing, rescue.

Every reader returns the same columns ``(kafka_key, kafka_timestamp, _raw)``
so downstream code cannot tell which source ran (source switch S3).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import EVENT_SCHEMA


def read_kafka(spark: SparkSession, bootstrap: str, topic: str, starting_offsets: str = "latest") -> DataFrame:
    """Subscribe to a topic; key/value as text, broker timestamp kept; missing
    offsets do not fail the stream. Needs the Kafka connector on the classpath."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("failOnDataLoss", "false")
        .load()
        .select(
            F.col("key").cast("string").alias("kafka_key"),
            F.col("timestamp").alias("kafka_timestamp"),
            F.col("value").cast("string").alias("_raw"),
        )
    )


def _file_lines(reader, path: str) -> DataFrame:
    return reader.text(path).select(
        F.lit(None).cast("string").alias("kafka_key"),
        F.col("_metadata.file_modification_time").alias("kafka_timestamp"),
        F.col("value").alias("_raw"),
    )


def read_files(spark: SparkSession, path: str, stream: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines files: each raw line kept as text, arrival time = the file's
    modification time, NULL key."""
    if not stream:
        return _file_lines(spark.read, path)
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _file_lines(reader, path)


def read_events(spark: SparkSession, source: str, *, path: str | None = None, bootstrap: str | None = None,
                topic: str = "patient_events", stream: bool = True) -> DataFrame:
    """Source switch by setting: ``kafka`` or ``files``."""
    if source == "kafka":
        return read_kafka(spark, bootstrap or "localhost:9092", topic)
    if source == "files":
        return read_files(spark, path, stream=stream)
    raise ValueError(f"unknown events source {source!r}; use 'kafka' or 'files'")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is computed once a row: a generator of one
    element, which the optimizer does not copy into each expression that uses
    it (it would copy a plain column)."""
    return df.withColumn(name, F.explode(F.array(value)))


def parse_permissive(raw: DataFrame, schema: T.StructType = EVENT_SCHEMA, raw_col: str = "_raw",
                     keep_raw: bool = False) -> DataFrame:
    """Parse JSON text into ``payload``; keep the raw text in
    ``_corrupt_record`` when the payload is NULL or has neither ``event_id``
    nor ``event_type`` (malformed bytes parse to an all-NULL struct)."""
    opts = {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}
    parsed = once(raw, "payload", F.from_json(F.col(raw_col), schema, opts))
    unparsed = F.col("payload").isNull() | (F.col("payload.event_id").isNull() & F.col("payload.event_type").isNull())
    keep = [c for c in raw.columns if keep_raw or c != raw_col]
    return parsed.select(*keep, "payload", F.when(unparsed, F.col(raw_col)).alias("_corrupt_record"))


def _unknown_keys(obj: Column, known: Sequence[str]) -> Column:
    known_arr = F.array(*[F.lit(k) for k in known])
    return F.map_filter(obj, lambda k, v: ~F.array_contains(known_arr, k))


def _prefixer(prefix: str):
    return lambda k, v: F.concat(F.lit(prefix), k)


def rescue_unknown_fields(df: DataFrame, contract: Mapping[str, Sequence[str]], raw_col: str = "_raw",
                          out_col: str = "_rescued_data") -> DataFrame:
    """Add ``_rescued_data``: a JSON object of every key not in the contract
    (nested keys as ``parent.child``), or NULL when nothing is unknown.

    ``contract`` maps "" to the top-level names and each struct field to its
    child names (``contracts.contract_keys``). Nothing is dropped and nothing
    fails: unknown data is carried next to the parsed row.
    """
    df = once(df, "__top", F.from_json(F.col(raw_col), "map<string,string>"))
    top = F.col("__top")
    parts = [_unknown_keys(top, contract[""])]
    for parent, children in contract.items():
        if not parent:
            continue
        child = F.from_json(top[parent], "map<string,string>")
        unknown = _unknown_keys(child, children)
        parts.append(F.transform_keys(unknown, _prefixer(parent + ".")))
    merged = F.map_concat(*[F.coalesce(p, F.create_map().cast("map<string,string>")) for p in parts])
    df = once(df, "__unknown", merged)
    return df.withColumn(out_col, F.when(F.size("__unknown") > 0, F.to_json("__unknown"))).drop("__top", "__unknown")


def rescued_keys(col: str = "_rescued_data") -> Column:
    """Sorted, comma-joined key names of a rescue column (NULL if none)."""
    return F.array_join(F.array_sort(F.map_keys(F.from_json(F.col(col), "map<string,string>"))), ",")
