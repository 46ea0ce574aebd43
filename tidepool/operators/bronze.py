"""Bronze: flatten the parsed payload; never drop a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.contracts import EVENT_SCHEMA


def stamp(df: DataFrame, ingested_at: Column | str | None = None, col: str = "_ingested_at") -> DataFrame:
    """Add the ingestion time; pass a value to make the run reproducible."""
    value = F.current_timestamp() if ingested_at is None else F.lit(ingested_at).cast("timestamp")
    return df.withColumn(col, value)


def bronze_flatten(raw: DataFrame, ingested_at: str | None = None) -> DataFrame:
    """Payload fields as columns (sub-structs kept), plus the corrupt record,
    source key and arrival time, stamped with the ingestion time."""
    fields = [F.col(f"payload.{f.name}").alias(f.name) for f in EVENT_SCHEMA.fields]
    extra = [c for c in ("_corrupt_record", "_rescued_data", "kafka_key", "kafka_timestamp") if c in raw.columns]
    return stamp(raw.select(*fields, *extra), ingested_at)
