"""Strict record contract, schema drift and mask verification as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.contracts import ALERT_BANDS, ALLOWED_EVENT_TYPES, EVENT_SCHEMA, VITAL_ITEMS
from tidepool.sources.events import once


def _band_outside(item, value):
    out = F.lit(False)
    for name, (low, high) in ALERT_BANDS.items():
        out = F.when(item == name, (value < low) | (value > high)).otherwise(out)
    return out


#: Envelope fields a record may leave out (fixed values); any other field of
#: the envelope, and every field of a sub-record that is there, is required.
OPTIONAL_FIELDS = ("schema_version", "patient", "encounter", "transfer", "vital", "notes")


def _field_checks(raw: Column, schema: T.StructType, prefix: str = "", optional: Sequence[str] = ()) -> list[Column]:
    """A violation for each field that is missing though required, or that is
    there in the raw record and could not be read as its type."""
    out: list[Column] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        sent = F.variant_get(raw, f"$.{path}", "variant")
        there = sent.isNotNull() & ~F.is_variant_null(sent)
        if f.name not in optional and path != "event_type":
            out.append(F.when(~there, F.lit(f"missing:{path}")))
        out.append(F.when(there & F.col(path).isNull(), F.lit(f"wrong_type:{path}")))
        if isinstance(f.dataType, T.StructType):
            out += [F.when(F.col(path).isNotNull(), c) for c in _field_checks(raw, f.dataType, f"{path}.")]
    return out


def validate_contract(bronze: DataFrame, raw_col: str = "_raw") -> DataFrame:
    """Per parsed event: ``violations`` (unknown field, unknown/missing event
    type, unknown item, missing required field, wrong type, corrupt) and
    ``out_of_range`` - a value outside its alert band is flagged, never a
    violation by itself. The raw text is parsed once, to a variant."""
    item = F.col("vital.itemid")
    readable = F.col("_corrupt_record").isNull()
    bronze = once(bronze, "__raw", F.try_parse_json(F.col(raw_col)))
    raw = F.col("__raw")
    checks = [
        F.when(~readable, F.lit("corrupt_record")),
        F.when(F.col("_rescued_data").isNotNull(), F.lit("unknown_field")),
        F.when(F.col("event_type").isNull(), F.lit("missing_event_type")),
        F.when(~F.col("event_type").isin(*ALLOWED_EVENT_TYPES), F.lit("unknown_event_type")),
        F.when(F.col("vital").isNotNull() & ~item.isin(*VITAL_ITEMS), F.lit("unknown_item")),
        *(F.when(readable, c) for c in _field_checks(raw, EVENT_SCHEMA, optional=OPTIONAL_FIELDS)),
    ]
    bronze = once(bronze, "violations", F.array_sort(F.array_compact(F.array(*checks))))
    return bronze.withColumns(
        {
            "is_valid": F.size("violations") == 0,
            "out_of_range": F.coalesce(_band_outside(item, F.col("vital.value")), F.lit(False)),
        }
    ).drop("__raw")


def schema_drift(raw: DataFrame, expected: Sequence[str], raw_col: str = "_raw") -> DataFrame:
    """Top-level keys seen in the feed vs the contract: one row per drifted
    field, ``kind`` = missing | unexpected. The distinct key set is a
    partial aggregate (small: number of distinct keys)."""
    observed = (
        raw.select(F.explode(F.json_object_keys(F.col(raw_col))).alias("field"))
        .distinct()
    )
    spark = raw.sparkSession
    exp = spark.createDataFrame([(f,) for f in expected], "field string")
    missing = exp.join(observed, "field", "left_anti").select(F.lit("missing").alias("kind"), "field")
    unexpected = observed.join(exp, "field", "left_anti").select(F.lit("unexpected").alias("kind"), "field")
    return missing.unionByName(unexpected)


def mask_check(df: DataFrame, columns: Sequence[str], literal: str) -> DataFrame:
    """Rows, and rows whose value equals the mask literal, per column."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col(c) == literal).alias(f"masked_{c}") for c in columns],
    )
