"""Event-time tumbling-window rollups (the live vitals view).

The same function serves batch recompute and streaming: on a stream, call it
after ``withWatermark`` and run in ``update``/``complete`` mode, or recompute
in batch so the newest, still-filling window is visible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_rollup(
    df: DataFrame,
    ts: str,
    group_cols: Sequence[str],
    value: str,
    band: tuple[float, float],
    duration: str = "15 minutes",
    avg_alias: str = "avg_value",
) -> DataFrame:
    """Per (tumbling window, groups): avg value, count outside ``band``, count."""
    low, high = band
    outside = (F.col(value) < low) | (F.col(value) > high)
    return (
        df.groupBy(F.window(ts, duration).alias("w"), *group_cols)
        .agg(
            F.avg(value).alias(avg_alias),
            F.sum(F.when(outside, 1).otherwise(0)).alias("out_of_range_count"),
            F.count(F.lit(1)).alias("reading_count"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *group_cols,
            avg_alias,
            "out_of_range_count",
            "reading_count",
        )
    )


def mark_complete(rollup: DataFrame, high_water) -> DataFrame:
    """``is_complete`` = the window ended at or before the newest event time
    seen (``high_water``, a value or a scalar subquery). The newest window
    stays visible with ``is_complete = false`` instead of being hidden."""
    return rollup.withColumn("is_complete", F.col("window_end") <= (high_water if isinstance(high_water, Column) else F.lit(high_water)))
