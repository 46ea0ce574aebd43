"""Silent sources: who sent nothing for longer than allowed, and since when.

Silence is found by what is missing, so every source is first reduced to its
earliest and latest event in each stretch of time as long as the limit (a
grouped aggregate, combined before the shuffle). Within a stretch no gap can
exceed the limit; only the gaps between stretches are left to be compared, and a
source that sends a third of all events has no more of them than any other.
``streaming.silence`` gives the same alerts while the events come in.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def stretches(events: DataFrame, key: str, ts: str, limit_s: int) -> DataFrame:
    """key, stretch, earliest and latest (microseconds)."""
    at = micros(ts)
    return (
        events.where(F.col(ts).isNotNull())
        .groupBy(F.col(key).alias("source"), F.floor(at / (limit_s * 1_000_000)).alias("stretch"))
        .agg(F.min(at).alias("earliest"), F.max(at).alias("latest"))
    )


def silences(events: DataFrame, key: str, ts: str, limit_s: int, until: Column | None = None, delay_s: int = 0) -> DataFrame:
    """source, silent_since, alert_at and seen_again (null: still silent) for
    every time after which a source sent nothing for ``limit_s`` seconds.

    ``until``: how far the events are known (a timestamp; default: the latest of
    all events less ``delay_s``). An alert falls due ``limit_s`` after the last
    event; those not due by then are left out. Rows without a time do not count,
    rows without a source are one source.
    """
    per = stretches(events, key, ts, limit_s)
    known = micros(until) if until is not None else per.agg(F.max("latest") - delay_s * 1_000_000).scalar()
    due = F.col("latest") + limit_s * 1_000_000
    again = F.lead("earliest").over(Window.partitionBy("source").orderBy("stretch"))
    found = per.withColumn("again", again).where((F.col("again").isNull() | (F.col("again") > due)) & (due <= known))
    return found.select(
        "source",
        F.timestamp_micros("latest").alias("silent_since"),
        F.timestamp_micros(due).alias("alert_at"),
        F.timestamp_micros("again").alias("seen_again"),
    )


def layer_freshness(layers: Mapping[str, DataFrame], now: Column, limit_s: Mapping[str, int]) -> DataFrame:
    """One row for each layer: its newest time, how far it lags behind ``now``,
    whether that is beyond its limit, and the first stale layer upstream - where
    to look. ``layers`` in flow order; each a frame of one timestamp column."""
    parts = [
        df.agg(F.max(F.col(df.columns[0]).cast("timestamp")).alias("newest")).select(
            F.lit(i).alias("position"), F.lit(name).alias("layer"), "newest", F.lit(limit_s[name]).cast("long").alias("limit_s")
        )
        for i, (name, df) in enumerate(layers.items())
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    lag = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros("newest")) / 1_000_000)
    stale = F.coalesce(F.col("lag_s") > F.col("limit_s"), F.lit(True))
    rows = rows.withColumn("lag_s", lag).withColumn("stale", stale)
    first = rows.where("stale").agg(F.min_by("layer", "position")).scalar()
    return rows.select("layer", "newest", "lag_s", "stale", F.when(F.col("stale"), first).alias("look_at"))
