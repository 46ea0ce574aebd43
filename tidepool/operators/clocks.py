"""Clocks of sources, judged by when their events arrive.

For each source the delay (arrival less event time) is binned and the bin that
occurs most often taken: a robust offset, as late rows and stray stamps spread
over other bins. Its mean is the residual within. Rows whose event time is a
thousand times too small or large (seconds read as milliseconds, or the other
way) are told by the ratio instead and counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600
_DAY_US = 86_400 * 1_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _unit_error(event: Column, arrival: Column) -> Column:
    """1000 where the event time must be multiplied, -1000 where divided, else 1."""
    small = F.abs(event * 1000 - arrival) < _DAY_US
    large = F.abs(F.floor(event / 1000) - arrival) < _DAY_US
    apart = F.abs(event - arrival) >= _DAY_US
    return F.when(apart & small, 1000).when(apart & large, -1000).otherwise(1)


def clock_offsets(df: DataFrame, source: str, event_ts: str, arrival_ts: str, bin_s: int = 60, tolerance_s: int = 600, usual_s: float | None = None) -> DataFrame:
    """One row for each source: rows, unit (1, 1000 or -1000, as most rows have),
    delay_s (the usual delay of its rows in seconds), offset_s (what its clock is
    off: the delay less the usual delay of all sources) and clock:

    * ``seconds_as_millis`` / ``millis_as_seconds``: the unit is wrong;
    * ``time_zone``: off by whole hours, within the tolerance;
    * ``skew``: off by something else; ``ok``: within the tolerance.

    ``usual_s``: the usual delay (default: the median of the sources' delays).
    Rows without either time do not count; ties go to the smaller delay."""
    event, arrival = micros(event_ts), micros(arrival_ts)
    rows = df.where(F.col(event_ts).isNotNull() & F.col(arrival_ts).isNotNull()).select(
        F.col(source).alias("source"), event.alias("event"), arrival.alias("arrival")
    )
    rows = rows.withColumn("unit", _unit_error(F.col("event"), F.col("arrival")))
    right = F.when(F.col("unit") == 1000, F.col("event") * 1000).when(F.col("unit") == -1000, F.floor(F.col("event") / 1000)).otherwise(F.col("event"))
    delay = (F.col("arrival") - right) / 1_000_000
    binned = rows.groupBy("source", "unit", F.floor(delay / bin_s).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(delay).alias("mean"))
    per_unit = binned.groupBy("source", "unit").agg(
        F.sum("n").alias("n"), F.max_by("mean", F.struct("n", (-F.col("bin")).alias("b"))).alias("delay_s")
    )
    per = per_unit.groupBy("source").agg(
        F.sum("n").alias("rows"),
        F.max_by("unit", F.struct("n", "unit")).alias("unit"),
        F.max_by("delay_s", F.struct("n", "unit")).alias("delay_s"),
    )
    usual = F.lit(usual_s) if usual_s is not None else per.agg(F.median("delay_s")).scalar()
    per = per.withColumn("offset_s", F.round(F.col("delay_s") - usual, 3))
    off = F.abs("offset_s")
    hours = F.round(F.col("offset_s") / HOUR)
    clock = (
        F.when(F.col("unit") == 1000, "seconds_as_millis")
        .when(F.col("unit") == -1000, "millis_as_seconds")
        .when(off <= tolerance_s, "ok")
        .when((hours != 0) & (F.abs(F.col("offset_s") - hours * HOUR) <= tolerance_s), "time_zone")
        .otherwise("skew")
    )
    return per.select("source", "rows", "unit", F.round("delay_s", 3).alias("delay_s"), "offset_s", clock.alias("clock"))


def corrected_time(df: DataFrame, offsets: DataFrame, source: str, event_ts: str, alias: str = "corrected_ts") -> DataFrame:
    """``df`` with the event time as the source's clock should have had it: unit
    errors undone, whole hours or the skew added; clocks that are ok, and sources
    without a verdict, keep theirs. Offsets are one row a source."""
    event = micros(event_ts)
    fixed = (
        F.when(F.col("clock") == "seconds_as_millis", event * 1000)
        .when(F.col("clock") == "millis_as_seconds", F.floor(event / 1000))
        .when(F.col("clock") == "time_zone", event + (F.round(F.col("offset_s") / HOUR) * HOUR * 1_000_000).cast("long"))
        .when(F.col("clock") == "skew", event + (F.col("offset_s") * 1_000_000).cast("long"))
        .otherwise(event)
    )
    own = offsets.select(F.col("source").alias("__source"), "clock", "offset_s")
    met = df.join(own, F.col(source).eqNullSafe(F.col("__source")), "left")
    return met.withColumn(alias, F.timestamp_micros(fixed.cast("long"))).drop("__source", "clock", "offset_s")
