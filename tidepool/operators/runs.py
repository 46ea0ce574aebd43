"""Runs of equal values (a stuck sensor), whole across segments.

Inside a (key, segment) a run is an island of equal neighbours. A segment's
summary is its first and its last run: only they can go on in the neighbouring
segments, and a segment that is one run passes it through. So the runs that cross
borders are joined from two rows a segment, whatever a segment holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, segment: str) -> DataFrame:
    """keys, value, length, first and last (of the first order column) of every
    run of equal neighbouring values in ``order`` (a null equals a null).

    ``segment`` must not decrease along ``order``; one (key, segment) is what a
    task sorts at a time."""
    keys, part = list(keys), [*keys, segment]
    ts = order[0]
    inside = Window.partitionBy(*part).orderBy(*order)
    changed = (F.row_number().over(inside) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(inside))
    marked = df.withColumn("__run", F.sum(changed.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # The value is the same in the whole run, so any of its rows gives it; sums of a null run stay exact.
    local = marked.groupBy(*part, "__run").agg(
        F.max(value).alias(value), F.count(F.lit(1)).alias("length"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    ends = local.groupBy(*part).agg(F.max("__run").alias("__runs"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"e.{c}")) for c in part]
    local = local.alias("l").join(ends.alias("e"), on).select("l.*", "e.__runs")
    border = (F.col("__run") == 1) | (F.col("__run") == F.col("__runs"))
    out = [*keys, value, "length", "first", "last"]
    # Border runs of a key in order, two a segment: equal neighbours from different segments are one run.
    across = Window.partitionBy(*keys).orderBy(segment, "__run")
    follows = (F.lag(segment).over(across).isNotNull()) & (F.lag(segment).over(across) != F.col(segment)) & F.col(value).eqNullSafe(F.lag(value).over(across))
    joined = local.where(border).withColumn("__on", F.when(follows, 0).otherwise(1))
    joined = joined.withColumn("__chain", F.sum("__on").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy(*keys, "__chain").agg(
        F.max(value).alias(value), F.sum("length").alias("length"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return local.where(~border).select(*out).unionByName(whole.select(*out))


def flatlines(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, segment: str, least: int, least_s: int) -> DataFrame:
    """Runs of at least ``least`` readings over at least ``least_s`` seconds; a
    run of nulls is no flatline."""
    lasting = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp")) >= least_s * 1_000_000
    return runs(df, keys, order, value, segment).where((F.col("length") >= least) & lasting & F.col(value).isNotNull())
