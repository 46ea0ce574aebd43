"""Where rows go between layers: a balance for each window.

Every row of a layer's input is given the first reason that drops it, or goes
on; counting by window and reason is one pass. Set beside what the next layer
holds, a window's rows must add up: in = out + dropped. What does not is
``unexplained``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = "kept"


def reason(reasons: Mapping[str, Column]) -> Column:
    """The name of the first that holds (null counts as no), else ``KEPT``."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in reasons.items()], F.lit(KEPT))


def mark_duplicates(df: DataFrame, key: str, order: Sequence[str], alias: str = "duplicate") -> DataFrame:
    """``alias``: an earlier row has the same key (a null key has no duplicates).
    ``order`` tells the copies of a key apart. The first of each key is found by
    partial aggregation and met again by key and order, so a key with very many
    copies is spread over tasks."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    first = first.select(F.col(key).alias("__key"), *[F.col(f"__first.{c}").alias(f"__{c}") for c in order], F.lit(True).alias("__is_first"))
    on = [F.col(key) == F.col("__key"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order]]
    met = df.join(first, on, "left")
    return met.withColumn(alias, F.col(key).isNotNull() & F.col("__is_first").isNull()).drop("__key", "__is_first", *[f"__{c}" for c in order])


def mark_late(df: DataFrame, event_ts: str, arrival: str, every: str, delay_s: int, alias: str = "late") -> DataFrame:
    """``alias``: the row arrived behind the watermark, which moves between
    batches of arrival (``every``) to the latest event time seen less
    ``delay_s``. The watermark comes from one row for each batch."""
    dealt = df.withColumn("__batch", F.window(arrival, every)["start"])
    tops = dealt.groupBy(F.col("__batch").alias("__b")).agg(F.max(event_ts).alias("__top"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a batch
    marks = tops.select("__b", (F.max("__top").over(before) - F.make_dt_interval(secs=F.lit(delay_s))).alias("__mark"))
    met = dealt.join(marks, F.col("__batch") == F.col("__b"), "left")
    return met.withColumn(alias, F.coalesce(F.col(event_ts) < F.col("__mark"), F.lit(False))).drop("__batch", "__b", "__mark")


def ledger(layer: str, rows: DataFrame, at: Column, every: str, reasons: Mapping[str, Column]) -> DataFrame:
    """layer, window_start, rows_in, dropped (a count for each reason that
    occurs, by name) and rows_out - in one pass over the rows."""
    counted = rows.groupBy(F.window(at, every)["start"].alias("window_start"), reason(reasons).alias("why")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("window_start").agg(
        F.sum("n").alias("rows_in"),
        *[F.coalesce(F.sum(F.when(F.col("why") == name, F.col("n"))), F.lit(0)).alias(name) for name in reasons],
        F.coalesce(F.sum(F.when(F.col("why") == KEPT, F.col("n"))), F.lit(0)).alias("rows_out"),
    ).withColumn("layer", F.lit(layer))


def balance(book: DataFrame, found: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """The ledger beside ``found`` (window_start, rows_found: what the next layer
    holds): unexplained = in - dropped - found, by window; a window that only one
    side knows counts as zero on the other."""
    met = book.join(found, "window_start", "full_outer")
    counts = ["rows_in", *reasons, "rows_out", "rows_found"]
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    dropped = sum((F.col(r) for r in reasons), F.lit(0))
    return met.withColumn("unexplained", F.col("rows_in") - dropped - F.col("rows_found"))
