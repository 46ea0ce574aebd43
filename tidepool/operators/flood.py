"""Keys that send more than a share of all rows, window by window.

A mergeable sketch of frequent items (bounded by the share, whatever the number
of keys) names the candidates of each window; a second pass counts the
candidates exactly. Keys that are not frequent are never shuffled one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracked_items(share: float) -> int:
    """How many items the sketch keeps so that its error is under a quarter of
    the share: it is at most 3.5 / items of the rows."""
    return math.ceil(14 / share)


def candidates(df: DataFrame, window: str, key: str, share: float) -> DataFrame:
    """window, key of every key that may hold ``share`` of a window's rows. With
    that error, whoever outranks such a key holds three quarters of the share,
    so 4 / (3 * share) places are enough for all of them."""
    items = tracked_items(share)
    if items > 1_000_000:
        raise ValueError("a sketch keeps a million items at most: take a larger share")
    places = math.ceil(4 / (3 * share)) + 1
    top = F.expr(f"approx_top_k(`{key}`, {places}, {items})")
    per = df.where(F.col(key).isNotNull()).groupBy(window).agg(top.alias("top"))
    return per.select(F.col(window), F.explode("top.item").alias(key))


def floods(df: DataFrame, window: str, key: str, share: float) -> DataFrame:
    """window, key, n, share: exactly those keys that hold more than ``share`` of
    the window's rows (rows without a key count in the whole)."""
    named = candidates(df, window, key, share).alias("c")
    met = df.select(window, key).alias("d").join(named, (F.col(f"d.{window}").eqNullSafe(F.col(f"c.{window}"))) & (F.col(f"d.{key}") == F.col(f"c.{key}")), "left_semi")
    counted = met.groupBy(window, key).agg(F.count(F.lit(1)).alias("n"))
    whole = df.groupBy(F.col(window).alias("__w")).agg(F.count(F.lit(1)).alias("__all"))
    out = counted.join(whole, F.col(window).eqNullSafe(F.col("__w")))
    return out.withColumn("share", F.col("n") / F.col("__all")).where(F.col("share") > share).select(window, key, "n", "share")
