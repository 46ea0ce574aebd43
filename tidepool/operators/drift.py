"""Feature drift: the population stability index against stored bins.

The bins (edges and shares) come from a reference population once and are kept
as a small table; other populations are counted into them. Empty bins are
smoothed by half a row, on both sides, so the index is always finite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.quantiles import quantiles


def _bin(value: Column, edges: Column) -> Column:
    """How many edges lie below the value."""
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(e < value, 1).otherwise(0))


def reference_bins(reference: DataFrame, item: str, value: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """One row for each item: its inner edges (exact quantiles, rounded) and the
    rows in each bin."""
    at = {f"e{i:03d}": i / bins for i in range(1, bins)}
    found = quantiles(reference, [item], value, at)
    edges = found.select(item, F.array(*[F.round(c, digits) for c in at]).alias("edges"))
    own = reference.where(F.col(value).isNotNull()).join(edges, item)
    counted = own.groupBy(item, _bin(F.col(value), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("__n"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("__n", b), F.lit(0)))
    return edges.join(per, item).select(item, "edges", counts.alias("counts"))


def store_bins(bins: DataFrame, path: str) -> None:
    bins.coalesce(1).write.mode("overwrite").parquet(path)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def psi(current: DataFrame, bins: DataFrame, item: str, value: str, by: Sequence[str]) -> DataFrame:
    """item, ``by``, n and psi of each population: the sum over bins of (share -
    reference share) * ln(share / reference share). Items without bins are left
    out; null values are not counted."""
    met = current.where(F.col(value).isNotNull()).join(bins.select(item, "edges"), item)
    counted = met.groupBy(item, *by, _bin(F.col(value), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy(item, *by).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("seen"))
    per = per.join(bins.select(item, "counts"), item)
    size = F.size("counts")
    reference_total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)

    def term(n: Column, i: Column) -> Column:
        share = (F.coalesce(F.try_element_at("seen", i), F.lit(0)) + 0.5) / (F.col("n") + 0.5 * size)
        expected = (n + 0.5) / (reference_total + 0.5 * size)
        return (share - expected) * F.ln(share / expected)

    index = F.aggregate(F.transform("counts", term), F.lit(0.0), lambda a, x: a + x)
    return per.select(item, *by, "n", F.round(index, 6).alias("psi"))
