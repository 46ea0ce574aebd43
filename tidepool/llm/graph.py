"""Connected components of a link table, kept on the cluster throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v: long): the root
    is the smallest node that can be reached.

    Alternates large-star and small-star steps: each node's neighbours are hung
    on the smallest of them, until nothing changes, so a chain of n links takes
    about log n rounds. Minima are pre-aggregated and the join on a hot node
    can be split, so a star of any size is no single task's work. An empty
    table has no nodes.
    """

    def smallest(pairs: DataFrame, own: bool) -> DataFrame:
        least = pairs.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        return least.select("at", F.least("at", "m").alias("m") if own else F.col("m"))

    edges = cut_lineage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    before = None
    while (now := _signature(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(smallest(both, own=True), F.col("u") == F.col("at")).where("v > u")
        large = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(smallest(large, own=False), F.col("u") == F.col("at"))
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = cut_lineage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
