"""Late corrections: one logical reading, several values, the newest counts.

A logical reading is named by its keys (which hold the day it belongs to);
versions of it are ordered. ``latest_readings`` keeps the newest version,
``correction_log`` reports what was replaced. ``CorrectedRollup`` maintains a
rollup of the newest values while batches come in: a batch reads and rewrites
the partitions of its own days alone, and of their cells only those whose
readings changed, so its cost does not grow with the history kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidepool.session import cut_lineage


def latest_readings(readings: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest version of each logical reading, by partial aggregation (equal
    versions: the largest of the other columns)."""
    rest = [c for c in readings.columns if c not in keys and c not in version]
    newest = F.max(F.struct(*version, *rest)).alias("__newest")
    return readings.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__newest.{c}").alias(c) for c in [*version, *rest]])


def correction_log(readings: DataFrame, keys: Sequence[str], version: Sequence[str], value: str) -> DataFrame:
    """Logical readings that were corrected: versions, first and newest value,
    and when the newest came (its first version column). A version that repeats
    the value before it is a version, but only different values are corrections."""
    order = F.struct(*version)
    per = readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("versions"),
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("newest_value"),
        F.max(version[0]).alias("corrected_at"),
        (F.min(value) != F.max(value)).alias("__differs"),
    )
    return per.where("versions > 1 AND __differs").drop("__differs")


def rollup_cells(readings: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """Readings, mean, lowest and highest newest value of each cell."""
    return readings.groupBy(*cell).agg(
        F.count(value).alias("readings"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest")
    )


class CorrectedRollup:
    """Latest readings and their rollup as tables partitioned by day, kept up to
    date batch by batch (also as a ``foreachBatch`` sink).

    ``keys`` name a reading and hold ``day``; ``cell`` holds ``day`` too. A batch
    may hold any mix of new readings and corrections, repeat earlier rows or be
    replayed: the newest version wins, so applying it again changes nothing.
    """

    def __init__(self, root: str, keys: Sequence[str], version: Sequence[str], cell: Sequence[str], value: str, day: str = "day"):
        if day not in keys or day not in cell:
            raise ValueError("the day must be part of the reading's keys and of the cell")
        self.keys, self.version, self.cell, self.value, self.day = list(keys), list(version), list(cell), value, day
        self.latest_path, self.rollup_path = f"{root.rstrip('/')}/latest", f"{root.rstrip('/')}/rollup"

    def stored(self, spark: SparkSession, path: str, days: Sequence, like: DataFrame) -> DataFrame:
        """The table's partitions of the days (none yet: no rows); no other is read."""
        try:
            table = spark.read.schema(like.schema).parquet(path)
        except AnalysisException:  # not written yet
            return like.limit(0)
        return table.where(F.col(self.day).isin(*days)).select(*like.columns)

    def _replace(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day).parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int = 0) -> None:
        spark, day = batch.sparkSession, self.day
        used = [*self.keys, *self.version, *[c for c in self.cell if c not in self.keys], self.value]
        new = latest_readings(batch.select(*dict.fromkeys(used)), self.keys, self.version).persist()
        try:
            days = [r[0] for r in new.select(day).distinct().collect()]  # of one batch
            if not days:
                return
            old = self.stored(spark, self.latest_path, days, new)
            both = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
            # Both results are written aside before either table is replaced, as they read what they replace.
            newest = cut_lineage(latest_readings(both, self.keys, self.version))
            # Cells of readings that are new or corrected, before and after.
            same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.keys]
            came = newest.where("__new").alias("n")
            touched = came.select(*[F.col(f"n.{c}") for c in self.cell]).unionByName(
                old.alias("o").join(came, same, "left_semi").select(*self.cell)
            ).distinct()
            on = [F.col(f"x.{c}").eqNullSafe(F.col(f"t.{c}")) for c in self.cell]
            again = rollup_cells(newest.alias("x").join(touched.alias("t"), on, "left_semi"), self.cell, self.value)
            kept = self.stored(spark, self.rollup_path, days, again).alias("x").join(touched.alias("t"), on, "left_anti")
            rollup = cut_lineage(again.unionByName(kept))
            self._replace(newest.drop("__new"), self.latest_path)
            self._replace(rollup, self.rollup_path)
        finally:
            new.unpersist()

    def rollup(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.rollup_path)
