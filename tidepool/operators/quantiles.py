"""Exact interpolated quantiles without sorting or buffering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.sequence import range_segment, sum_before
from tidepool.session import cut_lineage


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float | Column]) -> DataFrame:
    """Per key (one row over all for no keys) a column for each entry of ``at``:
    the quantile at that fraction, interpolated linearly between the two values
    beside it. Nulls are left out; a group without values has no row.

    Values are counted first (partial combine) and the counts written, so that
    ``df`` is read once; how many are smaller comes from a running sum over value
    segments, so the distinct values of one key are spread over tasks. A fraction
    is a number or a column that is constant per key.
    """
    keys = list(keys)
    fractions = {name: F.lit(f) if isinstance(f, int | float) else f for name, f in at.items()}
    own = df.filter(F.col(value).isNotNull())
    counts = cut_lineage(
        own.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), *(F.first(f).alias(f"__f_{n}") for n, f in fractions.items()))
    )
    ranked = sum_before(range_segment(counts, keys, value), keys, value, "__c", "__below", segment="__segment")
    total = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    met = ranked.join(total, keys) if keys else ranked.withColumn("__n", total.scalar())

    def value_at(place: Column) -> Column:
        here = (F.col("__below") <= place) & (place < F.col("__below") + F.col("__c"))
        return F.max(F.when(here, F.col(value)))

    parts = [(F.count(F.lit(1)) > 0).alias("__any")]
    for name in fractions:
        place = F.col(f"__f_{name}") * (F.col("__n") - 1)
        parts += [
            value_at(F.floor(place)).alias(f"__lo_{name}"),
            value_at(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place - F.floor(place)).alias(f"__part_{name}"),
        ]
    found = met.groupBy(*keys).agg(*parts)
    between = [
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}")).alias(n) for n in fractions
    ]
    return found.where("__any").select(*keys, *between)
