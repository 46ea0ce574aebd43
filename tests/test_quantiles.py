import random
from statistics import quantiles as inclusive

import pytest
from pyspark.sql import functions as F

from tidepool.operators.quantiles import quantiles


def interpolated(values, f):
    v = sorted(values)
    at = f * (len(v) - 1)
    lo = int(at)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)


@pytest.mark.parametrize("skew", [1, 6])
def test_same_as_sorting_however_the_values_lie(spark, skew):
    rng = random.Random(skew)
    rows = [(k, round(rng.random() ** skew * 10, rng.choice([0, 6])) if rng.random() > 0.1 else 1e12) for k in "ab" for _ in range(700)]
    rows += [("c", 3.0), ("d", None), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"p0": 0.0, "p01": 0.01, "mid": 0.5, "p99": 0.99, "p1": 1.0}
    got = {r.k: r for r in quantiles(df, ["k"], "v", at).collect()}
    assert sorted(got) == ["a", "b", "c"]
    for k in got:
        own = [v for kk, v in rows if kk == k and v is not None]
        for name, f in at.items():
            assert got[k][name] == pytest.approx(interpolated(own, f))
    whole = quantiles(df.withColumn("f", F.lit(0.25)), [], "v", {"q": F.col("f")}).first().q
    own = sorted(v for _, v in rows if v is not None)
    assert whole == pytest.approx(inclusive(own, n=4, method="inclusive")[0])
