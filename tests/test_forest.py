from pyspark.sql import functions as F

from tidepool.operators import forest as FO

FEATS = ["heart_rate", "spo2", "resp_rate", "temp_c", "sbp", "dbp"]


def panels(spark):
    rows = [(i, 70.0 + (i * 7) % 20, 95.0 + (i * 3) % 4, 14.0 + (i * 5) % 6, 36.5 + ((i * 11) % 10) / 10, 115.0 + (i * 13) % 20,
             75.0 + (i * 17) % 10) for i in range(600)]
    rows += [(1000, 180.0, 70.0, 40.0, 41.0, 60.0, 30.0), (1001, 30.0, 99.0, 4.0, 33.0, 250.0, 140.0)]
    return spark.createDataFrame(rows, "pid long, " + ", ".join(f"{f} double" for f in FEATS))


def test_planted_outliers_rank_first_and_seed_is_stable(spark):
    p = panels(spark)
    trees = FO.fit(p, FEATS, "pid", n_trees=40, sample_size=128, seed=13)
    again = FO.fit(p, FEATS, "pid", n_trees=40, sample_size=128, seed=13)
    assert sorted(map(tuple, trees.collect())) == sorted(map(tuple, again.collect()))
    scored = p.withColumn("score", FO.score_column(trees, FEATS))
    top = [r.pid for r in scored.orderBy(F.desc("score")).limit(2).collect()]
    assert set(top) == {1000, 1001}
    t = FO.threshold(scored, "score", 0.05)
    flagged = scored.filter(F.col("score") > t).count()
    assert 0 < flagged <= 0.06 * scored.count() + 1
