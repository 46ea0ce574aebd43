import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import silence
from tidepool.streaming import silence as stream

T0 = dt.datetime(2026, 3, 1)
SCHEMA = "source string, ts timestamp"


def plain(rows, limit, until):
    out = []
    for source in {s for s, _ in rows}:
        own = sorted({t for s, t in rows if s == source})
        for t in own:
            later = [x for x in own if x > t]
            due = t + dt.timedelta(seconds=limit)
            if due <= until and not (later and later[0] <= due):
                out.append((source, t, due))
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    rows = [("hot", T0 + dt.timedelta(seconds=20 * i + rng.random())) for i in range(n)]  # two thirds of all rows
    for s in "abcd":
        t = T0
        for _ in range(n // 8):
            t += dt.timedelta(seconds=rng.choice([5, 60, 299, 300, 301, 900, 4000]) + rng.choice([0, 0.000001]))
            rows.append((s, t))
    rows += [("stopped", T0 + dt.timedelta(seconds=3)), ("stopped", T0 + dt.timedelta(seconds=3))]
    return rows


def test_batch_equals_comparing_every_event(spark):
    rows = made(400, 1)
    df = spark.createDataFrame([*rows, ("no time", None)], SCHEMA)
    until = max(t for _, t in rows)
    got = sorted((r.source, r.silent_since, r.alert_at) for r in silence.silences(df, "source", "ts", 300).collect())
    assert got == plain(rows, 300, until) and any(s == "stopped" for s, *_ in got)
    early = T0 + dt.timedelta(seconds=1800)
    got = sorted((r.source, r.silent_since, r.alert_at) for r in silence.silences(df, "source", "ts", 300, F.lit(early)).collect())
    assert got == plain(rows, 300, early)
    assert silence.silences(df.limit(0), "source", "ts", 300).collect() == []


def test_a_hot_source_is_reduced_before_it_is_ordered(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("source"), F.timestamp_seconds(F.col("id") % 3000).alias("ts"))
    assert silence.stretches(df, "source", "ts", 300).count() == 10


@pytest.mark.parametrize("seed", [2, 3])
def test_the_stream_alerts_without_input_and_equals_the_batch(spark, tmp, seed):
    """Rows arrive in files of up to ten minutes' disorder; alerts come from timers alone."""
    rng = random.Random(seed)
    rows = made(240, seed)
    arriving = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.random() * 600))
    landing = os.path.join(tmp, "in")
    for i in range(0, len(arriving), 90):
        spark.createDataFrame(arriving[i : i + 90], SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, stream.ROCKS)
    try:
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(landing)
        q = (
            stream.silence_alerts(read, "source", "ts", 300, "20 minutes")
            .writeStream.format("memory").queryName(f"alerts{seed}").outputMode("append")
            .option("checkpointLocation", os.path.join(tmp, "ck")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    got = sorted((r.source, r.silent_since, r.alert_at) for r in spark.table(f"alerts{seed}").collect())
    mark = (max(t for _, t in rows) - dt.timedelta(minutes=20) - T0) // dt.timedelta(seconds=30)
    passed = T0 + mark * dt.timedelta(seconds=30) - dt.timedelta(microseconds=1)  # whole slots of 30 seconds
    assert sorted(set(got) ^ set(plain(rows, 300, passed))) == [], passed
    df = spark.createDataFrame(rows, SCHEMA)
    assert got == sorted((r.source, r.silent_since, r.alert_at) for r in silence.silences(df, "source", "ts", 300, F.lit(passed)).collect())
    assert any(s == "stopped" for s, *_ in got)


def test_first_stale_layer_upstream_is_named(spark):
    at = lambda h: spark.createDataFrame([(T0 + dt.timedelta(hours=h),)], "t timestamp")
    layers = {"bronze": at(9), "silver": at(3), "gold": at(2), "empty": at(0).limit(0)}
    rows = {r.layer: r for r in silence.layer_freshness(layers, F.lit(T0 + dt.timedelta(hours=10)), dict.fromkeys(layers, 4 * 3600)).collect()}
    assert [(rows[x].stale, rows[x].look_at) for x in layers] == [(False, None), (True, "silver"), (True, "silver"), (True, "silver")]
    assert rows["gold"].lag_s == 8 * 3600 and rows["empty"].lag_s is None
