import itertools
import random
from datetime import datetime

from pyspark.sql import functions as F

from tidepool.operators import cdc
from tidepool.operators.joins import asof_interval_join
from tidepool.operators.sequence import carry_forward

SCHEMA = "encounter_id string, event_id string, event_ts timestamp_ntz, unit string, status string"
D = "2026-09-21 "


def ts(s):
    return datetime.fromisoformat(D + s)


# the five source events behind the reference's seeded history
EVENTS = [
    ("enc_10001", "e1", ts("08:00:00"), "ED", "in-progress"),
    ("enc_10001", "e2", ts("10:30:00"), "ICU", None),
    ("enc_10002", "e3", ts("09:00:00"), "Cardiology", "in-progress"),
    ("enc_10003", "e4", ts("06:00:00"), "ED", "in-progress"),
    ("enc_10003", "e5", ts("12:00:00"), None, "discharged"),
]


def history(spark, rows, segment="day"):
    df = spark.createDataFrame(rows, SCHEMA)
    h = cdc.scd2_history(df, ["encounter_id"], "event_ts", ["unit", "status"], "event_id", "valid_from", "valid_to", segment=segment)
    return sorted(tuple(r) for r in h.select("encounter_id", "unit", "status", "valid_from", "valid_to").collect())


def test_scd2_matches_seed_in_any_order(spark):
    expected = [
        ("enc_10001", "ED", "in-progress", ts("08:00:00"), ts("10:30:00")),
        ("enc_10001", "ICU", "in-progress", ts("10:30:00"), None),
        ("enc_10002", "Cardiology", "in-progress", ts("09:00:00"), None),
        ("enc_10003", "ED", "in-progress", ts("06:00:00"), ts("12:00:00")),
        ("enc_10003", "ED", "discharged", ts("12:00:00"), None),
    ]
    expected = sorted(expected)
    for perm in list(itertools.permutations(EVENTS))[::17]:
        assert history(spark, list(perm)) == expected
        assert history(spark, list(perm), segment=None) == expected


def test_as_of_is_half_open(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    h = cdc.scd2_history(df, ["encounter_id"], "event_ts", ["unit", "status"], "event_id", "valid_from", "valid_to")
    at = {r.encounter_id: r.unit for r in cdc.as_of(h, D + "10:30:00").collect()}
    assert at["enc_10001"] == "ICU"
    readings = spark.createDataFrame(
        [("enc_10001", ts("07:59:00")), ("enc_10001", ts("10:29:59")), ("enc_10003", ts("13:00:00"))],
        "encounter_id string, reading_ts timestamp_ntz",
    )
    j = asof_interval_join(readings, h, "encounter_id", "reading_ts", "encounter_id", "valid_from", "valid_to", ["unit", "status"])
    got = {(r.encounter_id, r.reading_ts): (r.unit, r.status) for r in j.collect()}
    assert got[("enc_10001", ts("07:59:00"))] == (None, None)
    assert got[("enc_10001", ts("10:29:59"))] == ("ED", "in-progress")
    assert got[("enc_10003", ts("13:00:00"))] == ("ED", "discharged")


def test_scd1_partial_ignores_null_updates(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    cur = {r.encounter_id: r for r in cdc.scd1_partial(df, ["encounter_id"], "event_ts", ["unit", "status"], "event_id").collect()}
    assert cur["enc_10003"].unit == "ED" and cur["enc_10003"].status == "discharged"
    assert cur["enc_10001"].unit == "ICU" and cur["enc_10001"].status == "in-progress"
    latest = {r.encounter_id: r for r in cdc.scd1_latest(df, ["encounter_id"], "event_ts", ["unit", "status"], "event_id").collect()}
    assert latest["enc_10003"].unit is None  # whole-row: NULL overwrites


def test_asof_join_equals_residual_join_on_random_histories(spark):
    rng = random.Random(7)
    hist, reads = [], []
    for k in range(20):
        t = 0
        for v in range(rng.randint(1, 6)):
            t += rng.choice([0, 1, 5, 30, 600, 4000])
            hist.append((f"k{k}", f"v{v}", t))
        for r in range(rng.randint(0, 8)):
            reads.append((f"k{k}", r, rng.randint(-100, t + 5000)))
    h = spark.createDataFrame(hist, "k string, val string, t long")
    h = h.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    h = cdc.scd2_history(h.withColumn("tie", F.col("val")), ["k"], "ts", ["val"], "tie", "f", "to", segment="hour")
    r = spark.createDataFrame(reads, "k string, rid int, t long").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    a = asof_interval_join(r, h, "k", "ts", "k", "f", "to", ["val"], segment="hour")
    b = r.alias("r").join(
        h.alias("h"),
        (F.col("r.k") == F.col("h.k")) & (F.col("r.ts") >= F.col("h.f")) & (F.col("h.to").isNull() | (F.col("r.ts") < F.col("h.to"))),
        "left",
    )
    sa = sorted((x.k, x.rid, x.val) for x in a.collect())
    sb = sorted((x[0], x[1], x["val"]) for x in b.select("r.k", "r.rid", "h.val").collect())
    assert sa == sb


def test_segmented_carry_forward_equals_plain(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 3)}", i, rng.choice([None, "a", "b", None]), i // 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v string, seg int")
    a = carry_forward(df, ["k"], ["o"], ["v"], segment="seg")
    b = carry_forward(df, ["k"], ["o"], ["v"])
    assert sorted(map(tuple, a.select("k", "o", "v").collect())) == sorted(map(tuple, b.select("k", "o", "v").collect()))
