import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepool.operators import cdc, oplog
from tidepool.plans.quality import GATE_EXPECTATIONS, VITALS_EXPECTATIONS
from tidepool.sources.events import read_files
from tidepool.streaming import runners as R

T0 = datetime(2026, 9, 21, 8, 0, 0)


def ev(i, t, etype="vitals_reading", enc="enc_1", **kw):
    e = {"event_id": f"ev{i}", "event_type": etype, "event_ts": (T0 + t).isoformat() + "Z", "patient_id": "pt_1", "encounter_id": enc,
         "schema_version": 1}
    e.update(kw)
    return json.dumps(e)


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_vitals_stream_dedups_drops_late_and_implausible(spark, tmp):
    landing = os.path.join(tmp, "landing")
    hr = lambda v: {"vital": {"itemid": "heart_rate", "value": v, "valueuom": "bpm"}}
    land(landing, "a.jsonl", [ev(1, timedelta(minutes=0), **hr(80.0)), ev(2, timedelta(minutes=20), **hr(0.0)), "{not-valid-json:::"])
    stream = R.gated(R.bronze_stream(read_files(spark, landing, max_files_per_trigger=1)), GATE_EXPECTATIONS)
    out, ck = os.path.join(tmp, "out"), os.path.join(tmp, "ck")
    q = R.start_append(R.vitals_stream(stream, VITALS_EXPECTATIONS), out, ck)
    q.awaitTermination()
    # second batch: a replay of ev1 and a reading far behind the watermark
    land(landing, "b.jsonl", [ev(1, timedelta(minutes=0), **hr(80.0)), ev(3, timedelta(minutes=30), **hr(90.0)), ev(4, timedelta(minutes=1), **hr(70.0))])
    with R.LateRows(spark) as late:
        q = R.start_append(R.vitals_stream(stream, VITALS_EXPECTATIONS), out, ck)
        q.awaitTermination()
        dropped = late.total(q)
    rows = [r.event_id for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == ["ev1", "ev3"]  # ev2 implausible, ev4 late, replay of ev1 removed
    assert dropped >= 1


def test_gate_fails_stream_on_unknown_type(spark, tmp):
    landing = os.path.join(tmp, "landing")
    land(landing, "a.jsonl", [ev(1, timedelta(0), etype="merged")])
    stream = R.gated(R.bronze_stream(read_files(spark, landing)), GATE_EXPECTATIONS)
    q = R.start_memory(stream.select("event_id"), "gate_out")
    with pytest.raises(Exception):
        q.awaitTermination()


def test_streaming_scd_equals_batch_for_any_arrival_order(spark, tmp):
    rng = random.Random(1)
    events = []
    for e in range(5):
        enc = f"enc_{e}"
        events.append((enc, 0, "admitted", {"encounter": {"encounter_type": "inpatient", "unit": "ED", "attending_provider_id": "d1", "status": "in-progress"}}))
        for j in range(1, rng.randint(2, 5)):
            events.append((enc, j * 10, "transferred", {"transfer": {"from_unit": None, "to_unit": rng.choice(["ICU", "ED", "Oncology"])}}))
        events.append((enc, 100, "discharged", {}))
    lines = [ev(i, timedelta(minutes=m), etype=t, enc=enc, **kw) for i, (enc, m, t, kw) in enumerate(events)]
    rng.shuffle(lines)
    landing = os.path.join(tmp, "landing")
    for k in range(0, len(lines), 4):
        land(landing, f"part{k:03d}.jsonl", lines[k:k + 4])
    raw = read_files(spark, landing, max_files_per_trigger=1)
    changes = R.encounter_changes(R.gated(R.bronze_stream(raw), GATE_EXPECTATIONS))
    merger = R.ScdMerger(os.path.join(tmp, "scd"))
    merger.start(changes, os.path.join(tmp, "ck")).awaitTermination()
    batch_raw = read_files(spark, landing, stream=False)
    bchanges = R.encounter_changes(R.gated(R.bronze_stream(batch_raw), GATE_EXPECTATIONS))
    want = cdc.scd2_history(bchanges, ["encounter_id"], "event_ts", ["unit", "status"], "event_id", "valid_from", "valid_to")
    got = spark.read.parquet(merger.scd2)
    key = lambda df: sorted(tuple(r) for r in df.select("encounter_id", "unit", "status", "valid_from", "valid_to").collect())
    assert key(got) == key(want)
    assert spark.read.parquet(merger.scd1).count() == 5


def test_cooldown_stream_equals_batch(spark, tmp):
    hours = [0, 1, 23, 24, 30, 47.9, 48, 100]
    rows = [("f", T0 + timedelta(hours=h)) for h in hours] + [("g", T0 + timedelta(hours=h)) for h in hours[:3]]
    src = os.path.join(tmp, "alerts")
    rows.sort(key=lambda r: r[1])
    for chunk in (rows[:6], rows[6:]):  # files land in event-time order
        spark.createDataFrame(chunk, "fingerprint string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("fingerprint string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = R.start_memory(R.alert_cooldown_stream(stream), "cool", checkpoint=os.path.join(tmp, "ck"))
    q.awaitTermination()
    batch = spark.createDataFrame(rows, "fingerprint string, ts timestamp_ntz")
    want = {(r.fingerprint, r.ts, r.sent) for r in oplog.alert_cooldown(batch).collect()}
    got = {(r.fingerprint, r.ts, r.sent) for r in spark.sql("SELECT * FROM cool").collect()}
    assert got == want


def test_cooldown_sink_equals_batch_for_a_hot_fingerprint(spark, tmp):
    rng = random.Random(6)
    rows = [("hot", T0 + timedelta(minutes=17 * i)) for i in range(400)] + [("hot", T0 + timedelta(minutes=17 * 5))]
    rows += [(f"f{rng.randrange(4)}", T0 + timedelta(minutes=rng.randrange(7000))) for _ in range(60)]
    rows.sort(key=lambda r: r[1])
    src = os.path.join(tmp, "alerts")
    for k in range(0, len(rows), 160):  # files land in event-time order
        spark.createDataFrame(rows[k : k + 160], "fingerprint string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    sink = R.CooldownMerger(os.path.join(tmp, "cool"))
    stream = spark.readStream.schema("fingerprint string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    sink.start(stream, os.path.join(tmp, "ck")).awaitTermination()
    batch = spark.createDataFrame(rows, "fingerprint string, ts timestamp")
    want = sorted((r.fingerprint, r.ts, r.sent) for r in oplog.alert_cooldown(batch).collect())
    read = lambda: sorted((r.fingerprint, r.ts, r.sent) for r in spark.read.parquet(sink.out).collect())
    assert read() == want and len(want) == len(rows)
    # A batch that is replayed changes nothing; a late alert is not sent, and expired state is gone.
    last = len(range(0, len(rows), 160)) - 1
    sink(spark.createDataFrame(rows[160 * last :], "fingerprint string, ts timestamp"), last)
    assert read() == want
    sink(spark.createDataFrame([("hot", T0), ("new", T0 + timedelta(days=40))], "fingerprint string, ts timestamp"), last + 1)
    assert sorted(set(read()) - set(want)) == [("hot", T0, False), ("new", T0 + timedelta(days=40), True)]
    state = spark.read.parquet(sink.state).filter(F.col("batch_id") == last + 1).collect()
    assert [r.fingerprint for r in state] == ["new"]


def test_live_rollup_stream_shows_filling_window_and_equals_batch(spark, tmp):
    rows = [(T0 + timedelta(minutes=m), u, v) for m, u, v in
            [(0, "ICU", 80.0), (5, "ICU", 150.0), (14, "ED", 60.0), (16, "ICU", 90.0), (31, "ED", 50.0)]]
    src = os.path.join(tmp, "vitals")
    spark.createDataFrame(rows, "event_ts timestamp, unit string, value double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("event_ts timestamp, unit string, value double").parquet(src)
    q = R.start_memory(R.live_rollup_stream(stream), "live_c", mode="complete")
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("SELECT window_start, unit, reading_count, out_of_range_count FROM live_c").collect())
    batch = R.live_rollup_stream(spark.createDataFrame(rows, "event_ts timestamp, unit string, value double"))
    want = sorted(tuple(r) for r in batch.select("window_start", "unit", "reading_count", "out_of_range_count").collect())
    assert got == want and len(got) == 4  # the newest (30-45 min) window is visible while filling
