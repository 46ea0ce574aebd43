"""Watch operators against plain Python on small tables with a hot key."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepool.operators import automaton as A
from tidepool.operators import clocks, corrections, drift, flood, grain, ledger, runs, sensitive

T0 = dt.datetime(2026, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# -- late corrections ---------------------------------------------------------
READING = "day date, sensor string, event_id long, ts timestamp, unit string, value double"


def readings(rng, days, n, first_id=0):
    rows = []
    for i in range(n):
        d = rng.choice(days)
        rows.append((T0.date() + dt.timedelta(days=d), rng.choice(["hot", "hot", "a", "b", None]), first_id + i, at(d * 86400 + rng.randrange(86400)), rng.choice("xy"), rng.choice([1.0, 2.5, None])))
    return rows


def full(rows):
    newest = {}
    for day, sensor, i, ts, unit, value in rows:
        if (day, sensor) not in newest or (ts, i) > newest[day, sensor][:2]:
            newest[day, sensor] = (ts, i, unit, value)
    cells = {}
    for (day, _), (_, _, unit, value) in newest.items():
        cells.setdefault((day, unit), []).append(value)
    known = {k: [v for v in vs if v is not None] for k, vs in cells.items()}
    return {(d, u, len(v), sum(v) if v else None, min(v, default=None), max(v, default=None)) for (d, u), v in known.items()}


def test_incremental_rollup_equals_a_full_recompute_and_reads_its_own_days(spark, tmp):
    rng = random.Random(1)
    keeper = corrections.CorrectedRollup(tmp, ["day", "sensor"], ["ts", "event_id"], ["day", "unit"], "value")
    all_rows, read = [], {}
    batches = [range(2), range(2, 5), range(5, 9), [1], [6, 7], [1]]
    for k, days in enumerate(batches):
        rows = readings(rng, list(days), 12, 100 * k)
        all_rows += rows
        for _ in range(1 + (k == 3)):  # one batch is replayed
            keeper(spark.createDataFrame(rows, READING), k)
        got = {tuple(r[c] for c in ("day", "unit", "readings", "total", "lowest", "highest")) for r in keeper.rollup(spark).collect()}
        assert got == full(all_rows)
        touched = {r[0] for r in rows}
        for path, like in ((keeper.latest_path, spark.read.parquet(keeper.latest_path)), (keeper.rollup_path, keeper.rollup(spark))):
            part = keeper.stored(spark, path, sorted(touched), like)
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
            files = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
            assert files and {f.split("day=")[1].split("/")[0] for f in files} <= {str(d) for d in touched}
            read[k, path] = len(files)
    for path in (keeper.latest_path, keeper.rollup_path):
        assert read[5, path] <= read[3, path]  # the same day costs the same after more history
    keeper(spark.createDataFrame([], READING))


def test_only_changed_values_are_corrections(spark):
    rows = [(T0.date(), "a", i, at(i), "x", v) for i, v in enumerate([1.0, 1.0, 4.0])] + [(T0.date(), "b", i, at(i), "x", 1.0) for i in range(2)]
    log = corrections.correction_log(spark.createDataFrame(rows, READING), ["day", "sensor"], ["ts", "event_id"], "value").collect()
    assert [(r.sensor, r.versions, r.first_value, r.newest_value, r.corrected_at) for r in log] == [("a", 3, 1.0, 4.0, at(2))]


# -- balance ------------------------------------------------------------------
def test_every_planted_fault_closes_the_balance(spark):
    rng = random.Random(2)
    rows = [(i, at(60 * i + rng.randrange(50)), at(60 * i + 55), "ok") for i in range(200)]
    rows += [(7, at(60 * k + 1), at(60 * k + 56), "ok") for k in range(7, 150, 3)]  # one id with very many copies
    rows += [(None, at(60 * k), at(60 * k + 57), "corrupt") for k in (3, 90)]
    rows += [(1000 + k, at(60 * k - 4000), at(60 * k + 58), "ok") for k in (100, 150)]  # far behind
    rows += [(2000, at(60 * 20 + 2), at(60 * 20 + 59), "bad value")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, arrived timestamp, kind string")
    marked = ledger.mark_late(ledger.mark_duplicates(df, "id", ["arrived", "ts"]), "ts", "arrived", "10 minutes", 300)
    reasons = {"corrupt": F.col("kind") == "corrupt", "late": F.col("late"), "duplicate": F.col("duplicate"), "implausible": F.col("kind") == "bad value"}
    book = ledger.ledger("silver", marked, F.col("arrived"), "1 hour", reasons)
    # What arrived in which window, told in plain Python with the watermark between batches.
    seen, marks, want, kept = set(), {}, {}, Counter()
    for i, ts, arrived, kind in rows:
        marks.setdefault((arrived - T0) // dt.timedelta(minutes=10), []).append(ts)
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    firsts = {}
    for i, ts, arrived, kind in order:
        if i is not None:
            firsts.setdefault(i, (arrived, ts))
    for i, ts, arrived, kind in order:
        batch = (arrived - T0) // dt.timedelta(minutes=10)
        top = max((t for b, own in marks.items() if b < batch for t in own), default=None)
        why = "kept"
        if kind == "bad value":
            why = "implausible"
        if i is not None and firsts[i] != (arrived, ts):
            why = "duplicate"
        if top is not None and ts < top - dt.timedelta(seconds=300):
            why = "late"
        if kind == "corrupt":
            why = "corrupt"
        window = T0 + (arrived - T0) // dt.timedelta(hours=1) * dt.timedelta(hours=1)
        want.setdefault(window, Counter())[why] += 1
        kept[window] += why == "kept"
    found = spark.createDataFrame([(w, n) for w, n in kept.items()] + [(at(-7200), 5)], "window_start timestamp, rows_found long")
    got = {r.window_start: r for r in ledger.balance(book, found, list(reasons)).collect()}
    assert sum(c[k] for c in want.values() for k in reasons) > 40 and all(sum(c[k] for c in want.values()) for k in reasons)
    for w, c in want.items():
        assert {k: got[w][k] for k in reasons} == {k: c[k] for k in reasons}
        assert got[w].rows_in == sum(c.values()) and got[w].unexplained == 0
    assert got[at(-7200)].unexplained == -5  # rows from nowhere


# -- life cycle ---------------------------------------------------------------
MACHINE = A.Automaton(
    ["new", "in", "out"],
    ["admitted", "transferred", "discharged"],
    {
        ("new", "admitted"): ("in", None), ("new", "transferred"): ("new", "too early"), ("new", "discharged"): ("new", "too early"),
        ("in", "admitted"): ("in", "twice"), ("in", "transferred"): ("in", None), ("in", "discharged"): ("out", None),
        ("out", "admitted"): ("in", None), ("out", "transferred"): ("out", "after the end"), ("out", "discharged"): ("out", "after the end"),
    },
)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_composed_maps_equal_a_plain_fold(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(300), i, rng.choice([*MACHINE.events, "unknown"])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, id long, what string").withColumn("seg", F.floor(F.col("t") / width))
    want, last = [], {}
    for k in {r[0] for r in rows}:
        state, since = "new", None
        for _, t, i, what in sorted((r for r in rows if r[0] == k and r[3] in MACHINE.events), key=lambda r: r[1:3]):
            to, problem = MACHINE.moves[state, what]
            if problem:
                want.append((k, t, i, state, problem))
            since = t if to == "in" and state != "in" else since
            state = to
        if state == "in":
            last[k] = since
    got = A.illegal_moves(df, ["k"], "seg", ["t", "id"], "what", MACHINE)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 50
    stuck = A.open_since(df, ["k"], "seg", ["t", "id"], "what", MACHINE, "in").collect()
    assert {r.k: r.since for r in stuck} == last
    assert A.illegal_moves(df.limit(0), ["k"], "seg", ["t", "id"], "what", MACHINE).collect() == []


# -- flatlines ----------------------------------------------------------------
@pytest.mark.parametrize("width", [1, 5, 60, 10_000])
def test_runs_are_whole_across_segments(spark, width):
    rng = random.Random(width)
    rows = []
    for k, n in (("hot", 400), ("a", 40), (None, 30), ("one", 1)):
        v = 1.0
        for t in range(n):
            v = v if rng.random() < 0.8 else rng.choice([1.0, 2.0, None])
            rows.append((k, at(t), t, v))
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long, v double").withColumn("seg", F.floor(F.col("id") / width))
    want = []
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        start = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][3] != own[start][3]:
                want.append((k, own[start][3], i - start, own[start][1], own[i - 1][1]))
                start = i
    got = runs.runs(df, ["k"], ["ts", "id"], "v", "seg")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    flat = runs.flatlines(df, ["k"], ["ts", "id"], "v", "seg", 6, 5)
    assert sorted(map(tuple, flat.collect()), key=str) == sorted((w for w in want if w[2] >= 6 and w[1] is not None), key=str)


# -- floods -------------------------------------------------------------------
@pytest.mark.parametrize("share", [0.2, 0.02])
def test_every_key_above_the_share_with_its_exact_count(spark, share):
    rng = random.Random(3)
    rows = [(w, rng.choice([None, "hot", "warm", *(f"k{rng.randrange(3000)}" for _ in range(3)), "mild" if rng.random() < 0.2 else "hot"])) for w in (0, 1, None) for _ in range(4000)]
    df = spark.createDataFrame(rows, "w int, k string")
    size, count = Counter(w for w, _ in rows), Counter(r for r in rows if r[1] is not None)
    want = {(w, k): n for (w, k), n in count.items() if n > share * size[w]}
    got = flood.floods(df, "w", "k", share).collect()
    assert {(r.w, r.k): r.n for r in got} == want and len(got) == len(want) > 0
    assert all(r.share == pytest.approx(r.n / size[r.w]) for r in got)


# -- drift --------------------------------------------------------------------
def test_psi_against_stored_bins(spark, tmp):
    rng = random.Random(4)
    base = [("x", rng.gauss(0, 1)) for _ in range(1000)] + [("y", 5.0)] * 50 + [("x", None)]
    drift.store_bins(drift.reference_bins(spark.createDataFrame(base, "item string, v double"), "item", "v"), tmp + "/bins")
    bins = drift.read_bins(spark, tmp + "/bins")
    now = [("x", "same", rng.gauss(0, 1)) for _ in range(1000)] + [("x", "moved", rng.gauss(3, 1)) for _ in range(500)] + [("y", "same", 5.0), ("z", "same", 1.0), ("x", "same", None)]
    got = {(r.item, r.week): r for r in drift.psi(spark.createDataFrame(now, "item string, week string, v double"), bins, "item", "v", ["week"]).collect()}
    stored = {r.item: r for r in bins.collect()}
    assert sum(stored["x"].counts) == 1000 and len(stored["x"].edges) == 9
    for (item, week), r in got.items():
        edges, counts = stored[item].edges, stored[item].counts
        own = Counter(sum(e < v for e in edges) for i, w, v in now if i == item and w == week and v is not None)
        total = sum(own.values())
        want = sum((s - e) * math.log(s / e) for b in range(10) for s, e in [((own[b] + 0.5) / (total + 5), (counts[b] + 0.5) / (sum(counts) + 5))])
        assert r.psi == pytest.approx(want, abs=1e-6) and r.n == total
    assert set(got) == {("x", "same"), ("x", "moved"), ("y", "same")} and got["x", "same"].psi < 0.1 < 1 < got["x", "moved"].psi


# -- clocks -------------------------------------------------------------------
def test_planted_clock_faults_are_recovered(spark):
    rng = random.Random(5)
    planted = {"fine": 0, "also": 0, "third": 0, "zone": 3 * 3600, "west": -5 * 3600, "late clock": 1234, "ahead": -5000}
    rows = []
    for s, off in planted.items():
        for i in range(300):
            true = T0 + dt.timedelta(seconds=60 * i)
            arrived = true + dt.timedelta(seconds=30 + rng.random() * 5 + (rng.random() * 20_000 if rng.random() < 0.2 else 0))
            rows.append((s, true - dt.timedelta(seconds=off), arrived, true))
    epoch = dt.datetime(1970, 1, 1)
    for i in range(50):
        true = T0 + dt.timedelta(seconds=60 * i)
        rows.append(("as millis", epoch + (true - epoch) / 1000, true + dt.timedelta(seconds=31), true))
    rows += [(None, T0, at(30), T0), ("fine", None, T0, T0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, arrived timestamp, true timestamp")
    offsets = clocks.clock_offsets(df, "s", "ts", "arrived")
    got = {r.source: r for r in offsets.collect()}
    assert {s: got[s].clock for s in planted} == {"fine": "ok", "also": "ok", "third": "ok", "zone": "time_zone", "west": "time_zone", "late clock": "skew", "ahead": "skew"}
    assert got["as millis"].clock == "seconds_as_millis" and got[None].rows == 1
    assert all(abs(got[s].offset_s - off) < 6 for s, off in planted.items())
    fixed = clocks.corrected_time(df, offsets, "s", "ts").where("ts is not null").collect()
    assert len(fixed) == len(rows) - 1
    for r in fixed:
        slack = 6 if r.s in ("late clock", "ahead") else 0.001
        assert abs((r.corrected_ts - r.true).total_seconds()) <= slack, r


# -- grain --------------------------------------------------------------------
def test_a_planted_duplicate_is_named_with_its_factor(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, v long")
    dim = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("hot", "x"), ("a", "x"), ("b", "x"), ("unused", "x"), ("unused", "y")], "k string, name string")
    assert [tuple(r) for r in grain.fan_out(facts, "k", dim, "k").collect()] == [("hot", 50, 150, 3)]
    lost = {r.key: tuple(r)[1:] for r in grain.fan_out(facts, "k", dim, "k", "inner").collect()}
    assert lost == {"hot": (50, 150, 3), "c": (1, 0, 0), None: (1, 0, 0)}
    out, seen = grain.checked_join(facts, dim, "k")
    assert out.count() == 154 and "__copy" not in out.columns
    assert seen.rows() == {"rows_before": 54, "rows_after": 154, "unmatched": 2, "most_copies": 3} and not seen.kept()
    out, seen = grain.checked_join(facts, dim.dropDuplicates(["k"]), "k")
    assert out.count() == 54 and seen.kept()
    assert {(r.multiplicity, r["keys"]) for r in grain.multiplicities(dim, "k").collect()} == {(1, 2), (2, 1), (3, 1)}


# -- sensitive values ---------------------------------------------------------
def test_nested_and_renamed_fields_are_found(spark):
    schema = "id long, c7 string, who struct<label:string,tags:array<string>>, items array<struct<note:string,deep:array<struct<z:string>>>>, m map<string,string>, aa array<array<string>>"
    rows = [
        (1, "call 555-123-4567 now", ("Ann", ["x", "ann@example.org"]), [("fine", [("MRN-000123",), (None,)]), ("10.0.0.1", None)], {"k": "078-05-1120"}, [["a"], None, ["b@c.de"]]),
        (2, None, None, None, None, None),
        (3, "nothing", ("a@b", None), [], {"x@y.org": "1"}, []),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.path, r.pattern): (r.rows, r.hits) for r in sensitive.sensitive_profile(df).collect()}
    assert got == {
        ("c7", "phone"): (3, 1), ("who.tags[]", "email"): (3, 1), ("items[].deep[].z", "record_number"): (3, 1),
        ("items[].note", "ip_address"): (3, 1), ("m.values", "ssn"): (3, 1), ("m.keys", "email"): (3, 1), ("aa[][]", "email"): (3, 1),
    }
    flags = {(r.path, r.pattern): r.declared for r in sensitive.undeclared(df, "t", {"t.c7": ["phone"], "t.m.values": ["email"]}).collect()}
    assert flags["c7", "phone"] and not flags["m.values", "ssn"] and not flags["who.tags[]", "email"]
    assert sensitive.sensitive_profile(spark.range(3)).collect() == []


def test_a_hot_key_is_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(grain, "PIECE_ROWS", 100)
    facts = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), ("cold", 1), (None, 2), ("lost", 3)], "k string, v int")
    dim = spark.createDataFrame([("hot", f"d{i}") for i in range(10)] + [("cold", "x"), (None, "n")], "k string, w string")
    for how in ("left", "inner"):
        out, seen = grain.checked_join(facts, dim, "k", how)
        rows = out.withColumn("task", F.spark_partition_id()).collect()
        assert out.columns == ["k", "v", "w"]
        assert sorted((tuple(r)[:3] for r in rows), key=str) == sorted((tuple(r) for r in facts.join(dim, "k", how).collect()), key=str)
        assert len({r.task for r in rows if r.k == "hot"}) > 4
        if how == "left":
            assert seen.rows() == {"rows_before": 204, "rows_after": 2004, "unmatched": 2, "most_copies": 10}


def test_joined_rows_take_little_disk(spark, tmp):
    import os

    facts = spark.range(2_000).selectExpr("id AS v", "id % 2 AS k")
    dim = spark.range(1_200).selectExpr("hash(id) AS w", "id % 2 AS k")
    out, seen = grain.checked_join(facts, dim, "k")
    grain.write_joined(out.coalesce(1), f"{tmp}/joined")
    size = sum(os.path.getsize(f"{tmp}/joined/{f}") for f in os.listdir(f"{tmp}/joined") if f.endswith(".parquet"))
    assert spark.read.parquet(f"{tmp}/joined").count() == seen.rows()["rows_after"] == 1_200_000
    assert size < 150_000  # 1.2 MB of codes of ten bits in pages of 20,000 rows
