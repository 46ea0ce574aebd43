import duckdb
import pytest
from pyspark.sql import functions as F

from tidepool.contracts import EVENT_SCHEMA, contract_keys, plausible_value_sql
from tidepool.operators import contract_checks as CC
from tidepool.operators import expectations as X
from tidepool.sources import events as SRC

DROPPED = [("heart_rate", 0.0), ("heart_rate", -1.0), ("heart_rate", 999.0), ("heart_rate", None), ("spo2", 0.0), ("spo2", 106.0), ("temp_c", 98.6)]
KEPT = [("heart_rate", 145.0), ("heart_rate", 40.0), ("spo2", 82.0), ("temp_c", 41.2), ("sbp", 210.0), ("resp_rate", 38.0), ("pain_score", 5.0),
        ("heart_rate", 55.0), ("heart_rate", 140.0), ("spo2", 88.0), ("spo2", 100.0), ("temp_c", 35.5), ("temp_c", 39.5)]


def test_plausible_predicate_same_in_spark_and_duckdb(spark):
    rows = DROPPED + KEPT
    df = spark.createDataFrame(rows, "itemid string, value double")
    got = [r.ok for r in df.select(F.coalesce(F.expr(plausible_value_sql()), F.lit(False)).alias("ok")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, itemid VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    duck = [r[0] for r in con.execute(f"SELECT COALESCE({plausible_value_sql()}, false) FROM t ORDER BY i").fetchall()]
    assert got == duck == [False] * len(DROPPED) + [True] * len(KEPT)


def test_warn_counts_null_as_violation_and_drop_keeps_true_only(spark):
    df = spark.createDataFrame(DROPPED + KEPT, "itemid string, value double")
    exps = [X.Expectation("plausible", plausible_value_sql(), X.DROP), X.Expectation("known", "itemid IN ('heart_rate','spo2','temp_c','sbp','resp_rate','dbp')")]
    m = {r.expectation: (r.passed, r.failed) for r in X.expectation_metrics(df, "v", exps).collect()}
    assert m["plausible"] == (len(KEPT), len(DROPPED))
    assert m["known"] == (len(DROPPED + KEPT) - 1, 1)
    assert X.apply_expectations(df, exps).count() == len(KEPT)
    observed, obs = X.observe(df, "o", exps)
    observed.count()
    assert obs.get["plausible.failed"] == len(DROPPED)


def test_fail_expectation_fails_the_query(spark):
    df = spark.createDataFrame([("admitted",), ("merged",)], "event_type string")
    gate = [X.Expectation("known_event_type", "event_type IS NULL OR event_type IN ('admitted')", X.FAIL)]
    with pytest.raises(Exception, match="known_event_type"):
        X.apply_expectations(df, gate).collect()


def test_permissive_parse_and_rescue(spark):
    lines = [
        '{"event_id": "a1", "event_type": "vitals_reading", "event_ts": "2026-09-21T08:00:00Z", "vital": {"itemid": "heart_rate", "val": 88.0, "valueuom": "bpm"}}',
        '{not-valid-json::: ',
        None,
        '{"event_id": "a2", "event_type": "admitted", "event_ts": "2026-09-21T08:00:00Z", "patient": {"patient_id": "p", "mrn": "MRN-000001"}, "extra": 1}',
    ]
    raw = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, _raw string")
    p = SRC.rescue_unknown_fields(SRC.parse_permissive(raw, keep_raw=True), contract_keys(EVENT_SCHEMA))
    rows = {r.i: r for r in p.select("i", "_corrupt_record", "payload.vital.value", SRC.rescued_keys().alias("rk")).collect()}
    assert rows[0]._corrupt_record is None and rows[0].value is None and rows[0].rk == "vital.val"
    assert rows[1]._corrupt_record == lines[1]
    assert rows[3].rk == "extra,patient.patient_id"
    flat = p.select("_raw", "_corrupt_record", "_rescued_data", "payload.*")
    v = {r.event_id: r for r in CC.validate_contract(flat).collect() if r.event_id}
    assert "unknown_field" in v["a1"].violations and not v["a1"].is_valid
    drift = {(r.kind, r.field) for r in CC.schema_drift(raw.filter("_raw IS NOT NULL"), [f.name for f in EVENT_SCHEMA.fields]).collect()}
    assert ("unexpected", "extra") in drift and ("missing", "notes") in drift


def test_source_switch_rejects_unknown(spark):
    with pytest.raises(ValueError):
        SRC.read_events(spark, "ftp")


GATE = [
    X.Expectation("has_value", "v IS NOT NULL", X.DROP),
    X.Expectation("known_event_type", "event_type IS NULL OR event_type IN ('admitted')", X.FAIL),
]


@pytest.mark.parametrize("narrow", [lambda d: d, lambda d: d.filter("event_type = 'admitted'"), lambda d: d.limit(1), lambda d: d.select("v").filter("v > 5")])
def test_hard_stop_sees_rows_that_later_filters_would_skip(spark, tmp, narrow):
    schema = "event_type string, v double"
    spark.createDataFrame([("admitted", 9.0)] * 3, schema).coalesce(1).write.parquet(f"{tmp}/b")
    spark.createDataFrame([("merged", None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp}/b")
    bronze = spark.read.parquet(f"{tmp}/b")
    with pytest.raises(Exception, match="known_event_type"):
        narrow(X.apply_expectations(bronze, GATE)).collect()
    assert narrow(X.apply_expectations(bronze.filter("event_type = 'admitted'"), GATE)).count() >= 1


def test_hard_stop_on_a_stream_sees_rows_that_later_filters_would_skip(spark, tmp):
    schema = "event_type string, v double"
    spark.createDataFrame([("admitted", 9.0), ("merged", None)], schema).write.parquet(f"{tmp}/s")
    stream = X.apply_expectations(spark.readStream.schema(schema).parquet(f"{tmp}/s"), GATE).filter("event_type = 'admitted'")
    q = stream.writeStream.format("memory").queryName("hard_stop").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="known_event_type"):
        q.awaitTermination()


FULL = {
    "event_id": "a", "event_type": "vitals_reading", "event_ts": "2026-09-21T08:00:00Z", "patient_id": "p", "encounter_id": "e",
    "schema_version": 1, "notes": "n",
    "patient": {"mrn": "m", "full_name": "f", "birth_date": "b", "gender": "g", "region": "r"},
    "encounter": {"encounter_type": "t", "unit": "u", "attending_provider_id": "a", "status": "s"},
    "transfer": {"from_unit": "u", "to_unit": "v"},
    "vital": {"itemid": "heart_rate", "value": 80.0, "valueuom": "bpm"},
}


def test_contract_of_each_field(spark):
    import copy
    import json

    cases = [("whole", FULL, [])]
    optional = {"schema_version", "notes", "patient", "encounter", "transfer", "vital"}
    for name in FULL:
        r = copy.deepcopy(FULL)
        del r[name]
        cases.append((f"no {name}", r, [] if name in optional else ["missing_event_type" if name == "event_type" else f"missing:{name}"]))
        if isinstance(FULL[name], dict):
            for child in FULL[name]:
                r = copy.deepcopy(FULL)
                del r[name][child]
                cases.append((f"no {name}.{child}", r, [f"missing:{name}.{child}"]))
                r = copy.deepcopy(FULL)
                r[name][child] = None
                cases.append((f"null {name}.{child}", r, [f"missing:{name}.{child}"]))
    for path, bad in (("event_ts", "not a time"), ("vital.value", "high"), ("vital.value", [1]), ("patient", "p"), ("transfer", 3)):
        r = copy.deepcopy(FULL)
        at, _, child = path.partition(".")
        if child:
            r[at][child] = bad
        else:
            r[at] = bad
        cases.append((f"bad {path} {bad}", r, [f"wrong_type:{path}"]))
    cases.append(("bare", {"event_type": "admitted"}, ["missing:encounter_id", "missing:event_id", "missing:event_ts", "missing:patient_id"]))
    raw = spark.createDataFrame([(n, json.dumps(r)) for n, r, _ in cases], "i string, _raw string")
    p = SRC.rescue_unknown_fields(SRC.parse_permissive(raw, keep_raw=True), contract_keys(EVENT_SCHEMA))
    flat = p.select("i", "_raw", "_corrupt_record", "_rescued_data", "payload.*")
    got = {r.i: [x for x in r.violations if x not in ("corrupt_record", "unknown_field")] for r in CC.validate_contract(flat).collect()}
    for name, _, want in cases:
        assert got[name] == want, name
    valid = {r.i: r.is_valid for r in CC.validate_contract(flat).collect()}
    assert valid["whole"] and not valid["bare"] and not valid["bad event_ts not a time"]
