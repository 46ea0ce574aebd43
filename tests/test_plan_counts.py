"""What a query reads and parses how often."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tidepool.operators import evaluate as E
from tidepool.operators import governed as GV
from tidepool.operators import guards as G
from tidepool.operators import quantiles as Q

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_contract_check_parses_a_line_once(spark):
    from __spark_entry__ import queries

    plan = physical(queries()["validate_contract"](spark, SF))
    assert len(re.findall(r"parse_?json", plan, re.I)) == 1
    # The payload and the map of all keys; the others read one sub-record each.
    assert len(re.findall(r"from_json\(StructField\(event_id", plan)) == 1
    assert plan.count("from_json") <= 2 + 5


@pytest.mark.parametrize("key", ["identity_summary", "person_map", "review_summary", "identity_score", "connected_components", "publish_decisions"])
def test_identity_queries_read_customers_at_most_twice(spark, key, monkeypatch):
    from __spark_entry__ import queries

    from tidepool.plans import identity

    reads = []
    real = identity.read_table
    monkeypatch.setattr(identity, "read_table", lambda *a, **k: reads.append(a[2]) or real(*a, **k))
    plan = physical(queries()[key](spark, SF))
    assert reads.count("customer") <= 2 and plan.count("customer.parquet") <= 2


def test_quantiles_read_their_input_once(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "CAST(id AS double) AS v")
    for keys in ([], ["k"]):
        plan = physical(Q.quantiles(df, keys, "v", {"a": 0.1, "b": 0.9}))
        assert "Range (" not in plan and "NestedLoop" not in plan


def test_lookups_are_cut_at_the_cap_in_the_order_of_their_columns(spark):
    df = spark.range(30).selectExpr("concat('e', lpad(id, 2, '0')) AS encounter_id", "'ICU' AS unit").orderBy(F.desc("encounter_id"))
    got = GV.governed_lookup(df, "fct_encounters", {"unit": "ICU"}, cap=10).collect()
    assert [r.encounter_id for r in got] == [f"e{i:02d}" for i in range(10)] and all(r.truncated for r in got)
    assert not any(r.truncated for r in GV.governed_lookup(df, "fct_encounters", cap=30).collect())
    answer = GV.answer(GV.governed_lookup(df, "fct_encounters", cap=10))
    assert len(answer["rows"]) == 10 and answer["truncated"] and "truncated" not in answer["rows"][0]


def test_values_of_a_hot_key_are_gathered_by_the_texts_that_hold_them(spark):
    values = spark.range(2000).selectExpr("'hot' AS k", "concat('name ', id) AS v").union(
        spark.createDataFrame([("hot", "x"), ("hot", "é"), ("hot", ""), ("hot", None), ("a", "Ann"), ("a", "Ann Lee"), (None, "Ann")], "k string, v string")
    )
    rows = [("hot", "name 7 met name 1999."), ("hot", "nobody"), ("hot", "x"), ("hot", ""), ("hot", None), ("a", "Ann Lee and Ann"), ("b", "Ann"), (None, "Ann"), ("a", "Ann Lee and Ann")]
    texts = spark.createDataFrame(rows, "k string, t string")
    redacted = G.redact_values(texts, values, "k", "t", "v")
    m = G.MASK_LITERAL
    got = sorted(((r.k, r.t, r.leaked_values) for r in redacted.collect()), key=str)
    want = [
        # "name 1" and "name 19", "name 199" stand in "name 1999", and are values before it in order
        ("hot", f"{m} met {m}999.", 5), ("hot", "nobody", 0), ("hot", m, 1), ("hot", "", 0), ("hot", None, 0),
        ("a", f"{m} Lee and {m}", 2), ("a", f"{m} Lee and {m}", 2), ("b", "Ann", 0), (None, "Ann", 0),
    ]
    assert got == sorted(want, key=str)


def test_answers_are_withheld_and_counted(spark):
    rows = [("a", "Ann", 5, 50), ("a", "Bob", 20, 3), ("b", "Cid", 30, 40), ("c", None, 0, None), ("b", G.MASK_LITERAL, 12, 12)]
    df = spark.createDataFrame(rows, "k string, full_name string, n_patients long, visit_count int")
    report = G.guard_report(df).first()
    assert tuple(report) == (5, "full_name", 4, 3, 2)
    texts = spark.createDataFrame([("a", "for a"), ("b", "for b"), ("c", None), ("z", "no rows")], "k string, answer string")
    got = {r.k: (r.withheld, r.answer) for r in G.withhold(texts, G.result_guard(df), "k", "answer").collect()}
    assert got == {"a": (True, G.WITHHELD), "b": (False, "for b"), "c": (False, None), "z": (False, "no rows")}
    plain = G.guard_report(df.select("k")).first()
    assert tuple(plain) == (5, "", 0, 0, 0)


@pytest.mark.parametrize("promoted", [True, False])
def test_a_calibration_counts_only_if_it_was_promoted(spark, promoted):
    scored = spark.createDataFrame([("m", "s", x, x > 3.0) for x in (1.0, 2.0, 4.0)] + [("other", "s", 9.0, True)], "detector string, set string, score double, flag boolean")
    record = spark.createDataFrame([("m", 1.5, promoted)], "model string, score_threshold double, promoted boolean")
    got = sorted((r.score, r.flagged, r.status) for r in E.calibrated(scored, record).collect())
    status = "calibrated" if promoted else "advisory"
    assert got == [(1.0, False, status), (2.0, promoted, status), (4.0, True, status)]


def test_the_time_bound_of_a_metric_reaches_the_scan(spark):
    from __spark_entry__ import queries

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries()["metric_time_range"](spark, SF).explain(mode="formatted")
    readings = [x for x in out.getvalue().splitlines() if "PushedFilters" in x and "purchase" in x]
    assert readings and all("GreaterThanOrEqual(ts,2024-01-10T00:00), LessThan(ts,2024-01-20T00:15)" in x for x in readings)


def test_version_history_reads_its_changes_twice(spark):
    from __spark_entry__ import queries

    assert physical(queries()["scd2_history"](spark, SF)).count("FileScan") == 2
