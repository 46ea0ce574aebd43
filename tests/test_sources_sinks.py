import json
import os

from pyspark.sql import functions as F

from tidepool.contracts import PROVIDER_SCHEMA
from tidepool.operators import cdc, oplog
from tidepool.sources import sinks


def test_json_lines_union_by_name_with_filename_and_scd1_latest(spark, tmp):
    d = os.path.join(tmp, "roster")
    os.makedirs(d)
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(json.dumps({"provider_id": "d1", "full_name": "A", "home_unit": "ED", "updated_at": "2026-01-01T00:00:00Z"}) + "\n")
    with open(os.path.join(d, "b.jsonl"), "w") as f:
        f.write(json.dumps({"provider_id": "d1", "full_name": "A", "home_unit": "ICU", "specialty": "Oncology",
                            "updated_at": "2026-01-02T00:00:00Z", "shift": "night"}) + "\n")
    df = sinks.read_json_lines(spark, d, PROVIDER_SCHEMA)
    assert {os.path.basename(r.filename) for r in df.collect()} == {"a.jsonl", "b.jsonl"}
    latest = cdc.scd1_latest(df, ["provider_id"], "updated_at", ["home_unit", "specialty"]).first()
    assert latest.home_unit == "ICU"


def test_audit_append_and_read_skips_bad_lines(spark, tmp):
    p = os.path.join(tmp, "audit")
    rows = spark.createDataFrame([("2026-01-01T00:00:00", "r1", "da", "compute_metric", "{}", False, None)],
                                 "ts string, request_id string, mode string, tool string, output string, is_error boolean, approved_by string")
    sinks.append_log(rows, p)
    sinks.append_log(rows.withColumn("request_id", F.lit("r2")), p)
    with open(os.path.join(p, "junk.json"), "w") as f:
        f.write("{broken\n" + json.dumps({"request_id": "r3"}) + "\n")
    got = oplog.parse_audit(spark.read.text(p))
    assert sorted(r.request_id for r in got.collect()) == ["r1", "r2"]


def test_publish_decisions_replaces_rows(spark, tmp):
    p = os.path.join(tmp, "decisions")
    one = [{"patient_ids": "pt_1,pt_2", "decision": "same_person", "decided_by": "s", "decided_at": "2026-01-01T00:00:00", "note": "x'); DROP"}]
    assert sinks.publish_decisions(spark, json.dumps(one), p) == 1
    assert sinks.publish_decisions(spark, json.dumps(one * 3), p) == 3
    assert spark.read.parquet(p).first().note == "x'); DROP"
