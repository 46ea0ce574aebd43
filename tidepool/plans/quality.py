"""Catalog queries: ingest, Bronze, expectations and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.contracts import (
    ALLOWED_EVENT_TYPES,
    EVENT_SCHEMA,
    MASK_LITERAL,
    VITAL_ITEMS,
    contract_keys,
    plausible_value_sql,
)
from tidepool.operators import bronze as B
from tidepool.operators import contract_checks as CC
from tidepool.operators import expectations as X
from tidepool.operators import guards as G
from tidepool.plans import sql as S
from tidepool.plans import views as V
from tidepool.plans.registry import query
from tidepool.sources import events as SRC

INGESTED_AT = "2024-02-01 00:00:00"
_ALLOWED_SQL = ", ".join(f"'{t}'" for t in ALLOWED_EVENT_TYPES)
_ITEMS_SQL = ", ".join(f"'{t}'" for t in VITAL_ITEMS)

BRONZE_EXPECTATIONS = [
    X.Expectation("has_event_id", "event_id IS NOT NULL"),
    X.Expectation("has_event_type", "event_type IS NOT NULL"),
]
GATE_EXPECTATIONS = [
    X.Expectation("has_event_type", "event_type IS NOT NULL", X.DROP),
    X.Expectation("known_event_type", f"event_type IS NULL OR event_type IN ({_ALLOWED_SQL})", X.FAIL),
]
VITALS_EXPECTATIONS = [
    X.Expectation("plausible_vital_value", plausible_value_sql(), X.DROP),
    X.Expectation("known_vital_item", f"itemid IN ({_ITEMS_SQL})"),
]

#: Only counted in the log of runs; a run of a week has rows of both items, so it fails.
ONE_ITEM = X.Expectation("is_heart_rate", "itemid = 'heart_rate' AND value < 50")

# SQL twins of the raw feed's construction (see views.raw_feed).
_MAPPED = "CASE raw_type WHEN 'signup' THEN 'admitted' WHEN 'click' THEN 'transferred' WHEN 'error' THEN 'discharged' ELSE 'vitals_reading' END"
_CORRUPT = "(event_id % 50 = 7)"
_RENAMED = "(event_id % 50 = 13 AND raw_type IN ('view', 'purchase'))"
_EXTRA = "(event_id % 50 = 17)"
_RESCUED = f"CASE WHEN {_RENAMED} THEN 'vital.val' WHEN {_EXTRA} THEN 'source_system' END"


def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.raw_feed(spark, sf_dir)
    parsed = SRC.rescue_unknown_fields(SRC.parse_permissive(raw, keep_raw=True), contract_keys(EVENT_SCHEMA))
    return B.bronze_flatten(parsed, INGESTED_AT)


@query(
    "parse_permissive",
    S.with_(S.EV)
    + f"""SELECT event_id, CASE WHEN {_CORRUPT} THEN NULL ELSE event_id END AS parsed_event_id,
       CASE WHEN {_CORRUPT} THEN NULL ELSE {_MAPPED} END AS parsed_event_type,
       {_CORRUPT} AS is_corrupt FROM ev""",
)
def q_parse_permissive(spark, sf_dir):
    p = SRC.parse_permissive(V.raw_feed(spark, sf_dir))
    return p.select(
        F.col("kafka_key").cast("bigint").alias("event_id"),
        F.col("payload.event_id").cast("bigint").alias("parsed_event_id"),
        F.col("payload.event_type").alias("parsed_event_type"),
        F.col("_corrupt_record").isNotNull().alias("is_corrupt"),
    )


@query("rescue_unknown_fields", S.with_(S.EV) + f"SELECT event_id, {_RESCUED} AS rescued_keys FROM ev")
def q_rescue_unknown_fields(spark, sf_dir):
    p = SRC.rescue_unknown_fields(V.raw_feed(spark, sf_dir), contract_keys(EVENT_SCHEMA))
    return p.select(F.col("kafka_key").cast("bigint").alias("event_id"), SRC.rescued_keys().alias("rescued_keys"))


@query(
    "bronze_flatten",
    S.with_(S.EV)
    + f"""SELECT event_id AS kafka_key,
       CASE WHEN {_CORRUPT} THEN NULL ELSE event_id END AS event_id,
       CASE WHEN {_CORRUPT} THEN NULL ELSE {_MAPPED} END AS event_type,
       CASE WHEN {_CORRUPT} THEN NULL ELSE event_ts END AS event_ts,
       CASE WHEN {_CORRUPT} THEN NULL ELSE encounter_id END AS encounter_id,
       CASE WHEN NOT {_CORRUPT} AND raw_type = 'signup' THEN {S.pick_sql(V.UNITS, 'k')} END AS unit,
       CASE WHEN NOT {_CORRUPT} AND raw_type = 'click' THEN {S.pick_sql(V.UNITS, 'k')} END AS to_unit,
       CASE WHEN NOT {_CORRUPT} AND raw_type = 'view' THEN 'heart_rate' WHEN NOT {_CORRUPT} AND raw_type = 'purchase' THEN 'spo2' END AS itemid,
       CASE WHEN NOT {_CORRUPT} AND NOT {_RENAMED} AND raw_type IN ('view', 'purchase') THEN round(value, 6) END AS value,
       {_CORRUPT} AS is_corrupt,
       TIMESTAMP '{INGESTED_AT}' AS ingested_at
    FROM ev""",
)
def q_bronze_flatten(spark, sf_dir):
    b = bronze_events(spark, sf_dir)
    return b.select(
        F.col("kafka_key").cast("bigint").alias("kafka_key"),
        F.col("event_id").cast("bigint").alias("event_id"),
        "event_type",
        F.col("event_ts").cast("timestamp_ntz").alias("event_ts"),
        F.col("encounter_id").cast("bigint").alias("encounter_id"),
        F.col("encounter.unit").alias("unit"),
        F.col("transfer.to_unit").alias("to_unit"),
        F.col("vital.itemid").alias("itemid"),
        F.round("vital.value", 6).alias("value"),
        F.col("_corrupt_record").isNotNull().alias("is_corrupt"),
        F.col("_ingested_at").cast("timestamp_ntz").alias("ingested_at"),
    )


def _band_sql() -> str:
    return "((raw_type = 'view' AND (value < 55 OR value > 140)) OR (raw_type = 'purchase' AND (value < 88 OR value > 100)))"


@query(
    "validate_contract",
    S.with_(S.EV)
    + f"""SELECT event_id,
       CASE WHEN {_CORRUPT} THEN 'corrupt_record,missing_event_type' ELSE concat_ws(',',
            -- the feed never sends the unit a patient is moved from
            CASE WHEN raw_type = 'click' THEN 'missing:transfer.from_unit' END,
            CASE WHEN {_RENAMED} THEN 'missing:vital.value' END,
            CASE WHEN {_RENAMED} OR {_EXTRA} THEN 'unknown_field' END) END AS violations,
       NOT ({_CORRUPT} OR {_RENAMED} OR {_EXTRA} OR raw_type = 'click') AS is_valid,
       CASE WHEN {_CORRUPT} OR {_RENAMED} THEN false ELSE {_band_sql()} END AS out_of_range
    FROM ev""",
)
def q_validate_contract(spark, sf_dir):
    raw = V.raw_feed(spark, sf_dir)
    parsed = SRC.rescue_unknown_fields(SRC.parse_permissive(raw, keep_raw=True), contract_keys(EVENT_SCHEMA))
    flat = parsed.select("kafka_key", "_raw", "_corrupt_record", "_rescued_data", "payload.*")
    v = CC.validate_contract(flat)
    return v.select(
        F.col("kafka_key").cast("bigint").alias("event_id"),
        F.array_join("violations", ",").alias("violations"),
        "is_valid",
        "out_of_range",
    )


_OBSERVED = """observed AS (
  SELECT DISTINCT unnest(list_value('event_id', 'event_type', 'event_ts', 'patient_id', 'encounter_id', 'schema_version',
      CASE WHEN raw_type = 'signup' THEN 'patient' END, CASE WHEN raw_type = 'signup' THEN 'encounter' END,
      CASE WHEN raw_type = 'click' THEN 'transfer' END, CASE WHEN raw_type IN ('view', 'purchase') THEN 'vital' END,
      CASE WHEN event_id % 50 = 17 THEN 'source_system' END)) AS field
  FROM ev WHERE NOT (event_id % 50 = 7))"""
_EXPECTED = "expected AS (SELECT unnest([" + ", ".join(f"'{f.name}'" for f in EVENT_SCHEMA.fields) + "]) AS field)"


@query(
    "schema_drift",
    S.with_(S.EV, _OBSERVED, _EXPECTED)
    + """SELECT 'missing' AS kind, field FROM expected WHERE field NOT IN (SELECT field FROM observed WHERE field IS NOT NULL)
    UNION ALL
    SELECT 'unexpected' AS kind, field FROM observed WHERE field IS NOT NULL AND field NOT IN (SELECT field FROM expected)""",
)
def q_schema_drift(spark, sf_dir):
    return CC.schema_drift(V.raw_feed(spark, sf_dir), [f.name for f in EVENT_SCHEMA.fields])


@query(
    "plausible_value",
    S.with_(S.EV, S.VIT) + f"SELECT event_id, itemid, value, {plausible_value_sql()} AS plausible FROM vit_all",
)
def q_plausible_value(spark, sf_dir):
    v = V.vitals_project(V.event_envelope(V.events(spark, sf_dir)))
    return v.select("event_id", "itemid", "value", F.expr(plausible_value_sql()).alias("plausible"))


@query(
    "expect_warn",
    S.with_(S.EV, S.VIT)
    + f"""SELECT 'silver_fct_vitals' AS dataset, 'plausible_vital_value' AS expectation, 'drop' AS action,
       count(*) FILTER (WHERE COALESCE({plausible_value_sql()}, false)) AS passed,
       count(*) FILTER (WHERE NOT COALESCE({plausible_value_sql()}, false)) AS failed FROM vit_all
    UNION ALL
    SELECT 'silver_fct_vitals', 'known_vital_item', 'warn',
       count(*) FILTER (WHERE COALESCE(itemid IN ({_ITEMS_SQL}), false)),
       count(*) FILTER (WHERE NOT COALESCE(itemid IN ({_ITEMS_SQL}), false)) FROM vit_all""",
)
def q_expect_warn(spark, sf_dir):
    v = V.vitals_project(V.event_envelope(V.events(spark, sf_dir)))
    return X.expectation_metrics(v, "silver_fct_vitals", VITALS_EXPECTATIONS)


@query("expect_drop", S.with_(S.EV, S.VIT) + "SELECT event_id, itemid, value FROM vit")
def q_expect_drop(spark, sf_dir):
    v = V.vitals_project(V.event_envelope(V.events(spark, sf_dir)))
    return X.apply_expectations(v, VITALS_EXPECTATIONS).select("event_id", "itemid", "value")


@query(
    "contract_gate",
    S.with_(S.EV) + f"SELECT event_id AS kafka_key, {_MAPPED} AS event_type FROM ev WHERE NOT {_CORRUPT}",
)
def q_contract_gate(spark, sf_dir):
    gated = X.apply_expectations(bronze_events(spark, sf_dir), GATE_EXPECTATIONS)
    return gated.select(F.col("kafka_key").cast("bigint").alias("kafka_key"), "event_type")


def expectation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectation counts per run (one run per week of arrival) for Bronze and the
    vitals table - the metrics store the summary reads."""
    b = bronze_events(spark, sf_dir).withColumn("run_id", F.date_format(F.date_trunc("week", "kafka_timestamp"), "yyyy-MM-dd"))
    v = V.vitals_project(V.event_envelope(V.events(spark, sf_dir))).withColumn(
        "run_id", F.date_format(F.date_trunc("week", F.col("event_ts") + F.make_interval(mins=(F.col("event_id") % 7).cast("int"))), "yyyy-MM-dd")
    )
    parts = []
    for name, df, exps in (("bronze_patient_events", b, BRONZE_EXPECTATIONS), ("silver_fct_vitals", v, [*VITALS_EXPECTATIONS, ONE_ITEM])):
        counts = df.groupBy("run_id").agg(
            F.array(
                *(
                    F.struct(F.lit(e.name).alias("expectation"), F.count_if(e.passed()).alias("passed"), F.count_if(~e.passed()).alias("failed"))
                    for e in exps
                )
            ).alias("counted")
        )
        parts.append(counts.select("run_id", F.lit(name).alias("dataset"), F.inline("counted")))
    log = parts[0].unionByName(parts[1])
    return log.withColumn("run_ts", F.to_timestamp("run_id"))


_LOG_SQL = f"""bev AS (
  SELECT strftime(date_trunc('week', event_ts + INTERVAL 1 MINUTE * CAST(event_id % 7 AS INTEGER)), '%Y-%m-%d') AS run_id,
         CASE WHEN {_CORRUPT} THEN NULL ELSE event_id END AS event_id,
         CASE WHEN {_CORRUPT} THEN NULL ELSE {_MAPPED} END AS event_type,
         CASE WHEN raw_type = 'view' THEN 'heart_rate' WHEN raw_type = 'purchase' THEN 'spo2' END AS itemid,
         value, raw_type
  FROM ev),
log AS (
  SELECT run_id, 'bronze_patient_events' AS dataset, 'has_event_id' AS expectation,
         count(*) FILTER (WHERE event_id IS NOT NULL) AS passed, count(*) FILTER (WHERE event_id IS NULL) AS failed FROM bev GROUP BY run_id
  UNION ALL
  SELECT run_id, 'bronze_patient_events', 'has_event_type',
         count(*) FILTER (WHERE event_type IS NOT NULL), count(*) FILTER (WHERE event_type IS NULL) FROM bev GROUP BY run_id
  UNION ALL
  SELECT run_id, 'silver_fct_vitals', 'plausible_vital_value',
         count(*) FILTER (WHERE COALESCE({plausible_value_sql()}, false)), count(*) FILTER (WHERE NOT COALESCE({plausible_value_sql()}, false))
  FROM bev WHERE raw_type IN ('view', 'purchase') GROUP BY run_id
  UNION ALL
  SELECT run_id, 'silver_fct_vitals', 'known_vital_item',
         count(*) FILTER (WHERE COALESCE(itemid IN ({_ITEMS_SQL}), false)), count(*) FILTER (WHERE NOT COALESCE(itemid IN ({_ITEMS_SQL}), false))
  FROM bev WHERE raw_type IN ('view', 'purchase') GROUP BY run_id
  UNION ALL
  SELECT run_id, 'silver_fct_vitals', 'is_heart_rate', count(*) FILTER (WHERE raw_type = 'view' AND value < 50),
         count(*) - count(*) FILTER (WHERE raw_type = 'view' AND value < 50)
  FROM bev WHERE raw_type IN ('view', 'purchase') GROUP BY run_id),
summary AS (
  SELECT dataset, expectation, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(failed) AS BIGINT) AS failed
  FROM log WHERE run_id = (SELECT max(run_id) FROM log) GROUP BY dataset, expectation)
"""


@query("expectation_summary", S.with_(S.EV, _LOG_SQL) + "SELECT dataset, expectation, passed, failed FROM summary")
def q_expectation_summary(spark, sf_dir):
    return X.latest_run_summary(expectation_log(spark, sf_dir))


@query(
    "failing_expectations",
    S.with_(S.EV, _LOG_SQL) + "SELECT dataset, expectation, passed, failed FROM summary WHERE failed > 0",
)
def q_failing_expectations(spark, sf_dir):
    return X.failing(X.latest_run_summary(expectation_log(spark, sf_dir)))


@query(
    "mask_check",
    S.with_(S.EV, S.ADM, S.PAT)
    + """, masked AS (SELECT patient_id, '***REDACTED***' AS full_name, '***REDACTED***' AS mrn FROM pat)
    SELECT count(*) AS row_count, count(*) FILTER (WHERE full_name = '***REDACTED***') AS masked_full_name,
       count(*) FILTER (WHERE mrn = '***REDACTED***') AS masked_mrn FROM masked""",
)
def q_mask_check(spark, sf_dir):
    masked = G.mask_columns(V.patients_current(spark, sf_dir), "dim_patients", role="analyst")
    return CC.mask_check(masked, ["full_name", "mrn"], MASK_LITERAL)


CATALOG_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                  "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(
    "table_row_counts",
    "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, 'TABLE' AS table_type, count(*) AS row_count FROM {t}" for t in CATALOG_TABLES),
)
def q_table_row_counts(spark, sf_dir):
    """Tables of the catalog with type and row count (names starting with
    '_' are internal and skipped): one count aggregate per table, unioned."""
    from tidepool.sources.tables import read_table

    out = None
    for t in CATALOG_TABLES:
        if t.startswith("_"):
            continue
        c = read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"), F.lit("TABLE").alias("table_type"), "row_count"
        )
        out = c if out is None else out.unionByName(c)
    return out
