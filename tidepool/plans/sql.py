"""SQL forms of the domain views, for the DuckDB oracle.

Each constant is a list of CTEs (``name AS (...)``) in portable SQL; oracle
queries start with ``WITH`` + the CTEs they need. These are written
independently of the DataFrame code in ``views.py`` (plain windows and
interval joins), so parity checks two different formulations.
"""

from __future__ import annotations

from tidepool.contracts import ALERT_BANDS, plausible_value_sql
from tidepool.plans.views import ENCOUNTER_TYPES, GENDERS, REGIONS, UNITS


def pick_sql(values, expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({expr}) % {len(values)} {whens} END)"


EV = f"""ev AS (
  SELECT event_id, ts AS event_ts, user_id AS patient_id, user_id AS encounter_id,
         event_type AS raw_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events)"""

CDC = f"""cdc AS (
  SELECT encounter_id, patient_id, event_ts, event_id,
    CASE raw_type WHEN 'signup' THEN 'admitted' WHEN 'click' THEN 'transferred' ELSE 'discharged' END AS event_type,
    CASE WHEN raw_type = 'signup' THEN {pick_sql(ENCOUNTER_TYPES, 'k')} END AS encounter_type,
    CASE WHEN raw_type IN ('signup', 'click') THEN {pick_sql(UNITS, 'k')} END AS unit,
    CASE WHEN raw_type = 'signup' THEN CAST(k % 10 AS BIGINT) END AS attending_provider_id,
    CASE raw_type WHEN 'signup' THEN 'in-progress' WHEN 'error' THEN 'discharged' END AS status
  FROM ev WHERE raw_type IN ('signup', 'click', 'error'))"""

_W = "PARTITION BY encounter_id ORDER BY event_ts, event_id"
_CF = f"OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
HIST = f"""hist AS (
  SELECT encounter_id,
    last_value(patient_id IGNORE NULLS) {_CF} AS patient_id,
    last_value(encounter_type IGNORE NULLS) {_CF} AS encounter_type,
    last_value(unit IGNORE NULLS) {_CF} AS unit,
    last_value(attending_provider_id IGNORE NULLS) {_CF} AS attending_provider_id,
    last_value(status IGNORE NULLS) {_CF} AS status,
    event_ts AS valid_from,
    lead(event_ts) OVER ({_W}) AS valid_to,
    event_id
  FROM cdc)"""

CUR = f"""cur AS (
  SELECT encounter_id,
    max(event_ts) AS event_ts,
    arg_max(patient_id, struct_pack(t := event_ts, i := event_id)) FILTER (WHERE patient_id IS NOT NULL) AS patient_id,
    arg_max(encounter_type, struct_pack(t := event_ts, i := event_id)) FILTER (WHERE encounter_type IS NOT NULL) AS encounter_type,
    arg_max(unit, struct_pack(t := event_ts, i := event_id)) FILTER (WHERE unit IS NOT NULL) AS unit,
    arg_max(attending_provider_id, struct_pack(t := event_ts, i := event_id)) FILTER (WHERE attending_provider_id IS NOT NULL) AS attending_provider_id,
    arg_max(status, struct_pack(t := event_ts, i := event_id)) FILTER (WHERE status IS NOT NULL) AS status
  FROM cdc GROUP BY encounter_id)"""

VIT = f"""vit_all AS (
  SELECT event_id, event_ts, patient_id, encounter_id,
    CASE raw_type WHEN 'view' THEN 'heart_rate' ELSE 'spo2' END AS itemid, value,
    CASE raw_type WHEN 'view' THEN 'bpm' ELSE '%' END AS valueuom
  FROM ev WHERE raw_type IN ('view', 'purchase')),
vit AS (SELECT * FROM vit_all WHERE {plausible_value_sql()})"""

HR_LOW, HR_HIGH = ALERT_BANDS["heart_rate"]
LIVE = f"""joined AS (
  SELECT v.event_ts, v.value, COALESCE(h.unit, 'UNASSIGNED') AS unit
  FROM (SELECT * FROM vit WHERE itemid = 'heart_rate') v
  LEFT JOIN hist h ON v.encounter_id = h.encounter_id AND v.event_ts >= h.valid_from
       AND (h.valid_to IS NULL OR v.event_ts < h.valid_to)),
live AS (
  SELECT time_bucket(INTERVAL 15 MINUTE, event_ts) AS window_start,
         time_bucket(INTERVAL 15 MINUTE, event_ts) + INTERVAL 15 MINUTE AS window_end,
         unit, avg(value) AS avg_heart_rate,
         CAST(sum(CASE WHEN value < {HR_LOW} OR value > {HR_HIGH} THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range_count,
         count(*) AS reading_count
  FROM joined GROUP BY 1, 2, 3)"""

ADM = f"""adm AS (
  SELECT patient_id, encounter_id, event_ts,
    'Patient ' || CAST(patient_id AS VARCHAR) AS full_name,
    CAST(make_date(1940 + patient_id % 60, 1 + patient_id % 12, 1 + patient_id % 28) AS VARCHAR) AS birth_date,
    {pick_sql(GENDERS, 'patient_id')} AS gender,
    {pick_sql(REGIONS, 'patient_id')} AS region,
    'MRN-' || lpad(CAST(patient_id AS VARCHAR), 6, '0') AS mrn,
    event_id
  FROM ev WHERE raw_type = 'signup')"""

PAT = """pat AS (
  SELECT patient_id, max(event_ts) AS event_ts,
    arg_max(mrn, struct_pack(t := event_ts, i := event_id)) AS mrn,
    arg_max(full_name, struct_pack(t := event_ts, i := event_id)) AS full_name,
    arg_max(birth_date, struct_pack(t := event_ts, i := event_id)) AS birth_date,
    arg_max(gender, struct_pack(t := event_ts, i := event_id)) AS gender,
    arg_max(region, struct_pack(t := event_ts, i := event_id)) AS region
  FROM adm GROUP BY patient_id)"""

PROV = f"""prov AS (
  SELECT s_suppkey AS provider_id, s_name AS full_name,
    {pick_sql(("Cardiology", "Critical Care", "Emergency Medicine", "Internal Medicine", "Oncology"), 's_suppkey')} AS specialty,
    {pick_sql(UNITS, 's_nationkey')} AS home_unit
  FROM supplier)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
