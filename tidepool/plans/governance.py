"""Catalog queries: governed reads, the metric layer and governance guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.contracts import MASK_LITERAL, MAX_NOTES_LENGTH
from tidepool.operators import governed as GV
from tidepool.operators import guards as G
from tidepool.operators import metrics as M
from tidepool.plans import sql as S
from tidepool.plans import views as V
from tidepool.plans.lakehouse import AS_OF_TS, live_vitals_by_unit
from tidepool.plans.registry import query
from tidepool.sources.tables import read_table


def gold(spark: SparkSession, sf_dir: str):
    builders = {
        "dim_patients": V.patients_current,
        "dim_providers": V.providers,
        "fct_encounters": V.encounters_current,
        "fct_encounter_history": V.encounter_history,
        "fct_vitals": V.fct_vitals,
        "gold_live_vitals_by_unit": live_vitals_by_unit,
    }
    return lambda name, **bounds: builders[name](spark, sf_dir, **bounds)


GOLD_CTES = S.with_(
    S.EV, S.CDC, S.HIST, S.CUR, S.VIT, S.LIVE, S.ADM, S.PAT, S.PROV,
    "dim_patients AS (SELECT * FROM pat)",
    "dim_providers AS (SELECT * FROM prov)",
    "fct_encounters AS (SELECT * FROM cur)",
    "fct_encounter_history AS (SELECT * FROM hist)",
    "fct_vitals AS (SELECT * FROM vit)",
    "gold_live_vitals_by_unit AS (SELECT * FROM live)",
)


def _round_value(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round(F.col("value").cast("double"), 6))


def _rounded_sql(inner: str, groups: list[str]) -> str:
    cols = ", ".join([*groups, "round(CAST(value AS DOUBLE), 6) AS value", "suppressed"])
    return f"SELECT {cols} FROM ({inner}) r"


# --- metric layer: one key per metric ---------------------------------------
METRIC_CASES = {
    "current_census": {"group_by": ["unit"]},
    "census_at_time": {"group_by": ["unit"], "as_of": AS_OF_TS},
    "discharged_encounters": {"group_by": ["unit"]},
    "avg_heart_rate": {"group_by": ["unit"]},
    "out_of_range_heart_rate_readings": {"group_by": ["unit"]},
    "heart_rate_readings": {"group_by": ["unit"]},
    "avg_vital_value": {"group_by": ["itemid"]},
    "provider_count": {"group_by": ["specialty"]},
    "patient_count": {"group_by": ["region"]},
}


def _register_metric(metric_id: str, case: dict, key: str | None = None) -> None:
    groups = case.get("group_by", [])
    sql = GOLD_CTES + _rounded_sql(M.render_suppressed_sql(metric_id, **case), groups)

    def fn(spark, sf_dir, _m=metric_id, _c=case):
        return _round_value(M.compute_metric(gold(spark, sf_dir), _m, **_c))

    query(key or f"metric_{metric_id}", sql)(fn)


for _mid, _case in METRIC_CASES.items():
    _register_metric(_mid, _case)

_register_metric(
    "heart_rate_readings",
    {"group_by": ["unit"], "since": "2024-01-10 00:00:00", "until": "2024-01-20 00:00:00"},
    key="metric_time_range",
)
_register_metric("avg_heart_rate", {}, key="weighted_avg")


# --- governed reads ----------------------------------------------------------
@query(
    "governed_lookup",
    GOLD_CTES.rstrip() + """,
hit AS (SELECT encounter_id, patient_id, unit, status, row_number() OVER (ORDER BY encounter_id) AS i, count(*) OVER () AS n
        FROM fct_encounters WHERE unit = 'ICU' AND status = 'in-progress')
SELECT encounter_id, patient_id, unit, status, n > 500 AS truncated FROM hit WHERE i <= 500""",
)
def q_governed_lookup(spark, sf_dir):
    df = V.encounters_current(spark, sf_dir)
    out = GV.governed_lookup(df, "fct_encounters", {"unit": "ICU", "status": "in-progress"})
    return out.select("encounter_id", "patient_id", "unit", "status", "truncated")


@query(
    "governed_where",
    GOLD_CTES + "SELECT event_id, itemid, value FROM fct_vitals WHERE itemid = 'heart_rate' AND value >= 100 AND value < 300",
)
def q_governed_where(spark, sf_dir):
    df = V.fct_vitals(spark, sf_dir)
    cond = GV.conditions("fct_vitals", {"itemid": "heart_rate"}, [{"column": "value", "op": ">=", "value": 100}, {"column": "value", "op": "<", "value": 300}])
    return df.filter(cond).select("event_id", "itemid", "value")


@query(
    "governed_aggregate",
    GOLD_CTES
    + """SELECT unit, encounter_type, CASE WHEN c > 0 AND c < 11 THEN NULL ELSE v END AS value, COALESCE(c > 0 AND c < 11, false) AS suppressed,
      count(*) OVER () > 500 AS truncated
    FROM (SELECT unit, encounter_type, count(*) AS v, count(DISTINCT patient_id) AS c FROM fct_encounters GROUP BY unit, encounter_type) q
    QUALIFY row_number() OVER (ORDER BY unit NULLS FIRST, encounter_type NULLS FIRST) <= 500""",
)
def q_governed_aggregate(spark, sf_dir):
    return GV.governed_aggregate(V.encounters_current(spark, sf_dir), "fct_encounters", "count", group_by=["unit", "encounter_type"])


@query(
    "suppress_small_cells",
    GOLD_CTES
    + """SELECT attending_provider_id, CASE WHEN c > 0 AND c < 11 THEN NULL ELSE v END AS value, COALESCE(c > 0 AND c < 11, false) AS suppressed,
      count(*) OVER () > 500 AS truncated
    FROM (SELECT attending_provider_id, count(DISTINCT patient_id) AS v, count(DISTINCT patient_id) AS c
          FROM fct_encounter_history WHERE status = 'in-progress' GROUP BY attending_provider_id) q
    QUALIFY row_number() OVER (ORDER BY attending_provider_id NULLS FIRST) <= 500""",
)
def q_suppress_small_cells(spark, sf_dir):
    return GV.governed_aggregate(
        V.encounter_history(spark, sf_dir), "fct_encounter_history", "count_distinct", "patient_id",
        filters={"status": "in-progress"}, group_by=["attending_provider_id"],
    )


@query(
    "row_cap",
    GOLD_CTES + "SELECT CAST(least(count(*), 500) AS BIGINT) AS returned_rows, count(*) > 500 AS truncated FROM (SELECT * FROM fct_vitals LIMIT 501) q",
)
def q_row_cap(spark, sf_dir):
    return GV.row_cap_status(V.fct_vitals(spark, sf_dir))


_NORM_INPUT = "CASE k % 3 WHEN 0 THEN lower(unit) WHEN 1 THEN upper(unit) ELSE ' ' || unit || ' ' END"


@query(
    "normalize_dimension",
    S.with_(S.EV, S.CDC, "ev_units AS (SELECT DISTINCT " + _NORM_INPUT + " AS requested FROM cdc JOIN ev USING (event_id) WHERE unit IS NOT NULL)")
    + "SELECT requested, CASE lower(trim(requested)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted({**{u.lower(): u for u in M.DIMENSIONS['unit']['values']}, **M.DIMENSIONS['unit']['synonyms']}.items()))
    + " END AS canonical FROM ev_units",
)
def q_normalize_dimension(spark, sf_dir):
    ev = V.events(spark, sf_dir).select("event_id", F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"))
    feed = V.cdc_feed(spark, sf_dir).filter(F.col("unit").isNotNull()).join(ev, "event_id")
    k, unit = F.col("k"), F.col("unit")
    requested = F.when(k % 3 == 0, F.lower(unit)).when(k % 3 == 1, F.upper(unit)).otherwise(F.concat(F.lit(" "), unit, F.lit(" ")))
    req = feed.select(requested.alias("requested")).distinct()
    return req.select("requested", M.normalize_column("unit", F.col("requested")).alias("canonical"))


@query(
    "top_group",
    "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 1",
)
def q_top_group(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderpriority"])
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(1)


@query(
    "fact_dim_count",
    """SELECT count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'F'""",
)
def q_fact_dim_count(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus"]).filter(F.col("o_orderstatus") == "F")
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]).filter(F.col("c_mktsegment") == "BUILDING")
    return o.join(c, o.o_custkey == c.c_custkey).agg(F.count(F.lit(1)).alias("n"))


# --- masks, filters, scans --------------------------------------------------
@query(
    "mask_columns",
    GOLD_CTES + "SELECT patient_id, '***REDACTED***' AS full_name, '***REDACTED***' AS mrn, region FROM dim_patients",
)
def q_mask_columns(spark, sf_dir):
    df = V.patients_current(spark, sf_dir).select("patient_id", "full_name", "mrn", "region")
    return G.mask_columns(df, "dim_patients", role="analyst")


@query(
    "row_filter",
    GOLD_CTES + "SELECT encounter_id, unit FROM fct_encounters WHERE 'unit_' || lower(unit) IN ('unit_icu', 'unit_ed')",
)
def q_row_filter(spark, sf_dir):
    df = V.encounters_current(spark, sf_dir).select("encounter_id", "unit")
    return G.row_filter(df, "unit", ["clinical_reader", "unit_icu", "unit_ed"])


def _injection_sql(text: str) -> str:
    t = f"lower({text})"
    over = " OR ".join(f"instr({t}, '{p}') > 0" for p in G.OVERRIDE_PHRASES)

    def nouns(s):
        return "(" + " OR ".join(f"instr({s}, '{n.replace(chr(39), chr(39) * 2)}') > 0" for n in G.SENSITIVE_NOUNS) + ")"

    near = []
    for v in G.EXFIL_VERBS:
        pos = f"instr({t}, '{v}')"
        start0 = f"greatest(0, {pos} - 1 - 60)"
        win = f"substring({t}, {start0} + 1, ({pos} - 1 + 60) - {start0})"
        near.append(f"({pos} > 0 AND {nouns(win)})")
    word = f"(regexp_matches({t}, '\\b(reveal|leak|expose)\\b') AND {nouns(t)})"
    return f"COALESCE(({over}) OR {' OR '.join(near)} OR {word}, false)"


@query(
    "injection_scan",
    f"""SELECT 'conversations' AS source, conv_id * 1000 + turn AS item_id, {_injection_sql('text')} AS flagged FROM conversations
    UNION ALL SELECT 'documents', doc_id, {_injection_sql('text')} FROM documents""",
)
def q_injection_scan(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    a = conv.select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), G.injection_flag(F.col("text")).alias("flagged"))
    b = docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("item_id"), G.injection_flag(F.col("text")).alias("flagged"))
    return a.unionByName(b)


@query(
    "truncate_text",
    f"""SELECT doc_id, length(text) > {MAX_NOTES_LENGTH} AS truncated,
       md5(CASE WHEN length(text) > {MAX_NOTES_LENGTH} THEN substring(text, 1, {MAX_NOTES_LENGTH}) || '...<truncated>' ELSE text END) AS text_md5
    FROM documents""",
)
def q_truncate_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", (F.length("text") > MAX_NOTES_LENGTH).alias("truncated"), F.md5(G.truncate_text(F.col("text"), MAX_NOTES_LENGTH)).alias("text_md5"))


@query(
    "phi_request_scan",
    "SELECT conv_id, turn, COALESCE(regexp_matches(text, '" + G.PHI_REQUEST_PATTERN.replace("'", "''") + "'), false) AS phi_request FROM conversations WHERE role = 'user'",
)
def q_phi_request_scan(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).filter(F.col("role") == "user")
    return c.select("conv_id", "turn", G.phi_request(F.col("text")).alias("phi_request"))


def provider_result(spark, sf_dir) -> DataFrame:
    """A result table an answer could carry: patients per attending provider
    with the provider's name."""
    hist = V.encounter_history(spark, sf_dir).filter(F.col("attending_provider_id").isNotNull())
    per = hist.groupBy("attending_provider_id").agg(F.count_distinct("patient_id").alias("n_patients"))
    prov = V.providers(spark, sf_dir).select(F.col("provider_id").alias("attending_provider_id"), "full_name")
    return per.join(prov, "attending_provider_id", "left")


_PROVIDER_RESULT_SQL = GOLD_CTES.rstrip() + """,
pr AS (SELECT h.attending_provider_id, count(DISTINCT h.patient_id) AS n_patients, any_value(p.full_name) AS full_name
       FROM fct_encounter_history h LEFT JOIN dim_providers p ON p.provider_id = h.attending_provider_id
       WHERE h.attending_provider_id IS NOT NULL GROUP BY h.attending_provider_id)
"""


@query(
    "result_guard",
    _PROVIDER_RESULT_SQL
    + """SELECT attending_provider_id, '***REDACTED***' AS full_name,
       CASE WHEN n_patients > 0 AND n_patients < 11 THEN NULL ELSE n_patients END AS n_patients,
       COALESCE(n_patients > 0 AND n_patients < 11, false) AS n_patients_suppressed FROM pr""",
)
def q_result_guard(spark, sf_dir):
    return G.result_guard(provider_result(spark, sf_dir))


@query(
    "redact_values",
    _PROVIDER_RESULT_SQL
    + """SELECT attending_provider_id, 'Provider ***REDACTED*** saw ' || CAST(n_patients AS VARCHAR) || ' patients' AS answer,
       CASE WHEN full_name IS NULL THEN 0 ELSE 1 END AS leaked_values FROM pr""",
)
def q_redact_values(spark, sf_dir):
    res = provider_result(spark, sf_dir)
    texts = res.select("attending_provider_id", F.concat(F.lit("Provider "), F.col("full_name"), F.lit(" saw "), F.col("n_patients").cast("string"), F.lit(" patients")).alias("answer"))
    values = res.select("attending_provider_id", "full_name")
    out = G.redact_values(texts, values, "attending_provider_id", "answer", "full_name")
    return out.select("attending_provider_id", "answer", F.col("leaked_values").cast("int").alias("leaked_values"))


@query(
    "guard_report",
    _PROVIDER_RESULT_SQL
    + """SELECT count(*) AS row_count, 'full_name' AS masked_columns, count(full_name) AS masked_cells, count(DISTINCT full_name) AS raw_values,
       count_if(n_patients > 0 AND n_patients < 11) AS suppressed_cells FROM pr""",
)
def q_guard_report(spark, sf_dir):
    return G.guard_report(provider_result(spark, sf_dir))


@query(
    "withheld_answers",
    _PROVIDER_RESULT_SQL
    + """SELECT attending_provider_id, n_patients > 0 AND n_patients < 11 AS withheld,
       CASE WHEN n_patients > 0 AND n_patients < 11 THEN 'The answer was withheld: it includes a group of fewer than 11 patients, which is too small to report.'
         ELSE 'Provider ***REDACTED*** saw ' || CAST(n_patients AS VARCHAR) || ' patients' END AS answer FROM pr""",
)
def q_withheld_answers(spark, sf_dir):
    """Answers beside their guarded rows: withheld where a cell was suppressed,
    else with the raw values redacted."""
    res = provider_result(spark, sf_dir)
    texts = res.select("attending_provider_id", F.concat(F.lit("Provider "), F.col("full_name"), F.lit(" saw "), F.col("n_patients").cast("string"), F.lit(" patients")).alias("answer"))
    redacted = G.redact_values(texts, res.select("attending_provider_id", "full_name"), "attending_provider_id", "answer", "full_name").drop("leaked_values")
    return G.withhold(redacted, G.result_guard(res), "attending_provider_id", "answer").select("attending_provider_id", "withheld", "answer")


def query_log(spark, sf_dir) -> DataFrame:
    """The analyst query log over the encounter history: one asked question
    and the SQL that answered it per history version. The SQL filters the
    version's unit; the question names the previous version's unit; SQL for
    discharged versions reads the Silver table."""
    hist = V.encounter_history(spark, sf_dir).filter(F.col("unit").isNotNull())
    w = F.lag("unit").over(Window.partitionBy("encounter_id").orderBy("valid_from", F.col("valid_to").asc_nulls_last(), "unit", "status"))
    h = hist.withColumn("asked_unit", F.coalesce(w, F.col("unit")))
    schema = F.when(F.col("status") == "discharged", F.lit("main.silver.silver_fct_encounters")).otherwise(F.lit("main.gold.fct_encounters"))
    return h.select(
        "encounter_id", "valid_from",
        F.concat(F.lit("How many patients are in "), F.col("asked_unit"), F.lit(" right now?")).alias("question"),
        F.concat(F.lit("SELECT COUNT(*) AS n FROM "), schema, F.lit(" WHERE unit = '"), F.col("unit"), F.lit("'")).alias("sql"),
    )


@query(
    "query_log_audit",
    GOLD_CTES.rstrip() + """,
ql AS (SELECT encounter_id, valid_from, unit, status,
         COALESCE(lag(unit) OVER (PARTITION BY encounter_id ORDER BY valid_from, valid_to NULLS LAST, unit, status NULLS FIRST), unit) AS asked_unit
       FROM fct_encounter_history WHERE unit IS NOT NULL)
SELECT encounter_id, valid_from,
  CASE WHEN status = 'discharged' THEN 'main.silver.silver_fct_encounters' ELSE '' END AS outside_gold,
  CASE WHEN asked_unit = unit THEN '' ELSE 'unit = ''' || unit || '''' END AS unasked,
  status IS DISTINCT FROM 'discharged' AS reads_patient_data, 'n' AS count_aliases
FROM ql""",
)
def q_query_log_audit(spark, sf_dir):
    ql = query_log(spark, sf_dir)
    dims = {k: v for k, v in M.DIMENSIONS.items()}
    return ql.select(
        "encounter_id", "valid_from",
        F.array_join(G.outside_gold(F.col("sql")), ",").alias("outside_gold"),
        F.array_join(G.unasked_filters(F.col("question"), F.col("sql"), dims), ",").alias("unasked"),
        G.reads_patient_data(F.col("sql")).alias("reads_patient_data"),
        F.array_join(G.count_aliases(F.col("sql")), ",").alias("count_aliases"),
    )


@query(
    "identifier_leak_scan",
    GOLD_CTES + "SELECT patient_id, true AS raw_leak, false AS masked_leak FROM dim_patients",
)
def q_identifier_leak_scan(spark, sf_dir):
    raw = V.patients_current(spark, sf_dir).select("patient_id", "mrn", "region")
    masked = G.mask_columns(raw, "dim_patients", role="analyst")
    a = raw.select("patient_id", G.identifier_leak(raw).alias("raw_leak"))
    b = masked.select("patient_id", G.identifier_leak(masked).alias("masked_leak"))
    return a.join(b, "patient_id")
