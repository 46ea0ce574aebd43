"""Catalog queries: operations-log analytics over an audit log and an
approvals log derived from ``events``.

Audit log: one tool call per event; request = user + hour; tool by event
type (view compute_metric, purchase query_gold_table, signup ask_genie,
click lookup_problem, error notify_and_page or restart_pipeline); lines with
id % 97 = 0 arrive truncated (malformed). Approvals: one fix request per
click/error event, status and decision delay from ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import oplog as O
from tidepool.plans import sql as S
from tidepool.plans import views as V
from tidepool.plans.registry import query

SINCE, UNTIL = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
NOW = "2024-01-20 00:00:00"
ALLOWED_AUTONOMOUS = ("restart_pipeline", "backfill_table")
TOOLS3 = ("restart_pipeline", "quarantine_table", "backfill_table")
STATUS6 = ("pending", "executed", "executed", "failed", "rejected", "expired")
OUTCOMES = ("correct", "wrong", "no_answer")


def _k():
    return F.regexp_extract("props", r"([0-9]+)", 1).cast("int")


def _tool(k):
    t = F.col("event_type")
    return (
        F.when(t == "view", "compute_metric").when(t == "purchase", "query_gold_table").when(t == "signup", "ask_genie")
        .when(t == "click", "lookup_problem").when(k % 2 == 0, "notify_and_page").otherwise("restart_pipeline")
    )


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.events(spark, sf_dir)
    k = _k()
    tool = _tool(k)
    output = (
        F.when(tool == "lookup_problem", F.concat(F.lit('{"matches": [{"id": "P'), (k % 20).cast("string"), F.lit('"}]}')))
        .when(tool == "restart_pipeline", F.lit('{"pending_approval": true}'))
        .otherwise(F.concat(F.lit('{"rows": '), k.cast("string"), F.lit("}")))
    )
    rec = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
            F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMddHH")).alias("request_id"),
            F.when(F.col("event_type").isin("click", "error"), "health").otherwise("da").alias("mode"),
            tool.alias("tool"),
            output.alias("output"),
            (k % 17 == 0).alias("is_error"),
        )
    )
    line = F.when(F.col("event_id") % 97 == 0, F.substring(rec, 1, 15)).otherwise(rec)
    return ev.select(line.alias("value"))


def audit(spark, sf_dir) -> DataFrame:
    return O.parse_audit(audit_lines(spark, sf_dir))


def approvals(spark, sf_dir) -> DataFrame:
    ev = V.events(spark, sf_dir).filter(F.col("event_type").isin("click", "error"))
    k = _k()
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS6]), (k % 6 + 1).cast("int"))
    decided = status.isin("executed", "failed", "rejected")
    return ev.select(
        F.col("event_id").alias("id"),
        F.element_at(F.array(*[F.lit(s) for s in TOOLS3]), (k % 3 + 1).cast("int")).alias("tool"),
        F.concat(F.lit('{"table": "t'), (k % 5).cast("string"), F.lit('"}')).alias("input"),
        status.alias("status"),
        F.col("ts").alias("requested_at"),
        F.when(decided, F.col("ts") + F.make_interval(mins=k + 1)).alias("decided_at"),
        F.when(decided, F.concat(F.lit("oncall_"), (k % 3).cast("string"))).alias("decided_by"),
    )


def _sql_case(values, expr):
    return S.pick_sql(values, expr)


AUD = f"""aud AS (
  SELECT event_id, event_ts AS ts, CAST(patient_id AS VARCHAR) || '-' || strftime(event_ts, '%Y%m%d%H') AS request_id,
    CASE WHEN raw_type IN ('click', 'error') THEN 'health' ELSE 'da' END AS mode,
    CASE raw_type WHEN 'view' THEN 'compute_metric' WHEN 'purchase' THEN 'query_gold_table' WHEN 'signup' THEN 'ask_genie'
      WHEN 'click' THEN 'lookup_problem' ELSE CASE WHEN k % 2 = 0 THEN 'notify_and_page' ELSE 'restart_pipeline' END END AS tool, k
  FROM ev WHERE event_id % 97 <> 0),
apr AS (
  SELECT event_id AS id, {_sql_case(TOOLS3, 'k')} AS tool, '{{"table": "t' || CAST(k % 5 AS VARCHAR) || '"}}' AS input,
    {_sql_case(STATUS6, 'k')} AS status, event_ts AS requested_at,
    CASE WHEN {_sql_case(STATUS6, 'k')} IN ('executed', 'failed', 'rejected') THEN event_ts + INTERVAL 1 MINUTE * (k + 1) END AS decided_at,
    CASE WHEN {_sql_case(STATUS6, 'k')} IN ('executed', 'failed', 'rejected') THEN 'oncall_' || CAST(k % 3 AS VARCHAR) END AS decided_by
  FROM ev WHERE raw_type IN ('click', 'error'))"""
PRE = S.with_(S.EV, AUD)


@query("audit_read", PRE + "SELECT request_id, tool, ts FROM aud")
def q_audit_read(spark, sf_dir):
    return audit(spark, sf_dir).select("request_id", "tool", "ts")


@query(
    "audit_rollup",
    PRE + f"""SELECT mode, count(*) AS requests, count(*) FILTER (WHERE escalated) AS escalations,
      count(*) FILTER (WHERE waiting) AS fixes_waiting, count(*) FILTER (WHERE escalated OR waiting) AS needed_a_person,
      count(*) FILTER (WHERE mode = 'da' AND first_tool IS NULL) AS da_without_data_tool
    FROM (SELECT request_id, arg_min(mode, struct_pack(t := ts, u := tool)) AS mode,
            bool_or(tool = 'notify_and_page') AS escalated, bool_or(tool = 'restart_pipeline') AS waiting,
            arg_min(tool, struct_pack(t := ts, u := tool)) FILTER (WHERE tool IN ('ask_genie', 'compute_metric', 'aggregate_gold_table', 'query_gold_table')) AS first_tool
          FROM aud WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY request_id) q GROUP BY mode""",
)
def q_audit_rollup(spark, sf_dir):
    return O.audit_rollup(audit(spark, sf_dir), SINCE, UNTIL)


@query(
    "audit_breakdown",
    PRE + f"""SELECT 'answer_source' AS section, coalesce(src, 'no data tool') AS name, CAST(count(*) AS DOUBLE) AS n
      FROM (SELECT request_id, arg_min(mode, (ts, tool)) AS mode,
              arg_min(tool, (ts, tool)) FILTER (WHERE tool IN ('ask_genie', 'compute_metric', 'aggregate_gold_table', 'query_gold_table')) AS src
            FROM aud WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY request_id) q WHERE mode = 'da' GROUP BY 2
    UNION ALL
    SELECT 'problem', 'P' || CAST(k % 20 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM aud
      WHERE tool = 'lookup_problem' AND ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY 2
    UNION ALL
    SELECT 'share', 'handled without a person', round(1 - avg(CASE WHEN person THEN 1 ELSE 0 END), 3)
      FROM (SELECT bool_or(tool IN ('notify_and_page', 'restart_pipeline')) AS person
            FROM aud WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY request_id) q""",
)
def q_audit_breakdown(spark, sf_dir):
    return O.audit_breakdown(audit(spark, sf_dir), SINCE, UNTIL)


@query(
    "approver_counts",
    PRE + f"""SELECT decided_by, count(*) AS n FROM apr WHERE decided_by IS NOT NULL
      AND requested_at >= TIMESTAMP '{SINCE}' AND requested_at < TIMESTAMP '{UNTIL}' GROUP BY decided_by""",
)
def q_approver_counts(spark, sf_dir):
    return O.approver_counts(approvals(spark, sf_dir), SINCE, UNTIL)


@query(
    "approval_stats",
    PRE + f"""SELECT status, count(*) AS n, count(DISTINCT decided_by) AS approvers,
      round(median(CASE WHEN decided_at IS NOT NULL AND status IN ('executed', 'failed', 'rejected')
                        THEN epoch(decided_at - requested_at) / 60.0 END), 6) AS median_decision_minutes
    FROM apr WHERE requested_at >= TIMESTAMP '{SINCE}' AND requested_at < TIMESTAMP '{UNTIL}' GROUP BY status""",
)
def q_approval_stats(spark, sf_dir):
    return O.approval_stats(approvals(spark, sf_dir), SINCE, UNTIL)


@query(
    "success_streak",
    PRE + f"""SELECT t.tool, coalesce(s.streak, 0) AS streak, coalesce(s.streak, 0) >= 10 AND t.tool IN {tuple(ALLOWED_AUTONOMOUS)} AS eligible
    FROM (SELECT DISTINCT tool FROM apr) t LEFT JOIN (
      SELECT a.tool, count(*) FILTER (WHERE f.lf IS NULL OR (a.decided_at, a.id) > f.lf) AS streak
      FROM apr a LEFT JOIN (SELECT tool, max((decided_at, id)) AS lf FROM apr WHERE status IN ('rejected', 'failed') GROUP BY tool) f USING (tool)
      WHERE a.status = 'executed' GROUP BY a.tool) s USING (tool)""",
)
def q_success_streak(spark, sf_dir):
    return O.success_streak(approvals(spark, sf_dir), ALLOWED_AUTONOMOUS)


@query(
    "page_storm",
    PRE + """SELECT ts AS evaluated_at, CAST(p AS BIGINT) AS pages, p > 5 AS alarm
    FROM (SELECT ts, sum(n) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS p
          FROM (SELECT ts, count(*) AS n FROM aud WHERE tool = 'notify_and_page' GROUP BY ts) q) r""",
)
def q_page_storm(spark, sf_dir):
    return O.page_counts(audit(spark, sf_dir), 60, 5)


_FP_SQL = "substr(sha256(array_to_string(list_sort([tool, 't' || CAST(k % 5 AS VARCHAR)]), '|')), 1, 16)"


@query("fingerprint", PRE + f"SELECT DISTINCT tool, {_FP_SQL} AS fingerprint FROM aud")
def q_fingerprint(spark, sf_dir):
    a = audit_with_k(spark, sf_dir)
    return a.select("tool", O.fingerprint([F.col("tool"), F.concat(F.lit("t"), (F.col("k") % 5).cast("string"))]).alias("fingerprint")).distinct()


def audit_with_k(spark, sf_dir) -> DataFrame:
    ev = V.events(spark, sf_dir).filter(F.col("event_id") % 97 != 0)
    k = _k()
    return ev.select(F.col("ts"), _tool(k).alias("tool"), k.alias("k"))


@query(
    "alert_cooldown",
    "WITH RECURSIVE " + S.EV[0:] + ",\n" + AUD + f""",
    al AS (SELECT {_FP_SQL} AS fingerprint, ts FROM aud WHERE tool = 'notify_and_page'),
    chain(fingerprint, ts) AS (
      SELECT fingerprint, min(ts) FROM al GROUP BY fingerprint
      UNION ALL
      SELECT c.fingerprint, (SELECT min(a.ts) FROM al a WHERE a.fingerprint = c.fingerprint AND a.ts >= c.ts + INTERVAL 24 HOUR)
      FROM chain c WHERE c.ts IS NOT NULL)
    SELECT al.fingerprint, al.ts, EXISTS (SELECT 1 FROM chain c WHERE c.fingerprint = al.fingerprint AND c.ts = al.ts) AS sent FROM al""",
)
def q_alert_cooldown(spark, sf_dir):
    a = audit_with_k(spark, sf_dir).filter(F.col("tool") == "notify_and_page")
    alerts = a.select(O.fingerprint([F.col("tool"), F.concat(F.lit("t"), (F.col("k") % 5).cast("string"))]).alias("fingerprint"), "ts")
    return O.alert_cooldown(alerts)


@query(
    "attempt_ceiling",
    PRE + """, ok AS (SELECT tool, input, requested_at AS ts, id, row_number() OVER (PARTITION BY tool, input ORDER BY requested_at, id) AS rn
                 FROM apr WHERE status = 'executed'),
      third AS (SELECT tool, input, ts AS t3, id AS i3 FROM ok WHERE rn = 3)
    SELECT a.id, a.tool, a.input, coalesce((a.requested_at, a.id) > (t.t3, t.i3), false) AS escalate
    FROM apr a LEFT JOIN third t USING (tool, input)""",
)
def q_attempt_ceiling(spark, sf_dir):
    ap = approvals(spark, sf_dir).select("id", "tool", "input", F.col("requested_at").alias("ts"), (F.col("status") == "executed").alias("success"))
    return O.attempt_ceiling(ap, ["tool", "input"]).select("id", "tool", "input", "escalate")


@query(
    "approval_expiry",
    PRE + f"""SELECT tool, input, r.id AS id,
      CASE WHEN r.status = 'pending' AND r.requested_at + INTERVAL 4 HOUR <= TIMESTAMP '{NOW}' THEN 'expired' ELSE r.status END AS status,
      r.requested_at AS requested_at
    FROM (SELECT tool, input, arg_max(struct_pack(id := id, status := status, requested_at := requested_at), struct_pack(t := requested_at, i := id)) AS r
          FROM apr WHERE requested_at <= TIMESTAMP '{NOW}' GROUP BY tool, input) q""",
)
def q_approval_expiry(spark, sf_dir):
    ap = approvals(spark, sf_dir).filter(F.col("requested_at") <= F.lit(NOW).cast("timestamp_ntz"))
    return O.approval_expiry(ap, NOW)


@query(
    "metric_samples",
    PRE + """SELECT 'events_total' AS name, 'event_type=' || raw_type AS labels, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY raw_type
    UNION ALL SELECT 'value_avg', 'event_type=' || raw_type, round(avg(value), 6) FROM ev GROUP BY raw_type
    UNION ALL SELECT 'approvals_total', 'status=' || status || ',tool=' || tool, CAST(count(*) AS DOUBLE) FROM apr GROUP BY status, tool""",
)
def q_metric_samples(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    a = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("v"))
    b = ev.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    c = approvals(spark, sf_dir).groupBy("status", "tool").agg(F.count(F.lit(1)).alias("v"))
    s = O.metric_samples([("events_total", a, ["event_type"], "v"), ("value_avg", b, ["event_type"], "v"), ("approvals_total", c, ["status", "tool"], "v")])
    # labels rendered as sorted "k=v" pairs for comparison
    labels = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return s.select("name", labels.alias("labels"), "value")


@query(
    "latency_index_pct",
    PRE + """SELECT raw_type AS event_type, count(*) AS n,
      max(value) FILTER (WHERE i = floor(n0 / 2)) AS p50,
      max(value) FILTER (WHERE i = CASE WHEN floor(0.9 * n0) - 1 < 0 THEN n0 + floor(0.9 * n0) - 1 ELSE floor(0.9 * n0) - 1 END) AS p90,
      max(value) AS max
    FROM (SELECT raw_type, value, row_number() OVER (PARTITION BY raw_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY raw_type) AS n0 FROM ev) q
    GROUP BY raw_type""",
)
def q_latency_index_pct(spark, sf_dir):
    return O.latency_index_pct(V.events(spark, sf_dir).select("event_type", "value"), "event_type", "value")


@query(
    "outcome_counts",
    PRE + "SELECT raw_type AS event_type, "
    + ", ".join(f"count(*) FILTER (WHERE k % 3 = {i}) AS {o}" for i, o in enumerate(OUTCOMES))
    + " FROM ev GROUP BY raw_type",
)
def q_outcome_counts(spark, sf_dir):
    ev = V.events(spark, sf_dir).withColumn("outcome", F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), (_k() % 3 + 1).cast("int")))
    return O.outcome_counts(ev, "event_type", "outcome", OUTCOMES)
