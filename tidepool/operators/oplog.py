"""Operations-log analytics: audit rollups, approvals, streaks, alarms,
alert cool-down, attempt ceilings, expiry, metric samples, latency stats.

Order-dependent rules are rewritten as aggregates where possible (a streak
is "executed after the last failure"; a ceiling is "after the third
success"), so no per-key window has to hold a hot key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.quantiles import quantiles

ANALYST_TOOLS = ("ask_genie", "compute_metric", "aggregate_gold_table", "query_gold_table")
AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("approved_by", T.StringType()),
    ]
)


def parse_audit(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON-lines audit records; malformed lines and lines without ts/tool
    are skipped. ``ts`` becomes a timestamp."""
    p = lines.select(F.from_json(F.col(text_col), AUDIT_SCHEMA).alias("r")).select("r.*")
    return p.filter(F.col("ts").isNotNull() & F.col("tool").isNotNull()).withColumn(
        "ts", F.to_timestamp_ntz(F.col("ts"))
    )


def audit_rollup(audit: DataFrame, since: str, until: str) -> DataFrame:
    """Per request: first call's mode, escalated, waiting for approval, first
    analyst tool; then counts per mode with the share handled without a person."""
    w = audit.filter((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    w = w.filter(F.coalesce(F.col("mode"), F.lit("")) != "approval")
    out = F.from_json(F.col("output"), "map<string,string>")
    rank = F.struct("ts", "tool")
    per = w.groupBy(F.coalesce("request_id", F.concat(F.lit("untracked_"), F.col("ts").cast("string"))).alias("request_id")).agg(
        F.min_by(F.coalesce("mode", F.lit("unknown")), rank).alias("mode"),
        F.bool_or(F.col("tool") == "notify_and_page").alias("escalated"),
        F.bool_or(F.coalesce(out["pending_approval"] == "true", F.lit(False))).alias("waiting"),
        F.min_by("tool", F.when(F.col("tool").isin(*ANALYST_TOOLS), rank)).alias("first_analyst_tool"),
    )
    return per.groupBy("mode").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("escalated").alias("escalations"),
        F.count_if("waiting").alias("fixes_waiting"),
        F.count_if(F.col("escalated") | F.col("waiting")).alias("needed_a_person"),
        F.count_if((F.col("mode") == "da") & F.col("first_analyst_tool").isNull()).alias("da_without_data_tool"),
    )


#: Name of each safety event, and the test of a call's output that tells it
#: (fixed values of the report).
SAFETY_EVENTS = {
    "identifier requests refused": "refused",
    "results withheld (SQL outside Gold)": "withheld",
    "answers with small groups suppressed": "suppressed",
    "untrusted text wrapped": "wrapped",
}


def _truthy(out: Column, path: str) -> Column:
    """Whether a JSON value counts as yes: there, and not null, false, zero or empty."""
    text = F.try_variant_get(out, path, "string")
    return F.coalesce(~text.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def audit_breakdown(audit: DataFrame, since: str, until: str) -> DataFrame:
    """(section, name, n) of a half-open window, approval mode left out:
    ``answer_source`` - first analyst tool of each analyst request, problem ids
    looked up, and ``safety_event`` - calls whose output says so. Plus the share
    of requests handled without a person as section ``share``."""
    w = audit.filter((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
    w = w.filter(F.coalesce(F.col("mode"), F.lit("")) != "approval")
    w = w.withColumn("request", F.coalesce("request_id", F.concat(F.lit("untracked_"), F.col("ts").cast("string"))))
    w = w.withColumn("out", F.try_parse_json("output"))
    rank = F.struct("ts", "tool")
    per = w.groupBy("request").agg(
        F.min_by(F.coalesce("mode", F.lit("unknown")), rank).alias("mode"),
        F.min_by("tool", F.when(F.col("tool").isin(*ANALYST_TOOLS), rank)).alias("source"),
        F.bool_or((F.col("tool") == "notify_and_page") | _truthy(F.col("out"), "$.pending_approval")).alias("person"),
    )
    sources = per.filter("mode = 'da'").groupBy(F.coalesce("source", F.lit("no data tool")).alias("name")).count()
    problem = F.try_variant_get("out", "$.matches[0].id", "string")
    problems = w.filter(F.col("tool") == "lookup_problem").select(problem.alias("name")).filter("name IS NOT NULL").groupBy("name").count()
    tests = {
        "refused": _truthy(F.col("out"), "$.refused"),
        "withheld": _truthy(F.col("out"), "$.withheld"),
        "suppressed": _truthy(F.col("out"), "$.suppressed_groups") | _truthy(F.col("out"), "$.guardrails.suppressed_cells"),
        "wrapped": F.startswith(F.coalesce("output", F.lit("")), F.lit("<untrusted_data>")),
    }
    found = F.array_compact(F.array(*(F.when(tests[t], F.lit(name)) for name, t in SAFETY_EVENTS.items())))
    safety = w.select(F.explode(found).alias("name")).groupBy("name").count()
    share = per.agg(F.round(1 - F.avg(F.col("person").cast("int")), 3).alias("n"))
    parts = [
        df.select(F.lit(section).alias("section"), "name", F.col("count").cast("double").alias("n"))
        for section, df in (("answer_source", sources), ("problem", problems), ("safety_event", safety))
    ]
    parts.append(share.select(F.lit("share").alias("section"), F.lit("handled without a person").alias("name"), "n"))
    return reduce(DataFrame.unionByName, parts)


def approver_counts(approvals: DataFrame, since: str, until: str) -> DataFrame:
    """Decisions per person on the approvals requested in a half-open window."""
    asked = F.col("requested_at")
    w = approvals.filter((asked >= F.lit(since).cast("timestamp_ntz")) & (asked < F.lit(until).cast("timestamp_ntz")))
    return w.filter(F.coalesce("decided_by", F.lit("")) != "").groupBy("decided_by").agg(F.count("*").alias("n"))


def approval_stats(approvals: DataFrame, since: str, until: str) -> DataFrame:
    """Outcomes in a half-open window: count, approvers, median decision minutes."""
    w = approvals.filter(
        (F.col("requested_at") >= F.lit(since).cast("timestamp_ntz")) & (F.col("requested_at") < F.lit(until).cast("timestamp_ntz"))
    )
    minutes = (F.unix_micros(F.col("decided_at").cast("timestamp")) - F.unix_micros(F.col("requested_at").cast("timestamp"))) / 6e7
    decided = F.col("decided_at").isNotNull() & F.col("status").isin("executed", "failed", "rejected")
    typical = quantiles(w.withColumn("minutes", F.when(decided, minutes)), ["status"], "minutes", {"half": 0.5})
    counts = w.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("decided_by").alias("approvers"))
    return counts.join(typical, "status", "left").select("status", "n", "approvers", F.round("half", 6).alias("median_decision_minutes"))


def success_streak(approvals: DataFrame, allowed_tools: Sequence[str], needed: int = 10) -> DataFrame:
    """Per tool: consecutive most recent ``executed`` approvals; a rejected or
    failed one ends the streak, pending/expired are skipped. Streak = executed
    decisions after the tool's last failure (two aggregates, one join)."""
    rank = F.struct("decided_at", "id")
    last_fail = approvals.filter(F.col("status").isin("rejected", "failed")).groupBy("tool").agg(F.max(rank).alias("last_fail"))
    done = approvals.filter(F.col("status") == "executed").join(last_fail, "tool", "left")
    streak = done.groupBy("tool").agg(F.count_if(F.col("last_fail").isNull() | (rank > F.col("last_fail"))).alias("streak"))
    tools = approvals.select("tool").distinct().join(streak, "tool", "left").fillna(0, ["streak"])
    return tools.withColumn("eligible", (F.col("streak") >= needed) & F.col("tool").isin(*allowed_tools))


def page_counts(log: DataFrame, window_minutes: int, threshold: int, tool: str = "notify_and_page") -> DataFrame:
    """The trailing alarm at each page: pages in ``[ts - window, ts]``, alarm
    above ``threshold``. One row per page time.

    Counts per instant are dealt to time segments as long as the window; each
    segment also gets the one before it as look-back, so a running range frame
    inside a segment sees its whole window and no task holds the entire log.
    """
    window = F.lit(window_minutes * 60_000_000).cast("long")
    at = log.filter(F.col("tool") == tool).groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    at = at.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    own = F.floor(F.col("us") / window)
    dealt = at.withColumn("segment", F.explode(F.array(own, own + 1))).withColumn("own", own)
    trailing = Window.partitionBy("segment").orderBy("us").rangeBetween(-window_minutes * 60_000_000, 0)
    seen = dealt.withColumn("pages", F.sum("n").over(trailing)).filter(F.col("segment") == F.col("own"))
    return seen.select(F.col("ts").alias("evaluated_at"), "pages", (F.col("pages") > threshold).alias("alarm"))


def page_storm_at(log: DataFrame, now: str, window_minutes: int = 60, threshold: int = 5, tool: str = "notify_and_page") -> DataFrame:
    """The alarm at one instant: pages since ``now - window`` (that instant
    included) above the threshold. Pages after ``now`` are not in the log yet."""
    t = F.lit(now).cast("timestamp_ntz")
    recent = log.filter((F.col("tool") == tool) & (F.col("ts") >= t - F.expr(f"INTERVAL {window_minutes} MINUTES")) & (F.col("ts") <= t))
    return recent.agg(F.count(F.lit(1)).alias("pages")).withColumn("alarm", F.col("pages") > threshold)


def alert_cooldown(alerts: DataFrame, hours: int = 24, segment_hours: int = 24) -> DataFrame:
    """Per fingerprint, an alert is sent only when at least ``hours`` passed
    since the last *sent* one.

    The sent alerts form a chain: the first attempt, then repeatedly the first
    attempt at least ``hours`` later. Without grouping a fingerprint into one
    task: (1) every distinct (fingerprint, ts) gets its ``next`` attempt by a
    reverse-time carry-forward segmented by time (``sequence.carry_forward``);
    (2) binary lifting builds the 2^k-th successor tables by joins on the node
    key; (3) the chain from each fingerprint's first attempt is expanded by
    doubling. O(log chain) rounds of joins keyed by (fingerprint, ts);
    lineage is cut with checkpoints. Duplicate rows of one instant: only the
    first can be sent.
    """
    from tidepool.operators.sequence import carry_forward
    from tidepool.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(alerts.sparkSession)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = int(hours * 3600 * 1_000_000)
    seg = int(segment_hours * 3600 * 1_000_000)
    nodes = alerts.groupBy("fingerprint", "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("t", micros).checkpoint()

    # (1) next attempt at or after t + gap: targets and probes in one stream,
    # traversed in descending time (ascending -t); at equal time the target
    # comes first, so the carried target is the earliest one >= probe time.
    targets = nodes.select("fingerprint", F.col("t").alias("at"), F.lit(0).alias("kind"), F.col("t").alias("tgt"), F.lit(None).cast("long").alias("src"))
    probes = nodes.select("fingerprint", (F.col("t") + gap).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("tgt"), F.col("t").alias("src"))
    stream = targets.unionByName(probes).withColumns({"neg": -F.col("at"), "segment": -F.floor(F.col("at") / seg)})
    filled = carry_forward(stream, ["fingerprint"], ["neg", "kind"], ["tgt"], segment="segment")
    nxt = filled.filter("kind = 1").select("fingerprint", F.col("src").alias("t"), F.col("tgt").alias("a")).checkpoint()

    # (2) binary lifting: level k maps t -> the 2^k-th successor
    levels = [nxt]
    while levels[-1].filter(F.col("a").isNotNull()).limit(1).count() > 0:
        cur = levels[-1]
        step = cur.alias("x").join(cur.alias("y"), (F.col("x.fingerprint") == F.col("y.fingerprint")) & (F.col("x.a") == F.col("y.t")), "left")
        levels.append(step.select(F.col("x.fingerprint").alias("fingerprint"), F.col("x.t").alias("t"), F.col("y.a").alias("a")).checkpoint())

    # (3) the chain from each first attempt, doubling its covered length
    chain = nodes.groupBy("fingerprint").agg(F.min("t").alias("t"))
    for lvl in levels:
        more = chain.join(lvl, ["fingerprint", "t"]).filter(F.col("a").isNotNull()).select("fingerprint", F.col("a").alias("t"))
        chain = chain.unionByName(more).distinct().checkpoint()

    sent = chain.withColumn("sent", F.lit(True))
    flags = nodes.join(sent, ["fingerprint", "t"], "left").select("fingerprint", "ts", "n", F.coalesce("sent", F.lit(False)).alias("sent"))
    # one output row per input row; of equal rows only the first may be sent
    return flags.select(
        "fingerprint", "ts", F.posexplode(F.array_repeat(F.col("sent"), F.col("n").cast("int"))).alias("i", "s")
    ).select("fingerprint", "ts", (F.col("s") & (F.col("i") == 0)).alias("sent"))


def fingerprint(keys: Sequence[Column]) -> Column:
    """16 hex chars of SHA-256 over the sorted keys joined by '|'."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array(*keys)), "|"), 256), 1, 16)


def attempt_ceiling(attempts: DataFrame, keys: Sequence[str], limit: int = 3) -> DataFrame:
    """Mark attempts that come after the ``limit``-th successful fix of the
    same key as escalations (k-th success found by k min-aggregates)."""
    rank = F.struct("ts", "id")
    ok = attempts.filter("success").select(*keys, rank.alias("r"))
    kth = ok.groupBy(*keys).agg(F.min("r").alias("k1"))
    for i in range(2, limit + 1):
        nxt = ok.join(kth, list(keys)).filter(F.col("r") > F.col(f"k{i - 1}")).groupBy(*keys).agg(F.min("r").alias(f"k{i}"))
        kth = kth.join(nxt, list(keys), "left")
    j = attempts.join(kth.select(*keys, F.col(f"k{limit}").alias("__kth")), list(keys), "left")
    return j.withColumn("escalate", F.coalesce(rank > F.col("__kth"), F.lit(False))).drop("__kth")


def approval_expiry(requests: DataFrame, now: str, hours: int = 4) -> DataFrame:
    """Latest request per (tool, input); pending ones older than ``hours`` at
    ``now`` become expired."""
    row = F.struct("id", "status", "requested_at")
    latest = requests.groupBy("tool", "input").agg(F.max_by(row, F.struct("requested_at", "id")).alias("r")).select("tool", "input", "r.*")
    t = F.lit(now).cast("timestamp_ntz")
    expired = (F.col("status") == "pending") & (F.col("requested_at") + F.expr(f"INTERVAL {hours} HOURS") <= t)
    return latest.withColumn("status", F.when(expired, F.lit("expired")).otherwise(F.col("status")))


def metric_samples(parts: Sequence[tuple[str, DataFrame, Sequence[str], str]]) -> DataFrame:
    """Long-format samples (name, labels map, value) from several aggregates:
    each part is (metric name, frame, label columns, value column)."""
    out = None
    for name, df, labels, value in parts:
        lab = F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]) if labels else F.create_map().cast("map<string,string>")
        s = df.select(F.lit(name).alias("name"), lab.alias("labels"), F.col(value).cast("double").alias("value"))
        out = s if out is None else out.unionByName(s)
    return out


def latency_index_pct(df: DataFrame, group: str, value: str) -> DataFrame:
    """p50 = element floor(n/2), p90 = element floor(0.9 n) - 1 (0-based; -1
    wraps to the last), and max of the sorted values per group.

    Exact order statistics without sorting a group in one task: values are
    reduced to (value, count), the count of smaller values comes from a
    segmented running sum (``sequence.sum_before``) over the counts, which are
    written once, and the element at index
    i is the value whose [below, below + count) range holds i.
    """
    from tidepool.operators.sequence import range_segment, sum_before
    from tidepool.session import cut_lineage

    counts = cut_lineage(df.groupBy(group, value).agg(F.count(F.lit(1)).alias("__c")))
    seg = range_segment(counts, [group], value)
    ranked = sum_before(seg, [group], value, "__c", "__below", segment="__segment")
    n = counts.groupBy(group).agg(F.sum("__c").alias("n"))
    i50 = F.floor(F.col("n") / 2)
    i90 = F.floor(F.col("n") * 0.9) - 1
    i90 = F.when(i90 < 0, F.col("n") + i90).otherwise(i90)
    j = ranked.join(n, group)

    def holds(i):
        return (F.col("__below") <= i) & (i < F.col("__below") + F.col("__c"))

    return j.groupBy(group).agg(
        F.first("n").alias("n"),
        F.max(F.when(holds(i50), F.col(value))).alias("p50"),
        F.max(F.when(holds(i90), F.col(value))).alias("p90"),
        F.max(value).alias("max"),
    )


def outcome_counts(df: DataFrame, group: str, outcome: str, values: Sequence[str]) -> DataFrame:
    """Counts per group and outcome, one column per (fixed) outcome value."""
    return df.groupBy(group).pivot(outcome, list(values)).count().fillna(0, list(values))
