"""Catalog queries: vital panels, early-warning scoring and detector
evaluation.

Panels come from ``events``: one six-value panel per event by integer
arithmetic on the event id; the panel's set is the event type, ``view`` is
the stable set (label 0), every other set should be flagged (label 1).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.contracts import ALERT_BANDS, PHYSICAL_LIMITS, VITAL_ITEMS
from tidepool.operators import evaluate as E
from tidepool.functions import vitals as SC
from tidepool.plans import views as V
from tidepool.plans.registry import query
from tidepool.session import ensure_checkpoint_dir

STABLE = "view"
# panel arithmetic: item -> (base, multiplier, modulus, divisor)
PANEL_RULES = {
    "heart_rate": (40, 7919, 110, 1),
    "spo2": (85, 104729, 16, 1),
    "resp_rate": (8, 1299709, 25, 1),
    "temp_c": (34.5, 15485863, 60, 10),
    "sbp": (80, 32452843, 100, 1),
    "dbp": (45, 49979687, 70, 1),
}


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.events(spark, sf_dir).select("event_id", "event_type")
    cols = {
        item: (F.lit(float(base)) + ((F.col("event_id") * mult) % mod).cast("double") / div).alias(item)
        for item, (base, mult, mod, div) in PANEL_RULES.items()
    }
    return ev.select(
        F.col("event_id").alias("panel_id"), F.col("event_type").alias("set"),
        F.when(F.col("event_type") == STABLE, 0).otherwise(1).alias("label"), *cols.values(),
    )


PANELS_SQL = "WITH p AS (SELECT event_id AS panel_id, event_type AS set, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, " + ", ".join(
    f"{float(b)} + CAST((event_id * {m}) % {md} AS DOUBLE) / {d} AS {i}" for i, (b, m, md, d) in PANEL_RULES.items()
) + " FROM events)"


def _band_sql(col, cuts, top):
    return "CASE " + " ".join(f"WHEN {col} <= {u} THEN {p}" for u, p in cuts) + f" ELSE {top} END"


_PTS = {k: _band_sql(f"round_even({k}, {SC.NEWS2_ROUND[k]})", *SC.NEWS2_BANDS[k]) for k in SC.NEWS2_BANDS}
_SCORE = " + ".join(f"({v})" for v in _PTS.values())
_RED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN ({v}) = 3 THEN '{k}' END" for k, v in _PTS.items()) + "], lambda x: x IS NOT NULL), ',')"
_OUT = " + ".join(f"CAST(({i} < {ALERT_BANDS[i][0]} OR {i} > {ALERT_BANDS[i][1]}) AS INTEGER)" for i in VITAL_ITEMS)
_DEV = " + ".join(
    f"power(({i} - {(ALERT_BANDS[i][0] + ALERT_BANDS[i][1]) / 2.0}) / {(ALERT_BANDS[i][1] - ALERT_BANDS[i][0]) / 2.0}, 2)" for i in VITAL_ITEMS
)
SCORED_SQL = PANELS_SQL + f""",
n AS (SELECT *, {_SCORE} AS news2_score, {_RED} AS red, {_OUT} AS n_outside, {_DEV} AS dev FROM p),
s AS (SELECT panel_id, set, label, 'range_rule' AS detector, n_outside > 0 AS flag, CAST(n_outside AS DOUBLE) AS score FROM n
      UNION ALL SELECT panel_id, set, label, 'news2', news2_score >= 5 OR red <> '', CAST(news2_score AS DOUBLE) FROM n
      UNION ALL SELECT panel_id, set, label, 'deviation', dev > 6.0, dev FROM n)
"""


def scored(spark, sf_dir) -> DataFrame:
    """Long table: (panel, set, label, detector, flag, score) for the range
    rule, NEWS2 and the deviation score (flag above 6.0)."""
    p = panels(spark, sf_dir)
    n = p.select("panel_id", "set", "label", SC.news2().alias("n2"), SC.range_rule().alias("rr"), SC.deviation_score().alias("dev"))
    dets = F.array(
        F.struct(F.lit("range_rule").alias("detector"), F.col("rr.flag").alias("flag"), F.col("rr.n_outside").cast("double").alias("score")),
        F.struct(F.lit("news2").alias("detector"), F.col("n2.trigger").alias("flag"), F.col("n2.score").cast("double").alias("score")),
        F.struct(F.lit("deviation").alias("detector"), (F.col("dev") > 6.0).alias("flag"), F.col("dev").alias("score")),
    )
    return n.select("panel_id", "set", "label", F.explode(dets).alias("d")).select("panel_id", "set", "label", "d.*")


@query(
    "early_warning_score",
    PANELS_SQL + f""" SELECT panel_id, {_SCORE} AS score, {_RED} AS red,
      CASE WHEN {_SCORE} >= 7 THEN 'high' WHEN {_SCORE} >= 5 THEN 'medium' WHEN {_RED} <> '' THEN 'low-medium' ELSE 'low' END AS risk,
      ({_SCORE}) >= 5 OR {_RED} <> '' AS trigger FROM p""",
)
def q_early_warning_score(spark, sf_dir):
    n = panels(spark, sf_dir).select("panel_id", SC.news2().alias("n"))
    return n.select("panel_id", "n.score", F.array_join("n.red", ",").alias("red"), "n.risk", "n.trigger")


@query("range_rule", PANELS_SQL + f" SELECT panel_id, ({_OUT}) > 0 AS flag, {_OUT} AS n_outside FROM p")
def q_range_rule(spark, sf_dir):
    return panels(spark, sf_dir).select("panel_id", SC.range_rule().alias("r")).select("panel_id", "r.flag", "r.n_outside")


def _g_sql(c):
    return f"regexp_replace(CAST(CAST({c} AS DOUBLE) AS VARCHAR), '\\.0$', '')"


_FINDINGS = "array_to_string(list_filter([" + ", ".join(
    f"""CASE WHEN {i} < {PHYSICAL_LIMITS[i][0]} OR {i} > {PHYSICAL_LIMITS[i][1]} THEN '{i}=' || {_g_sql(i)} || ' is physically impossible (possible: {PHYSICAL_LIMITS[i][0]}-{PHYSICAL_LIMITS[i][1]})'
         WHEN {i} < {ALERT_BANDS[i][0]} OR {i} > {ALERT_BANDS[i][1]} THEN '{i}=' || {_g_sql(i)} || ' is ' || CASE WHEN {i} < {ALERT_BANDS[i][0]} THEN 'below' ELSE 'above' END || ' the alert band {ALERT_BANDS[i][0]}-{ALERT_BANDS[i][1]}' END"""
    for i in VITAL_ITEMS
) + f", CASE WHEN dbp >= sbp THEN 'dbp=' || {_g_sql('dbp')} || ' is not below sbp=' || {_g_sql('sbp')} || ' (impossible pair)' END], lambda x: x IS NOT NULL), '; ')"


@query("rule_findings", PANELS_SQL + f" SELECT panel_id, {_FINDINGS} AS findings FROM p")
def q_rule_findings(spark, sf_dir):
    return panels(spark, sf_dir).select("panel_id", F.array_join(SC.rule_findings(), "; ").alias("findings"))


@query(
    "layered_verdict",
    PANELS_SQL + f""" SELECT panel_id, CASE WHEN concat_ws('+', CASE WHEN {_FINDINGS} <> '' THEN 'rules' END,
        CASE WHEN ({_SCORE}) >= 5 OR {_RED} <> '' THEN 'news2' END, CASE WHEN ({_DEV}) > 6.0 THEN 'model' END) = '' THEN 'none'
      ELSE concat_ws('+', CASE WHEN {_FINDINGS} <> '' THEN 'rules' END, CASE WHEN ({_SCORE}) >= 5 OR {_RED} <> '' THEN 'news2' END,
        CASE WHEN ({_DEV}) > 6.0 THEN 'model' END) END AS decided_by FROM p""",
)
def q_layered_verdict(spark, sf_dir):
    p = panels(spark, sf_dir)
    v = SC.layered_verdict(F.size(SC.rule_findings()) > 0, SC.news2()["trigger"], SC.deviation_score() > 6.0)
    return p.select("panel_id", v.alias("decided_by"))


@query(
    "detector_eval",
    SCORED_SQL + """SELECT detector,
      round(CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN count(*) FILTER (WHERE flag AND label = 1) / count(*) FILTER (WHERE label = 1) END, 6) AS recall,
      round(CASE WHEN count(*) FILTER (WHERE label = 0) > 0 THEN count(*) FILTER (WHERE flag AND label = 0) / count(*) FILTER (WHERE label = 0) END, 6) AS false_positive_rate,
      round(CASE WHEN count(*) FILTER (WHERE flag) > 0 THEN count(*) FILTER (WHERE flag AND label = 1) / count(*) FILTER (WHERE flag) END, 6) AS precision
    FROM s GROUP BY detector""",
)
def q_detector_eval(spark, sf_dir):
    return E.confusion(scored(spark, sf_dir))


@query(
    "roc_auc",
    SCORED_SQL + """, r AS (SELECT detector, label, rank() OVER (PARTITION BY detector ORDER BY score) AS rk,
                         count(*) OVER (PARTITION BY detector, score) AS ties FROM s),
      a AS (SELECT detector, label, rk + (ties - 1) / 2.0 AS avg_rank FROM r)
    SELECT detector, round((sum(avg_rank) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
                          / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS roc_auc
    FROM a GROUP BY detector""",
)
def q_roc_auc(spark, sf_dir):
    return E.roc_auc(scored(spark, sf_dir))


_MATCHED_SQL = SCORED_SQL + """, tgt AS (SELECT avg(CAST(flag AS DOUBLE)) AS t FROM s WHERE detector = 'news2' AND set = 'view'),
    ranked AS (SELECT detector, score, row_number() OVER (PARTITION BY detector ORDER BY score) - 1 AS i,
                      count(*) OVER (PARTITION BY detector) AS n FROM s WHERE detector IN ('deviation', 'range_rule') AND set = 'view'),
    pos AS (SELECT DISTINCT detector, (n - 1) * (1 - (SELECT t FROM tgt)) AS h FROM ranked),
    thr AS (SELECT r.detector, min(score) FILTER (WHERE i = floor(p.h))
                   + (p.h - floor(p.h)) * (coalesce(min(score) FILTER (WHERE i = floor(p.h) + 1), min(score) FILTER (WHERE i = floor(p.h)))
                                           - min(score) FILTER (WHERE i = floor(p.h))) AS th
            FROM ranked r JOIN pos p USING (detector) GROUP BY r.detector, p.h),
    per AS (SELECT s.detector, s.set, avg(CAST(s.score > thr.th AS DOUBLE)) AS r FROM s JOIN thr USING (detector) WHERE s.label = 1 GROUP BY 1, 2),
    matched AS (SELECT thr.detector, round((SELECT t FROM tgt), 6) AS stable_false_positive_rate, round(thr.th, 6) AS score_threshold,
                round(avg(per.r), 6) AS recall FROM thr JOIN per USING (detector) GROUP BY thr.detector, thr.th)
"""


@query("matched_threshold", _MATCHED_SQL + "SELECT * FROM matched")
def q_matched_threshold(spark, sf_dir):
    return E.matched_threshold(scored(spark, sf_dir), "news2", ["deviation", "range_rule"], STABLE)


@query(
    "promote_decision",
    _MATCHED_SQL + """, nr AS (SELECT round(count(*) FILTER (WHERE flag AND label = 1) / count(*) FILTER (WHERE label = 1), 6) AS rr FROM s WHERE detector = 'news2')
    SELECT arg_max(detector, (recall, detector)) AS model, max(recall) AS model_recall, (SELECT rr FROM nr) AS reference_recall,
      max(recall) > (SELECT rr FROM nr) AS promoted,
      CASE WHEN max(recall) > (SELECT rr FROM nr) THEN 'rules + NEWS2 + ' || arg_max(detector, (recall, detector)) || ' (calibrated)'
           ELSE 'rules + NEWS2; model advisory' END AS use
    FROM matched""",
)
def q_promote_decision(spark, sf_dir):
    sc = scored(spark, sf_dir)
    ref = E.confusion(sc).filter(F.col("detector") == "news2").agg(F.first("recall")).scalar()
    return E.promote(E.matched_threshold(sc, "news2", ["deviation", "range_rule"], STABLE), ref)


@query(
    "calibrated_labels",
    _MATCHED_SQL + """, nr AS (SELECT round(count(*) FILTER (WHERE flag AND label = 1) / count(*) FILTER (WHERE label = 1), 6) AS rr FROM s WHERE detector = 'news2'),
    best AS (SELECT arg_max(detector, (recall, detector)) AS model, max(recall) > (SELECT rr FROM nr) AS promoted FROM matched),
    rec AS (SELECT model, promoted, (SELECT score_threshold FROM matched WHERE detector = model) AS th FROM best)
    SELECT s.detector, s.set, count(*) AS n, count_if(CASE WHEN promoted THEN score > th ELSE flag END) AS flagged,
      CASE WHEN promoted THEN 'calibrated' ELSE 'advisory' END AS status
    FROM s JOIN rec ON s.detector = rec.model GROUP BY s.detector, s.set, promoted""",
)
def q_calibrated_labels(spark, sf_dir):
    """Flags of the best model by a stored calibration record, used only if it
    was promoted; else the model's own flags, as advice."""
    sc = scored(spark, sf_dir)
    ref = E.confusion(sc).filter(F.col("detector") == "news2").agg(F.first("recall")).scalar()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/calibration-{uuid.uuid4().hex}"
    E.calibration_record(E.matched_threshold(sc, "news2", ["deviation", "range_rule"], STABLE), ref).write.parquet(path)
    labelled = E.calibrated(sc, spark.read.parquet(path))
    return labelled.groupBy("detector", "set", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))


@query(
    "layered_rates",
    SCORED_SQL + """SELECT set, round(avg(CAST(rr AS DOUBLE)), 6) AS range_rule, round(avg(CAST(nw AS DOUBLE)), 6) AS news2,
      round(avg(CAST(rr OR nw OR dv AS DOUBLE)), 6) AS layered
    FROM (SELECT panel_id, set, bool_or(flag) FILTER (WHERE detector = 'range_rule') AS rr, bool_or(flag) FILTER (WHERE detector = 'news2') AS nw,
                 bool_or(flag) FILTER (WHERE detector = 'deviation') AS dv FROM s GROUP BY panel_id, set) q GROUP BY set""",
)
def q_layered_rates(spark, sf_dir):
    p = panels(spark, sf_dir)
    rr, nw, dv = SC.range_rule()["flag"], SC.news2()["trigger"], SC.deviation_score() > 6.0
    return p.groupBy("set").agg(
        F.round(F.avg(rr.cast("double")), 6).alias("range_rule"),
        F.round(F.avg(nw.cast("double")), 6).alias("news2"),
        F.round(F.avg((rr | nw | dv).cast("double")), 6).alias("layered"),
    )
