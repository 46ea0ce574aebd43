"""Vital-sign scoring as Column expressions: NEWS2, range rule, rule
findings, a deviation score, and the layered verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.contracts import ALERT_BANDS, PHYSICAL_LIMITS, VITAL_ITEMS

# ---------------------------------------------------------------------------
# NEWS2 bands - (upper bound inclusive, points) ascending, and
# the points above every bound. Scored parameters in this order.
# ---------------------------------------------------------------------------
NEWS2_BANDS = {
    "resp_rate": ([(8, 3), (11, 1), (20, 0), (24, 2)], 3),
    "spo2": ([(91, 3), (93, 2), (95, 1)], 0),
    "sbp": ([(90, 3), (100, 2), (110, 1), (219, 0)], 3),
    "heart_rate": ([(40, 3), (50, 1), (90, 0), (110, 1), (130, 2)], 3),
    "temp_c": ([(35.0, 3), (36.0, 1), (38.0, 0), (39.0, 1)], 2),
}
NEWS2_ROUND = {"resp_rate": 0, "spo2": 0, "sbp": 0, "heart_rate": 0, "temp_c": 1}


def _band(value: Column, cuts, top: int) -> Column:
    expr = None
    for upper, points in cuts:
        expr = F.when(value <= upper, F.lit(points)) if expr is None else expr.when(value <= upper, F.lit(points))
    return expr.otherwise(F.lit(top))


def news2_points(cols: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Points per parameter; values rounded half-to-even first."""
    cols = cols or {k: F.col(k) for k in NEWS2_BANDS}
    return {k: _band(F.bround(cols[k].cast("double"), NEWS2_ROUND[k]), *NEWS2_BANDS[k]) for k in NEWS2_BANDS}


def news2(cols: Mapping[str, Column] | None = None) -> Column:
    """struct(score, red (parameters scoring 3, in order), risk, trigger)."""
    pts = news2_points(cols)
    score = sum(pts.values(), F.lit(0))
    red = F.array_compact(F.array(*[F.when(p == 3, F.lit(k)) for k, p in pts.items()]))
    risk = F.when(score >= 7, "high").when(score >= 5, "medium").when(F.size(red) > 0, "low-medium").otherwise("low")
    return F.struct(score.alias("score"), red.alias("red"), risk.alias("risk"), ((score >= 5) | (F.size(red) > 0)).alias("trigger"))


def range_rule(items: Sequence[str] = VITAL_ITEMS) -> Column:
    """struct(flag, n_outside): vitals outside their alert band."""
    outside = [((F.col(i) < ALERT_BANDS[i][0]) | (F.col(i) > ALERT_BANDS[i][1])).cast("int") for i in items]
    n = sum(outside, F.lit(0))
    return F.struct((n > 0).alias("flag"), n.alias("n_outside"))


def _g(c: Column) -> Column:
    """Python's ``{:g}`` for values with a short decimal form."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def rule_findings(items: Sequence[str] = VITAL_ITEMS) -> Column:
    """Impossible value, else outside the band with its side; and dbp >= sbp."""
    out = []
    for i in items:
        v = F.col(i).cast("double")
        plo, phi = PHYSICAL_LIMITS[i]
        lo, hi = ALERT_BANDS[i]
        out.append(
            F.when(
                (v < plo) | (v > phi),
                F.concat(F.lit(f"{i}="), _g(v), F.lit(f" is physically impossible (possible: {plo}-{phi})")),
            ).when(
                (v < lo) | (v > hi),
                F.concat(F.lit(f"{i}="), _g(v), F.lit(" is "), F.when(v < lo, "below").otherwise("above"), F.lit(f" the alert band {lo}-{hi}")),
            )
        )
    out.append(
        F.when(
            F.col("dbp") >= F.col("sbp"),
            F.concat(F.lit("dbp="), _g(F.col("dbp").cast("double")), F.lit(" is not below sbp="), _g(F.col("sbp").cast("double")), F.lit(" (impossible pair)")),
        )
    )
    return F.array_compact(F.array(*out))


def deviation_score(items: Sequence[str] = VITAL_ITEMS) -> Column:
    """Sum of squared deviations from each band's centre in half-band units
    (a transparent continuous score used as the model stand-in)."""
    terms = []
    for i in items:
        lo, hi = ALERT_BANDS[i]
        mid, half = (lo + hi) / 2.0, (hi - lo) / 2.0
        terms.append(F.pow((F.col(i) - mid) / half, 2))
    return sum(terms, F.lit(0.0))


def layered_verdict(rules: Column, news2_trigger: Column, model_flag: Column | None = None) -> Column:
    """Which layers fired, joined by '+', or 'none'."""
    parts = [F.when(rules, F.lit("rules")), F.when(news2_trigger, F.lit("news2"))]
    if model_flag is not None:
        parts.append(F.when(model_flag, F.lit("model")))
    joined = F.concat_ws("+", *parts)
    return F.when(joined == "", F.lit("none")).otherwise(joined)
