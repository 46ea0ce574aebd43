"""Detector evaluation and result reconciliation as aggregates.

Inputs are long tables: one row per (panel, detector) with ``set``,
``label`` (1 = should flag), ``flag`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.quantiles import quantiles


def flag_rates(scored: DataFrame) -> DataFrame:
    return scored.groupBy("set", "detector").agg(F.round(F.avg(F.col("flag").cast("double")), 6).alias("flag_rate"))


def confusion(scored: DataFrame) -> DataFrame:
    """Per detector: recall, false-positive rate and precision (NULL when
    the denominator is zero)."""
    f, y = F.col("flag"), F.col("label") == 1
    c = scored.groupBy("detector").agg(
        F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"),
        F.count_if(~f & y).alias("fn"), F.count_if(~f & ~y).alias("tn"),
    )

    def ratio(a, b):
        return F.round(F.when(b > 0, a / b), 6)

    return c.select(
        "detector",
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """ROC AUC per detector in rank-sum form with average ranks for ties.

    Rows are first reduced to (detector, score) counts of positives and
    negatives - one row per distinct score - so the ordered pass runs over
    distinct scores only, split into score-range segments (``sum_before``).
    AUC = P(s+ > s-) + 0.5 P(s+ = s-).
    """
    from tidepool.operators.sequence import range_segment, sum_before
    from tidepool.session import cut_lineage

    y = F.col("label") == 1
    per = cut_lineage(scored.groupBy("detector", "score").agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    # negatives below each distinct score: a running sum split by score range
    per = range_segment(per, ["detector"], "score")
    below = sum_before(per, ["detector"], "score", "neg", "neg_below", segment="__segment")
    return below.groupBy("detector").agg(
        F.round(
            (F.sum(F.col("pos") * F.col("neg_below")) + 0.5 * F.sum(F.col("pos") * F.col("neg"))) / (F.sum("pos") * F.sum("neg")),
            6,
        ).alias("roc_auc")
    )


def matched_threshold(scored: DataFrame, reference: str, models: Sequence[str], stable_set: str) -> DataFrame:
    """For each model: threshold = quantile(stable scores, 1 - reference's
    stable flag rate) (linear interpolation); recall per positive set = share
    with score > threshold; reported recall = mean over positive sets.

    The reference rate is a scalar subquery, so no job runs while planning.
    """
    of_reference = scored.filter((F.col("detector") == reference) & (F.col("set") == stable_set))
    rate = of_reference.agg(F.avg(F.col("flag").cast("double")).alias("t"))
    m = scored.filter(F.col("detector").isin(*models))
    stable = m.filter(F.col("set") == stable_set).withColumn("rate", rate.scalar())
    thr = quantiles(stable, ["detector"], "score", {"score_threshold": 1 - F.col("rate")})
    per_set = (
        m.filter(F.col("label") == 1)
        .join(thr, "detector")
        .groupBy("detector", "set")
        .agg(F.avg((F.col("score") > F.col("score_threshold")).cast("double")).alias("r"))
    )
    rec = per_set.groupBy("detector").agg(F.round(F.avg("r"), 6).alias("recall"))
    return thr.join(rec, "detector").select(
        "detector", F.round(rate.scalar(), 6).alias("stable_false_positive_rate"),
        F.round("score_threshold", 6).alias("score_threshold"), "recall",
    )


def promote(matched: DataFrame, reference_recall: float | Column) -> DataFrame:
    """Best model by matched recall; promoted when it beats the reference's
    recall (a value or a scalar subquery of ``confusion``)."""
    reference_recall = reference_recall if isinstance(reference_recall, Column) else F.lit(reference_recall)
    best = matched.agg(F.max_by("detector", F.struct("recall", "detector")).alias("model"), F.max("recall").alias("model_recall"))
    promoted = F.col("model_recall") > reference_recall
    return best.select(
        "model", "model_recall", reference_recall.alias("reference_recall"), promoted.alias("promoted"),
        F.when(promoted, F.concat(F.lit("rules + NEWS2 + "), F.col("model"), F.lit(" (calibrated)"))).otherwise(
            F.lit("rules + NEWS2; model advisory")
        ).alias("use"),
    )


def calibration_record(matched: DataFrame, reference_recall: float | Column) -> DataFrame:
    """One row to be stored with the model: the best model, its threshold, the
    recalls and whether it was promoted."""
    best = promote(matched, reference_recall).select("model", "model_recall", "reference_recall", "promoted")
    return best.join(matched.select(F.col("detector").alias("model"), "score_threshold"), "model")


def calibrated(scored: DataFrame, record: DataFrame) -> DataFrame:
    """The record's model's scores with ``flagged`` and ``status``. The threshold
    counts only if the record was promoted (``calibrated``); without, or without
    any record's promotion, the model's own flag is shown as advice."""
    model = record.agg(F.first("model")).scalar()
    threshold = record.filter("promoted").agg(F.first("score_threshold")).scalar()
    own = scored.filter(F.col("detector") == model)
    return own.withColumns(
        {
            "flagged": F.coalesce(F.col("score") > threshold, F.col("flag")),
            "status": F.when(threshold.isNotNull(), "calibrated").otherwise("advisory"),
        }
    )


def threshold_at(scored: DataFrame, detector: str, stable_set: str, fpr: float) -> DataFrame:
    """Quantile of a detector's stable scores at 1 - fpr (one value)."""
    s = scored.filter((F.col("detector") == detector) & (F.col("set") == stable_set))
    return quantiles(s, [], "score", {"score_threshold": 1 - fpr})


def recall_above(scored: DataFrame, detector: str, threshold: float) -> DataFrame:
    """Per positive set: share of scores above the threshold; and the mean."""
    s = scored.filter((F.col("detector") == detector) & (F.col("label") == 1))
    return s.groupBy("set").agg(F.round(F.avg((F.col("score") > threshold).cast("double")), 6).alias("recall"))


def reconcile(truth: DataFrame, answer: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Compare two grouped results both ways: per key ``correct`` (within
    tolerance), ``wrong``, ``no_answer`` (missing in the answer) or
    ``unexpected`` (only in the answer)."""
    t = truth.select(*keys, F.col("value").alias("truth"))
    a = answer.select(*keys, F.col("value").alias("answer"))
    j = t.join(a, list(keys), "full_outer")
    status = (
        F.when(F.col("answer").isNull() & F.col("truth").isNotNull(), "no_answer")
        .when(F.col("truth").isNull() & F.col("answer").isNotNull(), "unexpected")
        .when(F.abs(F.col("truth") - F.col("answer")) <= tolerance, "correct")
        .otherwise("wrong")
    )
    return j.withColumn("status", status)
