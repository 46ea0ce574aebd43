"""Data-quality expectations: warn / drop / fail, with recorded counts.

An expectation *passes* only when its condition is TRUE; NULL is a violation.
Counts are gathered in the same pass as the data (``Observation``) or with one
aggregate over the input (``expectation_metrics``) - never by re-reading rows
on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

WARN, DROP, FAIL = "warn", "drop", "fail"


@dataclass(frozen=True)
class Expectation:
    name: str
    condition: str  # SQL boolean over the dataset's columns
    action: str = WARN

    def passed(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False))


def expectation_metrics(df: DataFrame, dataset: str, expectations: Sequence[Expectation]) -> DataFrame:
    """One aggregate over ``df``: (dataset, expectation, action, passed, failed)."""
    aggs = []
    for e in expectations:
        aggs += [F.count_if(e.passed()).alias(f"p_{e.name}"), F.count_if(~e.passed()).alias(f"f_{e.name}")]
    wide = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(e.name).alias("expectation"),
                    F.lit(e.action).alias("action"),
                    F.col(f"p_{e.name}").alias("passed"),
                    F.col(f"f_{e.name}").alias("failed"),
                )
                for e in expectations
            ]
        )
    )
    return wide.select(F.lit(dataset).alias("dataset"), rows.alias("m")).select("dataset", "m.*")


def observe(df: DataFrame, name: str, expectations: Sequence[Expectation]) -> tuple[DataFrame, Observation]:
    """Attach pass/fail counters to ``df``; read ``obs.get`` after an action."""
    obs = Observation(name)
    aggs = []
    for e in expectations:
        aggs += [F.count_if(e.passed()).alias(f"{e.name}.passed"), F.count_if(~e.passed()).alias(f"{e.name}.failed")]
    return df.observe(obs, *aggs), obs


def expect_drop(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """Keep a row only when every drop expectation is TRUE."""
    cond = F.lit(True)
    for e in expectations:
        if e.action == DROP:
            cond = cond & e.passed()
    return df.filter(cond)


def expect_fail(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """Fail the whole query if any row violates a fail expectation.

    The check is a pass of its own over ``df`` as it comes in: a scalar subquery
    that raises, so filters, limits or pruning further down neither reach its
    scan nor skip it. A stream has no subqueries; there the check is an observed
    metric, and no filter is moved below an observation."""
    failing_rules = [e for e in expectations if e.action == FAIL]
    if not failing_rules:
        return df
    raised = [
        F.max(F.when(~e.passed(), F.raise_error(F.lit(f"expectation {e.name} violated: {e.condition}")).cast("string"))).alias(e.name)
        for e in failing_rules
    ]
    if df.isStreaming:
        return df.observe("hard_stop_" + "_".join(e.name for e in failing_rules), *raised)
    stop = df.agg(*raised).select(F.concat_ws("", *[F.col(e.name) for e in failing_rules]).alias("stop"))
    return df.filter(stop.scalar() == "")


def apply_expectations(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """Warn (no effect on rows), then fail checks on the unfiltered input,
    then drop - the hard stop must see every row."""
    return expect_drop(expect_fail(df, expectations), expectations)


def latest_run_summary(metrics_log: DataFrame, run_col: str = "run_id", ts_col: str = "run_ts") -> DataFrame:
    """Passed/failed per (dataset, expectation) for the latest run only: a
    semi-join to the single newest run id (``max_by`` over the run log)."""
    latest = metrics_log.agg(F.max_by(run_col, ts_col).alias(run_col))
    return (
        metrics_log.join(latest, run_col, "left_semi")
        .groupBy("dataset", "expectation")
        .agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))
    )


def failing(summary: DataFrame) -> DataFrame:
    """Expectations with failed > 0, sorted by (dataset, expectation)."""
    return summary.filter(F.col("failed") > 0).orderBy("dataset", "expectation")
