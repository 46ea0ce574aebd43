"""Structured Streaming runners that reuse the batch transformations.

Only the source and the sink differ from batch: every runner takes a
streaming DataFrame, applies the same operator functions, and writes with a
checkpoint (exactly-once file sinks, restartable after executor or driver
loss). ``Trigger.AvailableNow`` processes what has landed and stops.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from tidepool.contracts import ALERT_BANDS, ENCOUNTER_WATERMARK, EVENT_SCHEMA, VITALS_WATERMARK, contract_keys
from tidepool.operators import bronze, cdc, expectations, live, oplog
from tidepool.plans.views import HISTORY_COLUMNS, cdc_flatten, vitals_project
from tidepool.session import cut_lineage
from tidepool.sources.events import parse_permissive, rescue_unknown_fields


def bronze_stream(raw: DataFrame) -> DataFrame:
    """Raw lines -> parsed, rescued, flattened Bronze rows (never drops).
    Event time is cast to TIMESTAMP (watermarks need it)."""
    parsed = rescue_unknown_fields(parse_permissive(raw, keep_raw=True), contract_keys(EVENT_SCHEMA))
    out = bronze.bronze_flatten(parsed)
    return out.withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def gated(bronze_df: DataFrame, gate: Sequence[expectations.Expectation]) -> DataFrame:
    """The contract gate: the hard stop sees every row, then drop rules."""
    return expectations.apply_expectations(bronze_df, gate)


def vitals_stream(events: DataFrame, rules: Sequence[expectations.Expectation], watermark: str = VITALS_WATERMARK) -> DataFrame:
    """Vitals: watermark, de-duplicate by event id within the watermark,
    project, then drop implausible values."""
    v = (
        events.filter(F.col("event_type") == "vitals_reading")
        .withWatermark("event_ts", watermark)
        .dropDuplicatesWithinWatermark(["event_id"])
    )
    return expectations.apply_expectations(vitals_project(v), rules)


def live_rollup_stream(vitals: DataFrame, unit_col: str = "unit", watermark: str = VITALS_WATERMARK) -> DataFrame:
    """Windowed rollup in update mode: the current window stays visible
    while it fills; rows past the watermark are dropped and counted."""
    v = vitals if vitals.isStreaming is False else vitals.withWatermark("event_ts", watermark)
    return live.window_rollup(v, "event_ts", [unit_col], "value", ALERT_BANDS["heart_rate"], avg_alias="avg_heart_rate")


def start_append(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    w = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.start()


class LateRows(StreamingQueryListener):
    """Adds up the rows that stateful operators drop as too late, query by
    query, over every progress report (a query itself keeps only the last few).

    ``with LateRows(spark) as late: ...; late.total(q)``
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, {}

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        # A batch may be reported again without new rows: its last report counts.
        self.seen[str(p.runId), p.batchId] = max(
            self.seen.get((str(p.runId), p.batchId), 0), sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, q: StreamingQuery) -> int:
        """Late rows of one run of a query, once its reports have come in."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(n for (run, _), n in self.seen.items() if run == str(q.runId))


# ---------------------------------------------------------------------------
# Streaming SCD: re-derive touched keys from the retained change log
# ---------------------------------------------------------------------------
class ScdMerger:
    """``foreachBatch`` sink keeping SCD1 and SCD2 tables equal to the batch
    result for any arrival order.

    Each micro-batch is appended to the change log, which is partitioned by
    bucket (a hash of the key) and batch id, so a replayed batch overwrites
    itself. The buckets it touched - and no other part of the log - are read
    again, and their partitions of the target tables are rewritten. Late,
    out-of-order changes are therefore inserted into history, not appended.
    ``buckets`` sets how much of the log a key shares a partition with.
    """

    def __init__(self, root: str, key: str = "encounter_id", sequence: str = "event_ts", tiebreak: str = "event_id",
                 columns: Sequence[str] = tuple(HISTORY_COLUMNS), buckets: int = 16):
        self.root, self.key, self.seq, self.tie = root, key, sequence, tiebreak
        self.columns, self.buckets = list(columns), buckets
        self.log = os.path.join(root, "change_log")
        self.scd1 = os.path.join(root, "scd1")
        self.scd2 = os.path.join(root, "scd2")

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.hash(F.col(self.key)), F.lit(self.buckets)))

    def _replace(self, df: DataFrame, path: str, *partitions: str) -> None:
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket", *partitions).parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = [self.key, self.seq, self.tie, *[c for c in self.columns if c not in (self.key,)]]
        changes = self._bucket(batch.select(*cols)).withColumn("batch_id", F.lit(batch_id)).persist()
        self._replace(changes, self.log, "batch_id")
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most ``buckets``
        changes.unpersist()
        log = spark.read.parquet(self.log).filter(F.col("bucket").isin(touched))
        s1 = cdc.scd1_partial(log, [self.key], self.seq, self.columns, self.tie)
        s2 = cdc.scd2_history(log, [self.key], self.seq, self.columns, self.tie, "valid_from", "valid_to")
        self._replace(self._bucket(s1), self.scd1)
        self._replace(self._bucket(s2), self.scd2)

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encounter_changes(events: DataFrame, watermark: str = ENCOUNTER_WATERMARK) -> DataFrame:
    return cdc_flatten(events.withWatermark("event_ts", watermark))


# ---------------------------------------------------------------------------
# Alert cool-down as a stateful stream
# ---------------------------------------------------------------------------
COOLDOWN_OUT = "fingerprint string, ts timestamp, sent boolean"
COOLDOWN_STATE = "last_sent timestamp"


class CooldownMerger:
    """The alert cool-down as a ``foreachBatch`` sink, without a group per
    fingerprint: the chain of a micro-batch is found by the joins of
    ``oplog.alert_cooldown``, so a fingerprint with most of the alerts is spread
    over tasks, and the last alert sent before begins its chain.

    State is a table of the last sent alert of each fingerprint, written anew for
    each batch; an entry goes once no alert up to ``delay_hours`` late can fall
    into its cool-down. A replayed batch reads the state before it and overwrites
    its own results. Alerts before the last sent one (late) are not sent.
    """

    def __init__(self, root: str, hours: int = 24, delay_hours: int = 24):
        self.hours, self.delay = hours, delay_hours
        self.out, self.state = os.path.join(root, "alerts"), os.path.join(root, "last_sent")

    def _before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """fingerprint and last_sent as the batch before left them."""
        schema = "fingerprint string, last_sent timestamp, batch_id int"
        try:
            table = spark.read.schema(schema).parquet(self.state).filter(F.col("batch_id") < batch_id)
        except AnalysisException:  # the first batch
            return spark.createDataFrame([], schema).drop("batch_id")
        newest = table.agg(F.max("batch_id")).scalar()
        return table.filter(F.col("batch_id") == newest).drop("batch_id")

    def _write(self, df: DataFrame, path: str, batch_id: int) -> None:
        out = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("batch_id").parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = cut_lineage(self._before(spark, batch_id))
        rows = batch.select("fingerprint", F.col("ts").cast("timestamp").alias("ts")).join(before, "fingerprint", "left")
        rows = cut_lineage(rows)
        late = rows.filter(F.col("ts") < F.col("last_sent")).select("fingerprint", "ts", F.lit(False).alias("sent"))
        ahead = rows.filter(F.col("last_sent").isNull() | (F.col("ts") >= F.col("last_sent")))
        seeds = before.join(ahead.select("fingerprint").distinct(), "fingerprint", "left_semi").select("fingerprint", F.col("last_sent").alias("ts"))
        judged = oplog.alert_cooldown(seeds.unionByName(ahead.select("fingerprint", "ts")), self.hours)
        judged = cut_lineage(judged.join(before, "fingerprint", "left"))
        seed = F.col("sent") & F.col("ts").eqNullSafe(F.col("last_sent"))  # sent by an earlier batch
        self._write(judged.filter(~seed).select("fingerprint", "ts", "sent").unionByName(late), self.out, batch_id)
        sent = judged.filter("sent").select("fingerprint", F.col("ts").alias("last_sent"))
        last = before.unionByName(sent).groupBy("fingerprint").agg(F.max("last_sent").alias("last_sent"))
        newest = before.select(F.col("last_sent").alias("t")).unionByName(rows.select(F.col("ts").alias("t"))).agg(F.max("t")).scalar()
        self._write(last.filter(F.col("last_sent") > newest - F.make_dt_interval(hours=F.lit(self.hours + self.delay))), self.state, batch_id)

    def start(self, alerts: DataFrame, checkpoint: str) -> StreamingQuery:
        return alerts.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_cooldown_stream(alerts: DataFrame, hours: int = 24) -> DataFrame:
    """Per fingerprint, state = time of the last sent alert; an alert is sent
    when ``hours`` have passed since it. One row of state per fingerprint, whose
    alerts of a micro-batch meet in one task; ``CooldownMerger`` spreads them."""
    gap = pd.Timedelta(hours=hours)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        last = pd.Timestamp(last) if last is not None else None
        # A large group arrives in several chunks; only all of them have an order.
        pdf = pd.concat(list(pdfs)).sort_values("ts", kind="mergesort")
        sent = []
        for t in map(pd.Timestamp, pdf["ts"]):
            sent.append(last is None or t - last >= gap)
            if sent[-1]:
                last = t
        yield pd.DataFrame({"fingerprint": pdf["fingerprint"].to_numpy(), "ts": pdf["ts"].to_numpy(), "sent": sent})
        if last is not None:
            state.update((last.to_pydatetime(),))

    return alerts.groupBy("fingerprint").applyInPandasWithState(
        step, COOLDOWN_OUT, COOLDOWN_STATE, "append", GroupStateTimeout.NoTimeout
    )
