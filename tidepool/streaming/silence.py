"""Silence alerts on a stream: keyed state with event-time timers.

An alert has to fire when nothing arrives, so each source keeps a timer at its
last event plus the limit. The events of a source are first reduced to the
earliest and latest of each slot of time, a tenth of the limit (a windowed
aggregate, combined before the shuffle), so a source with very many events costs
the state machine one row a slot. State is one entry for each slot whose timer
is open. A slot is known when the watermark has passed its end, so an alert comes
out with the end of the slot in which it falls due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERTS = "source string, silent_since timestamp, alert_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slot_s(limit_s: int) -> int:
    return max(1, limit_s // 10)


class Watchdog(StatefulProcessor):
    """Per source: slots (latest event -> earliest event) not yet judged.

    A timer stands at the end of the slot that holds latest + limit. When it
    goes off, every event up to there has come: if no slot's events begin after
    ``latest`` and by then, the source is silent."""

    def __init__(self, limit_s: int):
        self.limit, self.slot = limit_s * 1_000_000, slot_s(limit_s) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "latest long", "earliest long")

    def _timer(self, latest: int) -> int:
        return ((latest + self.limit) // self.slot + 1) * self.slot // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for earliest, latest in zip(pdf["earliest"].tolist(), pdf["latest"].tolist()):
                self.open.updateValue((latest,), (earliest,))
                self.handle.registerTimer(self._timer(latest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries = sorted((k[0], v[0]) for k, v in self.open.iterator())
        for at, (latest, _) in enumerate(entries):
            if self._timer(latest) != expiredTimerInfo.getExpiryTimeInMs():
                continue
            due = latest + self.limit
            self.open.removeKey((latest,))
            if not any(latest < earliest <= due for _, earliest in entries[at + 1 :]):
                yield pd.DataFrame({"source": [key[0]], "silent_since": pd.to_datetime([latest], unit="us"), "alert_at": pd.to_datetime([due], unit="us")})

    def close(self) -> None:
        pass


def silence_alerts(events: DataFrame, key: str, ts: str, limit_s: int, watermark: str) -> DataFrame:
    """Alerts (``ALERTS``) for sources that sent nothing for ``limit_s`` seconds;
    each falls due ``limit_s`` after the source's last event and comes out once
    the watermark, moved on by the other sources, has passed that slot. Late rows
    (behind the watermark) do not count. The session's state store must be
    RocksDB (``ROCKS``), which keeps maps and timers."""
    at = F.unix_micros(ts)
    per = (
        events.withWatermark(ts, watermark)
        .groupBy(F.window(ts, f"{slot_s(limit_s)} seconds").alias("slot"), F.col(key).cast("string").alias("source"))
        .agg(F.min(at).alias("earliest"), F.max(at).alias("latest"))
        .select(F.window_time("slot").alias("slot_time"), "source", "earliest", "latest")
    )
    return per.groupBy("source").transformWithStateInPandas(
        statefulProcessor=Watchdog(limit_s), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime"
    )
