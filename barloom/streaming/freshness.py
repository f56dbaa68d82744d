"""Latest bar per instrument, kept as state of a stream, and alerts raised by silence alone."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from barloom.schema import KEY

#: Seconds without a bar after which an instrument is silent.
SILENCE = 3 * 24 * 3600

_SEEN = T.StructType(
    [T.StructField("latest", T.TimestampType()), T.StructField("rows_seen", T.LongType())]
)
_CHANGE = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("resolution", T.StringType()),
        *_SEEN.fields,
        T.StructField("silent_since", T.TimestampType()),
    ]
)


class _Monitor(StatefulProcessor):
    """Latest bar and number of rows of one series; a timer counts the time since they came."""

    def __init__(self, silence: float):
        self.silence = int(silence * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest, n = self.seen.get() if self.seen.exists() else (None, 0)
        for part in rows:
            newest = part["event_time"].max()
            latest = newest if latest is None else max(pd.Timestamp(latest), newest)
            n += len(part)
        self.seen.update((pd.Timestamp(latest).to_pydatetime(), n))
        now = timerValues.getCurrentProcessingTimeInMs()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.silence)
        yield self._change(key, latest, n, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        latest, n = self.seen.get()
        since = expiredTimerInfo.getExpiryTimeInMs() - self.silence
        yield self._change(key, latest, n, pd.Timestamp(since, unit="ms"))

    @staticmethod
    def _change(key, latest, n, since) -> pd.DataFrame:
        columns = [*key, pd.Timestamp(latest), n, since]
        out = pd.DataFrame([columns], columns=_CHANGE.names)
        return out.astype({"latest": "datetime64[us]", "silent_since": "datetime64[us]"})

    def close(self) -> None:
        pass


def changes(bars: DataFrame, silence: float = SILENCE) -> DataFrame:
    """Stream of (series, latest, rows_seen, silent_since): one row per change of a series.

    ``silent_since`` is null where bars came, and tells since when none came
    where a timer ran out. A series that stays silent is told once. The state
    needs the session of :func:`barloom.session.stateful_session`.
    """
    seen = bars.select(KEY, "resolution", F.col("window_start").cast("timestamp").alias("event_time"))
    return seen.groupBy(KEY, "resolution").transformWithStateInPandas(
        _Monitor(silence), _CHANGE, "Update", "ProcessingTime"
    )


def record_alerts(batch: DataFrame, batch_id: int, root: str) -> None:
    """Write a batch's alerts under its id, if it has any; a replay rewrites them."""
    alerts = batch.where("silent_since IS NOT NULL")
    if not alerts.isEmpty():
        alerts.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def start_monitor(
    bars: DataFrame, alerts_root: str, checkpoint: str, silence: float = SILENCE, **trigger
) -> StreamingQuery:
    """Keep the state of every series until stopped; only alerts are written aside.

    Timers need batches without data too, so the stream never ends by itself:
    ``wait_until_drained`` tells when all that has landed is counted.
    """
    return (
        changes(bars, silence)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, i: record_alerts(batch, i, alerts_root))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def wait_until_drained(query: StreamingQuery, seconds: float = 600.0) -> None:
    """Return once a batch has found nothing new to read."""
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        if not query.isActive:
            raise query.exception() or RuntimeError("the stream was stopped")
        done = query.lastProgress
        if done is not None and done.batchId > 0 and done.numInputRows == 0:
            return
        time.sleep(0.2)
    raise TimeoutError(f"the stream still reads after {seconds} seconds")


def freshness_view(spark: SparkSession, checkpoint: str, today: str) -> DataFrame:
    """Newest bar and calendar lag per series, read from the stream's state."""
    state = (
        spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "seen")
    )
    latest = F.col("value.latest").cast("timestamp_ntz")
    return state.load().select(
        F.col(f"key.{KEY}").alias(KEY),
        F.col("key.resolution").alias("resolution"),
        latest.alias("latest"),
        F.col("value.rows_seen").alias("rows_seen"),
        F.date_diff(F.lit(today).cast("date"), F.to_date(latest)).alias("lag_days"),
    )
