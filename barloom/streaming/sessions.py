"""Session-anchored k-minute bars over a stream of raw runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from barloom.schema import KEY, VOLUMES

SERIES = [KEY, "resolution", "session_end_date"]
_PRICES = ["open", "high", "low", "close", "settlement_price"]
#: A minute bar as the state keeps it, with what decides between two of the same minute.
_MINUTE = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in _PRICES],
        T.StructField("volume", T.LongType()),
        T.StructField("transactions", T.LongType()),
        T.StructField("dollar_volume", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("row_index", T.LongType()),
    ]
)
_SESSION = T.StructType(
    [T.StructField("minutes", T.ArrayType(_MINUTE)), T.StructField("emission", T.LongType())]
)
_OUT = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("session_end_date", T.DateType()),
        T.StructField("emission", T.LongType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in _PRICES],
        *[T.StructField(c, T.LongType()) for c in ("volume", "transactions")],
        T.StructField("dollar_volume", T.DoubleType()),
        T.StructField("candle_count", T.IntegerType()),
    ]
)
assert set(VOLUMES) <= set(_OUT.names)


class _Session(StatefulProcessor):
    """Minutes of one session of one series; all its k-minute bars follow whenever one changes."""

    def __init__(self, k_minutes: int, lateness: float):
        self.step = pd.Timedelta(minutes=k_minutes)
        self.lateness = int(lateness * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("session", _SESSION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, emission = [part[_MINUTE.names] for part in rows], 0
        if self.kept.exists():
            minutes, emission = self.kept.get()
            parts.insert(0, pd.DataFrame([tuple(m) for m in minutes], columns=_MINUTE.names))
        minutes = pd.concat([p.astype({"window_start": "datetime64[us]"}) for p in parts])
        # the last row of the last run of a minute counts
        minutes = minutes.sort_values(
            ["window_start", "ticker", "run_id", "row_index"], na_position="first", kind="stable"
        ).drop_duplicates(["window_start", "ticker"], keep="last")
        rows_kept = [
            tuple(None if pd.isna(v) else v for v in row)
            for row in minutes.astype({"window_start": object}).itertuples(index=False)
        ]
        self.kept.update((rows_kept, emission + 1))
        end = minutes["window_start"].iloc[-1] + pd.Timedelta(minutes=1)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(end.timestamp() * 1000) + self.lateness)
        yield self._bars(key, minutes, end, emission + 1)

    def _bars(self, key, minutes: pd.DataFrame, end, emission: int) -> pd.DataFrame:
        anchor = minutes["window_start"].iloc[0]
        start = anchor + (minutes["window_start"] - anchor) // self.step * self.step
        whole = minutes[start + self.step <= end]
        by = whole.groupby(start[start + self.step <= end].rename("start"), sort=True)
        out = pd.DataFrame(
            {
                "open": by["open"].first(),
                "high": by["high"].max(),
                "low": by["low"].min(),
                "close": by["close"].last(),
                "settlement_price": by["settlement_price"].nth(0).set_axis(by.size().index),
                "ticker": by["ticker"].first(),
                **{c: by[c].sum(min_count=1) for c in ("volume", "transactions", "dollar_volume")},
                "candle_count": by.size().astype("int32"),
            }
        ).reset_index(names="window_start")
        out = out.assign(emission=emission, **dict(zip(SERIES, key, strict=True)))
        for c in ("volume", "transactions"):
            out[c] = out[c].astype("Int64")
        return out[_OUT.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame(columns=_OUT.names)

    def close(self) -> None:
        pass


def session_bars(runs: DataFrame, k_minutes: int, lateness: str = "5 days") -> DataFrame:
    """Stream of the k-minute bars of every session that a batch touches, anchored at its first bar.

    A session is given out whole, under a growing ``emission``: an earlier first
    minute moves all its bars, a correction by a later run one of them. The
    state of a session is its minutes, at most a day's; an event-time timer
    clears it ``lateness`` after its last minute, and rows later than that are
    dropped. Needs the session of :func:`barloom.session.stateful_session`.
    """
    if k_minutes < 1:
        raise ValueError(f"k_minutes must be at least 1, got {k_minutes}")
    columns = [
        F.col("event_time").alias(f.name) if f.name == "window_start"
        else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in runs.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in _MINUTE.fields
    ]
    timed = runs.withColumn("event_time", F.col("window_start").cast("timestamp")).withWatermark(
        "event_time", lateness
    )
    number, unit = lateness.split()
    seconds = pd.Timedelta(int(number), unit).total_seconds()
    return (
        timed.select(*SERIES, *columns)
        .groupBy(*SERIES)
        .transformWithStateInPandas(_Session(k_minutes, seconds), _OUT, "Update", "EventTime")
    )


def start_session_bars(
    runs: DataFrame, root: str, k_minutes: int, checkpoint: str, lateness: str = "5 days", **trigger
) -> StreamingQuery:
    """Write each batch's sessions under its id; a replay rewrites them."""

    def record(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return (
        session_bars(runs, k_minutes, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def session_bars_view(spark: SparkSession, root: str) -> DataFrame:
    """The bars of each session as last given out."""
    newest = F.max("emission").over(W.partitionBy(*SERIES))
    return (
        spark.read.schema(_OUT).parquet(root)
        .withColumn("_newest", newest).where("emission = _newest").drop("_newest", "emission")
        .withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    )
