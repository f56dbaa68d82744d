import os
import time

import pytest
from pyspark.sql import functions as F

from barloom.operators.merge import merge_runs
from barloom.operators.resample import resample_minutes
from barloom.session import scratch_path, stateful_session
from barloom.sources import store
from barloom.streaming.bars import tumbling_bars
from barloom.streaming.freshness import freshness_view, start_monitor, wait_until_drained
from barloom.streaming.merge import landed_runs, merge_batch, start_bars, start_merge
from barloom.streaming.sessions import session_bars_view, start_session_bars


@pytest.fixture()
def landed(spark, make_bars, minutes):
    root = scratch_path(spark, "raw")
    first = make_bars(minutes("2025-05-31 23:50", 20)).unionByName(
        make_bars(minutes("2025-05-31 23:50", 20), symbol="BBB")
    )
    store.save_run(first, root, "20250601T000000")
    again = make_bars(minutes("2025-06-01 00:05", 10, 500.0))
    store.save_run(again, root, "20250602T000000")
    return root


def _rows(df):
    columns = ["instrument_key", "window_start", "ticker", "open", "volume", "run_id"]
    return sorted(tuple(r) for r in df.select(columns).collect())


def test_stream_merge_equals_batch_merge(spark, landed):
    bars, checkpoint = scratch_path(spark, "bars"), scratch_path(spark, "checkpoint")
    start_merge(landed_runs(spark, landed, 1), bars, checkpoint).awaitTermination()
    batch = merge_runs(store.read_runs(spark, landed))
    assert _rows(store.read_bars(spark, bars)) == _rows(batch)


def test_later_landing_continues_and_a_replay_changes_nothing(spark, landed, make_bars):
    bars, checkpoint = scratch_path(spark, "bars"), scratch_path(spark, "checkpoint")
    start_merge(landed_runs(spark, landed), bars, checkpoint).awaitTermination()
    late = make_bars([("2025-05-31 23:50", 9), ("2025-07-01 00:00", 9)])
    store.save_run(late, landed, "20250701T000000")
    start_merge(landed_runs(spark, landed), bars, checkpoint).awaitTermination()
    expected = _rows(merge_runs(store.read_runs(spark, landed)))
    assert _rows(store.read_bars(spark, bars)) == expected
    merge_batch(store.read_runs(spark, landed).drop("row_index"), bars)
    assert _rows(store.read_bars(spark, bars)) == expected


def test_repeats_inside_a_run_and_corrections_reach_the_stream(spark, make_bars):
    root, bars = scratch_path(spark, "raw"), scratch_path(spark, "bars")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    times = [f"2025-06-02 09:{m:02d}" for m in range(20)]
    store.save_run(make_bars([(t, p) for p in (1, 2, 3) for t in times]), root, "20250601T000000")
    store.save_run(make_bars([(times[4], 50)]), root, "20250602T000000")
    start_bars(landed_runs(spark, root, 1), bars, out, 5, checkpoint).awaitTermination()
    batch = merge_runs(store.read_runs(spark, root))
    assert _rows(store.read_bars(spark, bars)) == _rows(batch)
    assert {r.open for r in batch.collect()} == {3.0, 50.0}
    closes = {r.window_start.minute: (r.close, r.candle_count) for r in spark.read.parquet(out).collect()}
    assert closes == {0: (50.5, 5), 5: (3.5, 5), 10: (3.5, 5), 15: (3.5, 5)}


def test_a_run_is_stored_once_and_pruned_by_its_id(spark, landed, make_bars):
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.save_run(make_bars([("2025-06-01 10:00", 1)]), landed, "20250601T000000")
    one = store.read_runs(spark, landed).filter("run_id = '20250602T000000'")
    assert "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().toString()
    assert one.count() == 10


def test_files_do_not_grow_with_symbols(spark, make_bars):
    root = scratch_path(spark, "raw")
    many = make_bars([("2025-06-01 10:00", 1)])
    for i in range(40):
        many = many.unionByName(make_bars([("2025-06-01 10:00", i), ("2025-06-01 10:01", i)], symbol=f"S{i}"))
    store.save_run(many, root, "20250601T000000")
    assert len(spark.read.parquet(root).inputFiles()) <= 8


def test_errors_other_than_a_missing_table_do_not_replace_it(spark, landed, tmp_path):
    spoiled = tmp_path / "bars" / "_manifest"
    spoiled.mkdir(parents=True)
    (spoiled / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        merge_batch(store.read_runs(spark, landed), str(tmp_path / "bars"))
    assert (spoiled / "part-0.parquet").read_text() == "no parquet"


def test_tumbling_bars_stream_equals_batch_on_closed_windows(spark, landed):
    bars = scratch_path(spark, "bars")
    store.write_bars(merge_runs(store.read_runs(spark, landed)), bars)
    stream = spark.readStream.schema(store.STORED).parquet(bars).withColumn(
        "instrument_key", F.concat_ws(":", "instrument_type", "symbol")
    )
    sink = scratch_path(spark, "sink")
    (
        tumbling_bars(stream, 5, overlap="3 minutes")
        .writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    columns = ["instrument_key", "window_start", "open", "high", "low", "close", "candle_count",
               "volume"]
    got = sorted(tuple(r) for r in spark.read.parquet(sink).select(columns).collect())
    batch = tumbling_bars(store.read_bars(spark, bars), 5).filter(
        "window_start < TIMESTAMP_NTZ '2025-06-01 00:10:00'"
    )
    assert got == sorted(tuple(r) for r in batch.select(columns).collect())
    assert len(got) == 8


def test_freshness_is_read_from_state(spark, landed):
    own, checkpoint = stateful_session(spark), scratch_path(spark, "checkpoint")
    alerts = scratch_path(spark, "alerts")
    monitor = start_monitor(
        landed_runs(own, landed, 1), alerts, checkpoint, processingTime="1 second"
    )
    try:
        wait_until_drained(monitor)
    finally:
        monitor.stop()
    out = {r.instrument_key: (str(r.latest), r.rows_seen, r.lag_days)
           for r in freshness_view(own, checkpoint, "2025-06-04").collect()}
    assert out == {"stocks:AAA": ("2025-06-01 00:14:00", 30, 3),
                   "stocks:BBB": ("2025-06-01 00:09:00", 20, 3)}
    assert not os.path.exists(alerts)


def test_silence_alone_raises_an_alert(spark, landed):
    own, checkpoint = stateful_session(spark), scratch_path(spark, "checkpoint")
    alerts = scratch_path(spark, "alerts")
    monitor = start_monitor(
        landed_runs(own, landed), alerts, checkpoint, 2, processingTime="1 second"
    )
    try:
        wait_until_drained(monitor)
        until = time.monotonic() + 90
        told = []
        while time.monotonic() < until and len(told) < 2:
            time.sleep(1)
            if os.path.exists(alerts):
                told = spark.read.parquet(alerts).collect()
    finally:
        monitor.stop()
    assert {(r.instrument_key, r.rows_seen) for r in told} == {("stocks:AAA", 30), ("stocks:BBB", 20)}
    assert all(r.silent_since is not None for r in told)


def test_session_bars_follow_late_and_corrected_minutes(spark, make_bars):
    root, out = scratch_path(spark, "raw"), scratch_path(spark, "sessions")
    times = [f"2025-06-02 09:{m:02d}" for m in range(12, 40)]
    store.save_run(make_bars([(t, 1) for t in times]), root, "20250602T000000")
    store.save_run(make_bars([(times[3], 70)]), root, "20250603T000000")
    # an earlier first minute moves the grid of the session
    store.save_run(make_bars([("2025-06-02 09:10", 5)]), root, "20250604T000000")
    store.save_run(make_bars([(times[3], 60)]), root, "20250601T000000")
    checkpoint = scratch_path(spark, "checkpoint")
    runs = landed_runs(stateful_session(spark), root, 1)
    start_session_bars(runs, out, 10, checkpoint).awaitTermination()
    got = session_bars_view(spark, out).orderBy("window_start")
    columns = ["window_start", "open", "high", "close", "candle_count", "volume"]
    batch = resample_minutes(merge_runs(store.read_runs(spark, root)), 10).orderBy("window_start")
    assert got.select(columns).collect() == batch.select(columns).collect()
    first = got.first()
    assert (str(first.window_start), first.open, first.high) == ("2025-06-02 09:10:00", 5.0, 71.0)
    assert spark.read.parquet(out).select("emission").distinct().count() == 4


def test_session_bars_forget_ended_sessions(spark, make_bars):
    root, out = scratch_path(spark, "raw"), scratch_path(spark, "sessions")
    times = [f"2025-06-02 09:{m:02d}" for m in range(20)]
    store.save_run(make_bars([(t, 1) for t in times]), root, "20250602T000000")
    checkpoint = scratch_path(spark, "checkpoint")
    own = stateful_session(spark)
    for run_id, moment in (("20250620T000000", "2025-06-20 09:00"), ("20250621T000000", times[5])):
        start_session_bars(landed_runs(own, root), out, 10, checkpoint).awaitTermination()
        store.save_run(make_bars([(moment, 9)]), root, run_id)
    start_session_bars(landed_runs(own, root), out, 10, checkpoint).awaitTermination()
    state = own.read.format("statestore").option("path", checkpoint)
    kept = state.option("stateVarName", "session").load().select("key.session_end_date").collect()
    assert [str(r[0]) for r in kept] == ["2025-06-20"]
    # a correction after the end of a session's lateness is dropped
    bars = session_bars_view(spark, out).where("session_end_date = '2025-06-02'").collect()
    assert sorted(r.close for r in bars) == [1.5, 1.5]
