"""The log beside stored tables: whole writes or none, and figures without reading bars."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame

from barloom.operators.filters import latest_page
from barloom.operators.merge import merge_report, merge_runs
from barloom.operators.planning import run_catalog
from barloom.operators.resample import session_bounds
from barloom.plans.bar_query import BarQuery, query_bars, query_latest_page
from barloom.session import scratch_path
from barloom.sources import manifest, store
from barloom.streaming.merge import landed_runs, merge_batch, start_merge


@pytest.fixture()
def runs(spark, make_bars, minutes):
    root = scratch_path(spark, "raw")
    first = make_bars(minutes("2025-05-31 23:50", 20)).unionByName(
        make_bars(minutes("2025-05-31 23:50", 20), symbol="BBB")
    )
    store.save_run(first, root, "20250601T000000")
    store.save_run(make_bars(minutes("2025-06-01 00:05", 10, 500.0)), root, "20250602T000000")
    return root


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _bars(spark, root):
    return _rows(store.read_bars(spark, root).select("instrument_key", "window_start", "open"))


def _scanned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_figures_come_from_the_log_alone(spark, runs):
    bars = scratch_path(spark, "bars")
    store.write_bars(merge_runs(store.read_runs(spark, runs)), bars)
    logged, held = store.run_log(spark, runs), store.bars_log(spark, bars)
    catalog = manifest.run_catalog(logged)
    assert _rows(catalog) == _rows(run_catalog(store.read_runs(spark, runs)))
    numbers = manifest.merge_numbers(logged, held)
    report = merge_report(store.read_runs(spark, runs)).select(numbers.columns)
    assert _rows(numbers) == _rows(report)
    bounds = manifest.session_bounds(held)
    assert _rows(bounds) == _rows(session_bounds(store.read_bars(spark, bars)))
    for figures in (catalog, numbers, bounds, manifest.held_rows(held)):
        plan = _scanned(figures)
        assert "_manifest" in plan and "close" not in plan and "month=" not in plan


def test_a_write_that_dies_between_months_changes_nothing(spark, runs, make_bars, monkeypatch):
    bars = scratch_path(spark, "bars")
    merge_batch(store.read_runs(spark, runs).where("run_id < '20250602'"), bars)
    before = _bars(spark, bars)

    def killed(*args, **kinds):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        # the files of both months are written, then the writer dies
        patch.setattr(store.log, "append", killed)
        with pytest.raises(KeyboardInterrupt):
            merge_batch(store.read_runs(spark, runs), bars)
    assert _bars(spark, bars) == before
    merge_batch(store.read_runs(spark, runs), bars)
    after = _bars(spark, bars)
    assert after != before
    assert after == _rows(
        merge_runs(store.read_runs(spark, runs)).select("instrument_key", "window_start", "open")
    )
    merge_batch(store.read_runs(spark, runs), bars)
    assert _bars(spark, bars) == after


def test_readers_keep_their_state_and_old_files_are_listed(spark, make_bars):
    root = scratch_path(spark, "bars")
    store.write_bars(make_bars([("2025-05-31 10:00", 1), ("2025-06-01 10:00", 2)]), root)
    held = store.read_bars(spark, root)
    assert manifest.replaced_parts(spark, root) == []
    store.write_bars(make_bars([("2025-06-01 10:00", 3)]), root)
    assert {r.open for r in held.collect()} == {1.0, 2.0}
    assert {r.open for r in store.read_bars(spark, root).collect()} == {1.0, 3.0}
    [old] = manifest.replaced_parts(spark, root)
    assert old.endswith("month=2025-06")
    june = store.read_bars(spark, root, months=("2025-06", None))
    assert [r.open for r in june.collect()] == [3.0]
    assert len(june.inputFiles()) == 1


def test_compaction_keeps_what_readers_see(spark, make_bars):
    root = scratch_path(spark, "bars")
    for price in (1, 2, 3):
        store.write_bars(make_bars([("2025-05-31 10:00", price), ("2025-06-01 10:00", 9)]), root)
    before, log = _bars(spark, root), _rows(store.bars_log(spark, root).drop("commit", "whole"))
    manifest.compact(spark, root)
    assert _bars(spark, root) == before and manifest.entries(spark, root).count() == 2
    assert _rows(store.bars_log(spark, root).drop("commit", "whole")) == log
    store.write_bars(make_bars([("2025-06-01 10:00", 4)]), root)
    assert {r[2] for r in _bars(spark, root)} == {3.0, 4.0}


def test_a_table_never_written_is_empty(spark, make_bars):
    root = scratch_path(spark, "bars")
    assert store.read_bars(spark, root).count() == 0 and store.bars_log(spark, root).count() == 0
    merge_batch(make_bars([("2025-05-31 10:00", 1)]), root)
    assert store.read_bars(spark, root).count() == 1


def test_stream_writes_a_month_once_per_batch(spark, runs):
    bars = scratch_path(spark, "bars")
    start_merge(landed_runs(spark, runs), bars, scratch_path(spark, "check")).awaitTermination()
    assert manifest.entries(spark, bars).select("version").distinct().count() == 1
    assert manifest.replaced_parts(spark, bars) == []


def test_latest_page_reads_the_months_that_hold_it(spark, make_bars, minutes):
    root = scratch_path(spark, "bars")
    parts = [make_bars(minutes(f"2025-{m:02d}-05 09:30", 300)) for m in range(1, 7)]
    parts.append(make_bars(minutes("2025-05-31 23:30", 60), session="2025-06-01"))
    parts += [
        make_bars(minutes(f"2025-{m:02d}-{day:02d} 09:00", 400), symbol="BBB")
        for m in (5, 6) for day in range(1, 13)
    ]
    store.write_bars(reduce(DataFrame.unionByName, parts), root)
    for scale, n, months in (("30min", 2, None), ("1min", 200, 5), ("1min", 350, 4), ("1min", 3000, None)):
        query = BarQuery(scale)
        page = query_latest_page(spark, root, query, n)
        whole = latest_page(query_bars(store.read_bars(spark, root), query), n)
        assert _rows(page) == _rows(whole)
        read = {f.split("month=2025-")[1][:2] for f in page.inputFiles()}
        assert min(read) == f"{months or 1:02d}"
    page = query_latest_page(spark, root, BarQuery("30min"), 20, symbols=["BBB"])
    whole = latest_page(query_bars(store.read_bars(spark, root, symbols=["BBB"]), BarQuery("30min")), 20)
    assert _rows(page) == _rows(whole)
    assert {f.split("month=2025-")[1][:2] for f in page.inputFiles()} == {"05", "06"}
    early = query_latest_page(spark, root, BarQuery("1min", end="2025-04-30"), 10)
    assert {r.window_start.month for r in early.collect()} == {4}
    assert {f.split("month=2025-")[1][:2] for f in early.inputFiles()} > {"03", "04"}
