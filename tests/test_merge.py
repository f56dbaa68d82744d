from pyspark.sql import functions as F

from barloom.operators.merge import (
    contract_history,
    integer_range_report,
    merge_report,
    merge_runs,
)


def _runs(make_bars):
    first = make_bars([("2025-06-01 09:30", 4500), ("2025-06-01 09:31", 4501)], kind="futures",
                      symbol="ES", ticker="ESM5").withColumn("run_id", F.lit("20260704T180000"))
    again = make_bars([("2025-06-01 09:30", 4502)], kind="futures", symbol="ES",
                      ticker="ESM5").withColumn("run_id", F.lit("20260711T183000"))
    return first.unionByName(again)


def test_last_run_wins(make_bars):
    rows = merge_runs(_runs(make_bars)).orderBy("window_start").collect()
    assert [(r.window_start.minute, r.open) for r in rows] == [(30, 4502.0), (31, 4501.0)]


def test_two_tickers_at_one_time_are_both_kept(make_bars):
    other = make_bars([("2025-06-01 09:30", 5000)], kind="futures", symbol="ES",
                      ticker="ESU5").withColumn("run_id", F.lit("20260704T180000"))
    merged = merge_runs(_runs(make_bars).unionByName(other))
    assert merged.count() == 3


def test_row_order_breaks_ties_inside_a_run(make_bars):
    twice = make_bars([("2025-06-01 09:30", 1), ("2025-06-01 09:30", 2)]).withColumns(
        {"run_id": F.lit("20260704T180000"), "row_index": F.col("open").cast("bigint")}
    )
    merged = merge_runs(twice)
    assert [r.open for r in merged.collect()] == [2.0]
    assert [r.row_index for r in merged.collect()] == [2]


def test_merge_report_counts(make_bars):
    row = merge_report(_runs(make_bars)).first()
    assert (row.rows_read, row.row_count, row.duplicates_removed) == (3, 2, 1)
    assert row.source_run_count == 2
    only_newest = _runs(make_bars).filter("minute(window_start) = 30")
    assert merge_report(only_newest).first().source_run_count == 1


def test_integer_range(make_bars):
    bars = make_bars([("2025-06-01 09:30", 1), ("2025-06-01 09:31", 2)], volumes=[5, 2**31])
    row = integer_range_report(bars).first()
    assert row.volume_fits_int32 is False
    assert row.transactions_fits_int32 is True


def test_contract_history_keeps_latest_and_fills_tick(spark):
    rows = [
        ("ES", "A", "2025-01-01", None), ("ES", "A", "2025-02-01", 0.25),
        ("ES", "B", "2025-02-01", None), ("ES", "C", "2025-01-01", 0.25),
        ("ES", "A-B", "2025-02-01", 0.05), ("ES", "A-C", "2025-02-01", 0.05),
        ("ES", "B-C", "2025-02-01", 0.05), ("NQ", "N", "2025-02-01", None),
    ]
    snapshots = spark.createDataFrame(
        rows, "product_code string, ticker string, date string, trade_tick_size double"
    )
    out = {r.ticker: r.trade_tick_size for r in contract_history(snapshots).collect()}
    assert out == {"A": 0.25, "B": 0.25, "C": 0.25, "A-B": 0.05, "A-C": 0.05, "B-C": 0.05,
                   "N": None}
