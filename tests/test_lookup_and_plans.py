"""Join strategy and the shape of physical plans."""

import io
from contextlib import redirect_stdout

import pytest
from helpers import at
from pyspark.sql import functions as F

from barloom.operators.adjust import adjust_splits
from barloom.operators.filters import filter_range, first_bars, latest_page
from barloom.operators.lookup import fits_broadcast, lookup_join
from barloom.operators.merge import merge_runs
from barloom.operators.resample import resample_minutes
from barloom.operators.risk import mirrored, pair_moments
from barloom.plans.bar_query import BarQuery, query_bars
from barloom.session import materialize, scratch_path
from barloom.sources import store


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def many(make_bars, minutes):
    parts = [
        make_bars(minutes("2025-06-02 09:30", 60, 10.0 * i), symbol=s)
        for i, s in enumerate(["AAA", "BBB", "CCC"], 1)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _splits(spark):
    rows = [(f"stocks:{s}", d, f) for s in ("AAA", "BBB")
            for d, f in (("2024-01-01", 0.1), ("2025-06-03", 0.5), ("2025-07-01", 0.9))]
    return spark.createDataFrame(
        rows, "instrument_key string, d string, historical_adjustment_factor double"
    ).select("instrument_key", F.to_date("d").alias("execution_date"),
             "historical_adjustment_factor")


def _rows(df):
    return sorted(tuple(r) for r in df.select("instrument_key", "window_start", "close").collect())


def test_salted_join_gives_the_same_rows(spark, many):
    small = adjust_splits(many, materialize(_splits(spark), "splits"))
    large = adjust_splits(many, _splits(spark), max_bytes=1, salts=5)
    assert _rows(small) == _rows(large)
    assert "Broadcast" in plan_of(small)
    assert "_side_salt" in plan_of(large)


def test_inner_salted_join(spark, many):
    side = spark.createDataFrame([("stocks:AAA", 1), ("stocks:AAA", 2)],
                                 "instrument_key string, n int")
    salted = lookup_join(many, side, ["instrument_key"], how="inner", max_bytes=1)
    plain = many.join(side, "instrument_key")
    assert salted.count() == plain.count() == 120
    assert sorted(salted.columns) == sorted(plain.columns)


def test_size_check(spark):
    assert fits_broadcast(spark.range(10), 80)
    assert not fits_broadcast(spark.range(11), 80)
    assert fits_broadcast(spark.range(10))


def test_resampling_shuffles_bars_once_and_hashes(many):
    plan = plan_of(resample_minutes(many, 7))
    tree = plan.split("\n\n\n")[0]
    assert tree.count("Exchange") == 1
    assert "HashAggregate" in tree


def test_no_cartesian_product_and_no_single_partition_window(spark, many):
    for df in (
        merge_runs(many),
        resample_minutes(many, 7),
        latest_page(many, 5),
        query_bars(many, BarQuery("15min"), splits=_splits(spark)),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        assert "SinglePartition" not in plan


def test_pages_across_days(make_bars, minutes):
    bars = make_bars(minutes("2025-06-01 23:58", 4) + minutes("2025-06-05 10:00", 3)).unionByName(
        make_bars(minutes("2025-06-02 10:00", 2), symbol="BBB")
    )

    def times(df):
        return sorted((r.symbol, r.window_start.strftime("%d %H:%M")) for r in df.collect())

    assert times(latest_page(bars, 4)) == [
        ("AAA", "02 00:01"), ("AAA", "05 10:00"), ("AAA", "05 10:01"), ("AAA", "05 10:02"),
        ("BBB", "02 10:00"), ("BBB", "02 10:01"),
    ]
    assert times(first_bars(bars, 1)) == [("AAA", "01 23:58"), ("BBB", "02 10:00")]
    assert times(latest_page(bars, 1, before="2025-06-03")) == [
        ("AAA", "02 00:01"), ("BBB", "02 10:01")
    ]


def test_merge_reads_only_touched_partitions(spark, many, make_bars):
    root = scratch_path(spark, "bars")
    store.write_bars(many, root)
    touched = store.touched_months(make_bars([("2025-06-30 10:00", 5)]))
    kept = store.bars_in_partitions(spark, root, touched)
    assert kept.inputFiles() and all("month=2025-06" in f for f in kept.inputFiles())
    assert {r.window_start.month for r in kept.collect()} == {6}


def test_top_rows_are_pruned_before_the_shuffle(many):
    assert "WindowGroupLimit" in plan_of(latest_page(many, 5))
    assert "WindowGroupLimit" in plan_of(merge_runs(many))


def test_stored_bars_prune_and_push_down(spark, many):
    root = scratch_path(spark, "bars")
    store.write_bars(many, root)
    bars = store.read_bars(spark, root, instrument_type="stocks", symbols=["AAA"],
                           resolution="1min")
    plan = plan_of(filter_range(bars, "2025-06-02 09:40", "2025-06-02").select("close"))
    assert "GreaterThanOrEqual(window_start" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<symbol:string,window_start:timestamp_ntz,close:double>"
    assert "EqualTo(symbol,AAA)" in plan
    kept = "instrument_type=stocks/resolution=1min"
    assert bars.inputFiles() and all(kept in f for f in bars.inputFiles())
    assert filter_range(bars, "2025-06-02 09:40").count() == 50


def test_writing_replaces_only_touched_partitions(spark, many, make_bars):
    root = scratch_path(spark, "bars")
    store.write_bars(many, root)
    store.write_bars(make_bars([("2025-07-01 10:00", 5)]), root)
    assert store.read_bars(spark, root).count() == 181
    store.write_bars(make_bars([("2025-06-30 10:00", 5)]), root)
    assert store.read_bars(spark, root).count() == 2


def test_runs_take_their_id_from_the_path(spark, make_bars):
    root = scratch_path(spark, "raw")
    bars = make_bars([("2025-06-01 09:30", 1)]).withColumn("run_id", F.lit("19990101T000000"))
    store.save_run(bars, root, "20260704T180000")
    store.save_run(bars.drop("volume", "product_code"), root, "20260711T183000")
    rows = store.read_runs(spark, root).orderBy("run_id").collect()
    assert [r.run_id for r in rows] == ["20260704T180000", "20260711T183000"]
    assert [r.volume for r in rows] == [100, None]
    assert {r.product_code for r in rows} == {"AAA"}
    assert {r.instrument_key for r in rows} == {"stocks:AAA"}


def test_block_moments_do_not_depend_on_the_blocks(spark):
    rows = [("u", f"S{s}", d, ((s * 7 + d * 13) % 11) / 10.0) for s in range(9) for d in range(20)]
    rets = spark.createDataFrame(rows, "universe string, symbol string, date int, ret double")

    def pairs(size):
        return {
            (r.symbol_a, r.symbol_b): (round(r.cov, 12), round(r.corr, 12), r.n_obs)
            for r in pair_moments(rets, size).collect()
        }

    whole = pairs(128)
    assert len(whole) == 45  # one triangle
    assert pairs(2) == whole
    expected = {
        (r.a, r.b): (round(r.cov, 12), round(r.corr, 12), 20)
        for r in rets.select("date", F.col("symbol").alias("a"), F.col("ret").alias("x"))
        .join(rets.select("date", F.col("symbol").alias("b"), F.col("ret").alias("y")), "date")
        .groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("corr"))
        .collect()
    }
    assert whole == {pair: x for pair, x in expected.items() if pair[0] <= pair[1]}
    both = {(r.symbol_a, r.symbol_b): round(r.cov, 12) for r in mirrored(pair_moments(rets)).collect()}
    assert both == {pair: x[0] for pair, x in expected.items()}


def test_moments_refuse_returns_on_different_dates(spark):
    rows = [("u", s, d, float(d)) for s, off in (("A", 0), ("B", 1)) for d in range(off, 5 + off)]
    rets = spark.createDataFrame(rows, "universe string, symbol string, date int, ret double")
    with pytest.raises(Exception, match="different dates"):
        pair_moments(rets).collect()


def test_no_job_runs_before_the_action(spark, make_bars, minutes):
    bars = make_bars(minutes("2025-06-01 09:30", 30))
    counted = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        query_bars(bars, BarQuery("15min", limit=3), splits=_splits(spark))
        assert list(counted.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(
    "query",
    [BarQuery(adjust=True, normalize_ticks=True), BarQuery(begin="09:30", finish="09:30"),
     BarQuery(normalize_ticks=True), BarQuery("0min"), BarQuery("1day", normalize_ticks=True)],
)
def test_meaningless_queries_are_refused(many, query):
    with pytest.raises(ValueError):
        query_bars(many, query)


def test_query_columns_and_limit(many):
    out = query_bars(many, BarQuery("1min", limit=2, columns=["close", "window_start"]))
    assert out.columns == ["close", "window_start"]
    assert out.count() == 6
    with pytest.raises(ValueError):
        query_bars(many, BarQuery(columns=["nope"]))


def test_range_bounds(make_bars):
    bars = make_bars([("2025-06-02 00:00", 1), ("2025-06-02 23:59", 2), ("2025-06-03 00:00", 3)])
    assert filter_range(bars, "2025-06-02", "2025-06-02").count() == 2
    assert filter_range(bars, end="2025-06-03T02:00:00+02:00").count() == 3
    assert filter_range(bars, at("2025-06-02 00:01")).count() == 2
