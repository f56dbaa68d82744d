from datetime import datetime

import pyarrow as pa
import pytest
from pyarrow import parquet as pq

from barloom.sources.widening import footer_census, read_widened, read_widened_runs, widest


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Three loads of one column set in three types, one of them without ``transactions``."""
    root = tmp_path_factory.mktemp("runs")
    at = datetime(2024, 1, 2, 14, 30)
    loads = {
        "r1": {"window_start": pa.array([at], pa.timestamp("us")),
               "volume": pa.array([7], pa.int32()), "close": pa.array([1.5], pa.float32()),
               "transactions": pa.array([3], pa.int16())},
        "r2": {"window_start": pa.array([1704205800000001999, -1], pa.timestamp("ns")),
               "volume": pa.array([1 << 40, None], pa.int64()),
               "close": pa.array([2.25, None], pa.float64())},
        "r3": {"transactions": pa.array([9], pa.int64()), "volume": pa.array([0.5]),
               "window_start": pa.array([at], pa.timestamp("us")),
               "close": pa.array([4], pa.int32())},
    }
    for run, columns in loads.items():
        folder = root / f"run_id={run}/instrument_type=stocks/resolution=1min/month=2024-01"
        folder.mkdir(parents=True)
        pq.write_table(pa.table(columns), folder / "part-0.parquet")
    return str(root)


def test_runs_of_three_schemas_are_one_table(spark, root):
    rows = read_widened_runs(spark, root)
    kinds = dict(rows.dtypes)
    assert (kinds["volume"], kinds["close"], kinds["transactions"], kinds["window_start"]) == (
        "double", "double", "bigint", "timestamp_ntz",
    )
    found = {
        tuple(r) for r in rows.select("run_id", "window_start", "volume", "close", "transactions").collect()
    }
    at = datetime(2024, 1, 2, 14, 30)
    assert found == {
        ("r1", at, 7.0, 1.5, 3),
        ("r2", at.replace(microsecond=1), float(1 << 40), 2.25, None),
        ("r2", datetime(1969, 12, 31, 23, 59, 59, 999999), None, None, None),
        ("r3", at, 0.5, 4.0, 9),
    }


def test_a_run_is_still_a_partition(spark, root):
    plan = read_widened_runs(spark, root).where("run_id = 'r2'")
    assert plan.count() == 2
    assert "run_id" in plan._jdf.queryExecution().executedPlan().toString()


def test_census_lists_every_file(spark, root):
    assert footer_census(spark, root).count() == 3


@pytest.mark.parametrize(
    "kinds,to",
    [({"int"}, "bigint"), ({"int", "bigint"}, "bigint"), ({"bigint", "float"}, "double"),
     ({"float"}, "float"), ({"decimal(10,2)", "int"}, "double"), ({"date", "timestamp_nanos"}, "timestamp_ntz"),
     ({"string", "bigint"}, "string"), ({"boolean"}, "boolean")],
)
def test_widest_type(kinds, to):
    assert widest(kinds) == to


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no files"):
        read_widened(spark, str(tmp_path / "empty"))
