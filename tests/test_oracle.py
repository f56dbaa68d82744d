"""Registered queries against their SQL twins, on the test tables where present."""

import os

import pytest
from check_oracle import compare, connect

from workload.registry import registered

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
SAMPLE = [
    "merge_runs", "session_bars_60m", "intraday_bars_chicago_15m", "weekly_bars", "adjust_splits",
    "query_continuous_30m", "tick_quality", "health_issues", "portfolio_performance",
    "efficient_frontier", "lots_table", "land_chart_bars", "stream_merge_runs",
]
NAMES = list(registered()) if os.environ.get("ORACLE") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, registered()[name], SF) == ""


def test_every_query_has_a_twin():
    assert [n for n, q in registered().items() if q.oracle is None] == []
