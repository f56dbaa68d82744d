import os
import sys
from datetime import timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from helpers import at, day  # noqa: E402

from barloom.session import build_session  # noqa: E402
from barloom.sources.store import conform  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def contracts(spark):
    rows = [
        ("ES", "ESH5", day("2024-12-16"), day("2025-03-14"), day("2025-03-14"), 0.25, "ESH5 Future",
         "single", False),
        ("ES", "ESM5", day("2025-03-17"), day("2025-06-13"), day("2025-06-13"), 0.25, "ESM5 Future",
         "single", True),
        ("ES", "ESU5", day("2025-06-16"), day("2025-09-12"), day("2025-09-12"), 0.25, "ESU5 Future",
         "single", True),
        ("ES", "ESH5-ESM5", day("2024-12-16"), day("2025-03-14"), day("2025-03-14"), 0.05, "x",
         "single", True),
        ("ES", "ESX5", day("2024-12-16"), day("2025-04-14"), day("2025-04-14"), 0.05, "x",
         "combo", True),
        ("ES", "ESZ9", None, day("2025-12-12"), None, 0.25, "x", "single", True),
    ]
    return spark.createDataFrame(
        rows,
        "product_code string, ticker string, first_trade_date date, last_trade_date date, "
        "settlement_date date, trade_tick_size double, name string, type string, active boolean",
    )


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from (window_start text, open) pairs, by the fixture rule high = open + 1 and so on."""

    def build(points, *, kind="stocks", symbol="AAA", resolution="1min", ticker=None,
              session=None, volumes=None):
        rows = []
        for i, (moment, price) in enumerate(points):
            moment = at(moment) if isinstance(moment, str) else moment
            ends = session or moment.date()
            ends = day(ends) if isinstance(ends, str) else ends
            rows.append(
                (kind, symbol, resolution, moment, ends, ticker or symbol, float(price),
                 price + 1.0, price - 1.0, price + 0.5,
                 volumes[i] if volumes else 100, 10, price * 100.0)
            )
        schema = (
            "instrument_type string, symbol string, resolution string, "
            "window_start timestamp_ntz, session_end_date date, ticker string, open double, "
            "high double, low double, close double, volume bigint, transactions bigint, "
            "dollar_volume double"
        )
        return conform(spark.createDataFrame(rows, schema))

    return build


@pytest.fixture(scope="session")
def minutes():
    """Consecutive minutes from a start, opens counting up from a base."""

    def build(start, n, base=100.0):
        first = at(start)
        return [(first + timedelta(minutes=i), base + i) for i in range(n)]

    return build
