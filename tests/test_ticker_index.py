import random

import pytest

from barloom.operators.tickers import search_tickers
from barloom.schema import TICKER_COLUMNS
from barloom.session import scratch_path
from barloom.sources.ticker_index import grams_of_query, search_index, write_index

WORDS = ["Red", "Ürün", "blue chip", "a.b*c", "Reden", "X", "", "derred", "AAAA"]


@pytest.fixture(scope="module")
def listing(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        name = None if i % 17 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(0, 4)))
        ticker = None if i == 299 else f"{rng.choice('ABR')}{rng.choice(['', 'ED', 'x.'])}{i % 90}"
        values = {"ticker": ticker, "name": name, "market": rng.choice(["stocks", "fx"]),
                  "type": "CS", "active": i % 3 > 0}
        rows.append(tuple(values.get(c) for c in TICKER_COLUMNS))
    schema = ", ".join(f"{c} {'boolean' if c == 'active' else 'string'}" for c in TICKER_COLUMNS)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def root(spark, listing):
    root = scratch_path(spark, "index")
    write_index(listing, root)
    return root


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "text", ["r", "ed", "RED", " derred ", "blue chip r", "ürü", "*c", "aaaaa", "zzz", "d b", "", None]
)
def test_index_finds_what_a_scan_finds(spark, listing, root, text):
    assert _rows(search_index(spark, root, query=text)) == _rows(
        search_tickers(listing, query=text)
    )


def test_conditions_and_limit_apply(spark, listing, root):
    asked = {"query": "red", "markets": ["FX"], "active": True}
    assert _rows(search_index(spark, root, **asked)) == _rows(search_tickers(listing, **asked))
    assert search_index(spark, root, query="e", limit=3).count() == 3


def test_only_the_grams_of_the_query_are_read(spark, root):
    assert grams_of_query("reds") == ["eds", "red"]
    plan = search_index(spark, root, query="reds")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "Scan parquet" in line]
    postings = next(line for line in scans if "gram" in line)
    assert "bucket" in postings.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(gram" in postings
    assert any("dynamicpruning" in line for line in scans)


def test_an_index_is_not_overwritten(spark, listing, root):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_index(listing, root)


def test_empty_listing(spark, listing):
    root = scratch_path(spark, "index")
    write_index(listing.limit(0), root)
    assert search_index(spark, root, query="red").count() == 0
