"""Range, intraday, column, row-count and request filters over bars."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.clock import clock_seconds, local_seconds
from barloom.operators.lookup import lookup_join
from barloom.schema import KEY, track

#: Rows per key up to which Spark prunes ranks before the shuffle.
RANKED = 1000

Bound = str | date | datetime | None


def parse_bound(value: Bound, *, is_end: bool = False) -> datetime | None:
    """One bound to naive UTC; a bare end date means the end of that day."""
    if value is None:
        return None
    whole_day = isinstance(value, str) and len(value.strip()) == 10
    if isinstance(value, str):
        moment = datetime.fromisoformat(value.strip())
    elif isinstance(value, datetime):
        moment = value
    else:
        moment, whole_day = datetime(value.year, value.month, value.day), True
    if is_end and whole_day:
        moment = moment.replace(hour=23, minute=59, second=59, microsecond=999999)
    if moment.tzinfo is not None:
        moment = moment.astimezone(UTC).replace(tzinfo=None)
    return moment


def _literal(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def filter_range(bars: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """Inclusive range on the bare column, so that it reaches the Parquet scan."""
    lower, upper = parse_bound(start), parse_bound(end, is_end=True)
    if lower is not None:
        bars = bars.filter(F.col("window_start") >= _literal(lower))
    if upper is not None:
        bars = bars.filter(F.col("window_start") <= _literal(upper))
    return bars


def filter_intraday(
    bars: DataFrame, begin: str, end: str, timezone: str | Column = "UTC"
) -> DataFrame:
    """Keep bars by local time of day, both bounds included; begin > end spans midnight."""
    first, last = clock_seconds(begin), clock_seconds(end)
    if first == last:
        raise ValueError("intraday begin and end must differ")
    local = local_seconds(F.col("window_start"), timezone)
    if first < last:
        return bars.filter((local >= first) & (local <= last))
    return bars.filter((local >= first) | (local <= last))


def select_columns(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in the order asked for; an unknown name is an error."""
    unknown = [c for c in columns if c not in bars.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}, available {bars.columns}")
    return bars.select(*columns)


def first_bars(bars: DataFrame, n: int, *, by: str = KEY) -> DataFrame:
    """The first ``n`` bars per key and track."""
    return _edge_bars(bars, n, by, newest=False)


def latest_page(
    bars: DataFrame,
    n: int,
    *,
    before: Bound = None,
    after: Bound = None,
    by: str = KEY,
) -> DataFrame:
    """The last ``n`` bars per key and track inside an inclusive range."""
    return _edge_bars(filter_range(bars, after, before), n, by, newest=True)


def _edge_bars(bars: DataFrame, n: int, by: str, *, newest: bool) -> DataFrame:
    """First or last ``n`` rows per key without gathering a key in one task.

    Up to RANKED rows Spark prunes to ``n`` per key before the shuffle. For
    longer pages, counting bars per day tells which days can hold the page; only
    their rows are ranked, so a window group is the page plus at most a day.
    """
    keys = [by, *[c for c in track(bars) if c not in (by, KEY)]]
    time = F.col("window_start").desc() if newest else F.col("window_start").asc()
    ranks = W.partitionBy(*keys).orderBy(time, *_tie_break(bars))
    if n > RANKED:
        bars = _days_of_page(bars, n, keys, newest=newest)
    return bars.withColumn("_n", F.row_number().over(ranks)).filter(F.col("_n") <= n).drop("_n")


def _days_of_page(bars: DataFrame, n: int, keys: list[str], *, newest: bool) -> DataFrame:
    """Bars of the days that can hold the first or last ``n`` of their key."""
    day = F.to_date("window_start")
    order = F.col("_day").desc() if newest else F.col("_day").asc()
    nearer = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    per_day = bars.groupBy(*keys, day.alias("_day")).agg(F.count("*").alias("_rows"))
    needed = per_day.withColumn("_before", F.coalesce(F.sum("_rows").over(nearer), F.lit(0)))
    edge = F.min("_day") if newest else F.max("_day")
    cut = needed.filter(F.col("_before") < n).groupBy(*keys).agg(edge.alias("_cut"))
    inside = day >= F.col("_cut") if newest else day <= F.col("_cut")
    return lookup_join(
        bars, cut, keys, condition=inside, how="inner", spread_by=[*keys, "window_start"]
    ).drop("_cut")


def _tie_break(bars: DataFrame) -> list[Column]:
    return [F.col("ticker").asc()] if "ticker" in bars.columns else []


def chart_rows(bars: DataFrame) -> DataFrame:
    """Chart projection: epoch milliseconds, doubles and an integer candle count."""
    millis = F.unix_millis(F.col("window_start").cast("timestamp"))
    optional = []
    if "volume" in bars.columns:
        optional.append(F.col("volume").cast("double").alias("volume"))
    if "candle_count" in bars.columns:
        optional.append(F.col("candle_count").cast("int").alias("candle_count"))
    return bars.select(
        KEY,
        millis.alias("time"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        *optional,
    )


def resolve_instruments(requests: DataFrame, instruments: DataFrame) -> DataFrame:
    """Requested symbols or ``type:symbol`` keys to instruments, with a status.

    Each side is matched on one text column, so the join stays an equi-join.
    """
    known = instruments.select(KEY, "symbol").distinct()
    names = known.select(F.col("symbol").alias("request"), KEY).unionByName(
        known.select(F.col(KEY).alias("request"), KEY)
    )
    per_name = names.groupBy("request").agg(
        F.count("*").alias("matches"), F.min(KEY).alias("_key")
    )
    status = (
        F.when(F.col("matches").isNull(), "unknown")
        .when(F.col("matches") > 1, "ambiguous")
        .otherwise("ok")
    )
    return (
        requests.withColumn("request", F.trim("request"))
        .join(per_name, "request", "left")
        .withColumn("status", status)
        .select(
            *requests.columns,
            "status",
            F.when(F.col("status") == "ok", F.col("_key")).alias(KEY),
        )
    )
