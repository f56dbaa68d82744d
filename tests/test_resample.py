from datetime import date, timedelta

import pytest

from barloom.operators.filters import filter_intraday
from barloom.operators.resample import parse_timescale, resample_days, resample_minutes


def _buckets(df):
    rows = df.orderBy("session_end_date", "window_start").collect()
    return [(r.window_start.strftime("%d %H:%M"), r.candle_count) for r in rows]


def test_grid_is_the_same_every_day(make_bars, minutes):
    bars = make_bars(minutes("2025-06-02 09:30", 10) + minutes("2025-06-03 09:30", 10))
    assert _buckets(resample_minutes(bars, 7)) == [("02 09:30", 7), ("03 09:30", 7)]


def test_gap_keeps_its_bucket(make_bars, minutes):
    bars = make_bars(minutes("2025-06-02 09:30", 7) + minutes("2025-06-02 09:39", 5))
    assert _buckets(resample_minutes(bars, 7)) == [("02 09:30", 7), ("02 09:37", 5)]


def test_bar_values(make_bars, minutes):
    bars = make_bars(minutes("2025-06-02 09:30", 7), volumes=[10, 20, 30, 40, 50, 60, 70])
    row = resample_minutes(bars, 7).first()
    assert (row.open, row.close, row.high, row.low) == (100.0, 106.5, 107.0, 99.0)
    assert (row.volume, row.transactions) == (280, 70)
    assert row.ticker == "AAA"


def test_intraday_window_sets_the_session_end(make_bars, minutes):
    bars = make_bars(minutes("2025-06-02 09:30", 10))
    wide = resample_minutes(bars, 7, begin="09:30", end="16:00")
    assert _buckets(wide) == [("02 09:30", 7), ("02 09:37", 3)]
    tight = resample_minutes(bars, 7, begin="09:30", end="09:39")
    assert _buckets(tight) == [("02 09:30", 7)]


def test_overnight_session(make_bars, minutes):
    one = make_bars(
        minutes("2025-06-01 20:00", 10) + minutes("2025-06-02 03:55", 5), session="2025-06-02"
    )
    two = make_bars(
        minutes("2025-06-02 20:00", 10) + minutes("2025-06-03 03:55", 5), session="2025-06-03"
    )
    out = _buckets(resample_minutes(one.unionByName(two), 7, begin="20:00", end="04:00"))
    assert out == [
        ("01 20:00", 7), ("01 20:07", 3), ("02 03:49", 1),
        ("02 20:00", 7), ("02 20:07", 3), ("03 03:49", 1),
    ]


def test_bar_before_the_anchor_gets_a_negative_bucket(make_bars):
    bars = make_bars([("2025-06-02 09:25", 1), ("2025-06-02 09:30", 2)])
    out = _buckets(resample_minutes(bars, 7, begin="09:30", end="16:00"))
    assert out == [("02 09:23", 1), ("02 09:30", 1)]


def test_anchor_follows_daylight_saving(make_bars):
    bars = make_bars([("2024-01-15 15:30", 1), ("2024-07-15 14:30", 2)])
    out = _buckets(
        resample_minutes(bars, 30, begin="09:30", end="16:00", timezone="America/Chicago")
    )
    assert out == [("15 15:30", 1), ("15 14:30", 1)]


def test_instruments_do_not_mix(make_bars, minutes):
    bars = make_bars(minutes("2025-06-02 09:30", 7)).unionByName(
        make_bars(minutes("2025-06-02 09:33", 7, 500.0), symbol="BBB")
    )
    out = {r.instrument_key: (r.window_start.minute, r.open)
           for r in resample_minutes(bars, 7).collect()}
    assert out == {"stocks:AAA": (30, 100.0), "stocks:BBB": (33, 500.0)}


def test_a_roll_inside_a_bucket_gives_one_bar(make_bars):
    bars = make_bars([("2025-06-02 09:30", 1), ("2025-06-02 09:31", 2)], ticker="OLD").unionByName(
        make_bars([("2025-06-02 09:32", 3)], ticker="NEW")
    )
    row = resample_minutes(bars, 3).collect()
    assert len(row) == 1
    assert (row[0].open, row[0].close, row[0].ticker, row[0].candle_count) == (1.0, 3.5, "OLD", 3)


@pytest.mark.parametrize("k", [0, -1, -10])
def test_invalid_k(make_bars, minutes, k):
    with pytest.raises(ValueError):
        resample_minutes(make_bars(minutes("2025-06-02 09:30", 2)), k)
    with pytest.raises(ValueError):
        resample_days(make_bars(minutes("2025-06-02 09:30", 2)), k)


def test_k_of_one_only_counts(make_bars, minutes):
    out = resample_minutes(make_bars(minutes("2025-06-02 09:30", 3)), 1)
    assert [r.candle_count for r in out.collect()] == [1, 1, 1]


def test_intraday_filter_in_chicago_summer(make_bars):
    bars = make_bars([(f"2024-07-15 {t}", 1) for t in ("14:00", "14:30", "21:00", "21:30")])
    kept = filter_intraday(bars, "09:30", "16:00", "America/Chicago").collect()
    assert sorted(r.window_start.strftime("%H:%M") for r in kept) == ["14:30", "21:00"]
    with pytest.raises(ValueError):
        filter_intraday(bars, "09:30", "09:30")


def _days(make_bars, dates):
    return make_bars([(f"{d} 00:00", 100 + i) for i, d in enumerate(dates)], resolution="1day")


def _weekdays(n_weeks, extra=0):
    start = date(2024, 1, 1)
    days = [start + timedelta(days=7 * w + d) for w in range(n_weeks) for d in range(5)]
    days += [start + timedelta(days=7 * n_weeks + d) for d in range(extra)]
    return [d.isoformat() for d in days]


def test_two_day_bars(make_bars):
    dates = [(date(2024, 1, 1) + timedelta(days=i)).isoformat() for i in range(10)]
    assert [r.candle_count for r in resample_days(_days(make_bars, dates), 2).collect()] == [2] * 5
    assert resample_days(_days(make_bars, dates[:5]), 2).count() == 2


def test_weeks(make_bars):
    full = resample_days(_days(make_bars, _weekdays(4)), 7, week_aligned=True).collect()
    assert [r.candle_count for r in full] == [5, 5, 5]
    more = resample_days(_days(make_bars, _weekdays(4, 2)), 7, week_aligned=True).collect()
    assert [r.candle_count for r in more] == [5, 5, 5, 5]
    with pytest.raises(ValueError):
        resample_days(_days(make_bars, _weekdays(1)), 5, week_aligned=True)


@pytest.mark.parametrize(
    ("text", "resolution", "minutes", "days", "week"),
    [("1min", "1min", 1, 1, False), ("15min", "1min", 15, 1, False),
     ("2hour", "1min", 120, 1, False), ("3day", "1day", 1, 3, False),
     ("week", "1day", 1, 7, True), ("2Week", "1day", 1, 14, True)],
)
def test_timescales(text, resolution, minutes, days, week):
    assert parse_timescale(text) == {
        "resolution": resolution, "k_minutes": minutes, "k_days": days, "week_aligned": week
    }
    with pytest.raises(ValueError):
        parse_timescale("3fortnight")


def test_tracks_of_one_instrument_are_resampled_apart(make_bars, minutes):
    one_minute = make_bars(minutes("2025-06-02 00:00", 60, 1.0))
    daily = make_bars([("2025-06-02", 999), ("2025-06-09", 9)], resolution="1day")
    got = resample_minutes(one_minute.unionByName(daily), 30).orderBy("window_start").collect()
    assert [(r.resolution, r.candle_count, r.high, r.volume) for r in got] == [
        ("1min", 30, 31.0, 3000), ("1min", 30, 61.0, 3000)
    ]
    weeks = resample_days(one_minute.unionByName(daily), 7, week_aligned=True).collect()
    assert [(r.resolution, r.candle_count, r.close) for r in weeks] == [("1day", 1, 999.5)]
