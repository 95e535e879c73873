import numpy as np

from tapeline.operators.grid import minute_grid, smooth

OPEN, MIN = 1_319_463_000_000_000_000, 60 * 10**9
BARS = "bar_id long, ticker string, profile string, window_start long, close double, loaded_at timestamp, _i int"
SESSIONS = "session_date string, open_ns long, close_ns long, half_day boolean"


def grid(spark, rows, minutes=4):
    bars = spark.createDataFrame(rows, BARS)
    sessions = spark.createDataFrame([("2011-10-24", OPEN, OPEN + minutes * MIN, False)], SESSIONS)
    return minute_grid(bars, sessions).orderBy("ticker", "grid_at").collect()


def row(i, at, close, profile="flatfiles", ticker="A", loaded=None):
    return (i, ticker, profile, at if profile == "flatfiles" else at // 10**6, close, loaded, 0)


def test_minutes_without_a_usable_reading_are_missing(spark):
    rows = [
        row(0, OPEN, 10.0),
        row(1, OPEN + MIN, float("nan")),
        row(2, OPEN + 2 * MIN + 5 * 10**9, 12.0, "rest_split_adjusted"),
        row(3, OPEN + 3 * MIN, None),
        row(4, OPEN + 4 * MIN, 13.0),  # at the close: outside
        row(5, OPEN - 1, 9.0),
        row(6, OPEN, -1.0, ticker="B"),  # no usable reading: no rows
        row(7, OPEN, 5.0, ticker=None),
    ]
    out = grid(spark, rows)
    assert [(r.ticker, (r.grid_at - OPEN) // MIN, r.missing) for r in out] == [("A", 0, False), ("A", 1, True), ("A", 2, False), ("A", 3, True)]
    assert all(9.5 < r.filled < 12.5 and r.filled_sd >= 0 for r in out)


def test_all_readings_of_a_minute_count_and_the_last_is_shown(spark):
    early = [row(0, OPEN, 10.0), row(1, OPEN + 5 * 10**9, 14.0), row(2, OPEN + 50 * 10**9, 11.0), row(3, OPEN + 2 * MIN, 12.0)]
    out, without = grid(spark, early), grid(spark, [early[0], *early[2:]])
    assert [r.reading for r in out] == [r.reading for r in without] == [11.0, None, 12.0, None]
    assert [r.filled for r in out] != [r.filled for r in without]


def test_last_reading_of_a_minute_and_repeated_rows(spark):
    out = grid(spark, [row(0, OPEN, 10.0), row(1, OPEN + 7, 11.0), row(1, OPEN + 7, 11.0), row(2, OPEN + MIN, 11.0)])
    assert [r.reading for r in out] == [11.0, 11.0, None, None]


def test_empty_table_and_extra_columns(spark):
    assert grid(spark, []) == []


def at_starts(y):
    """Readings at their steps' starts as smooth() takes them."""
    at = np.where(np.isnan(y), np.nan, np.arange(y.shape[1], dtype=float))
    order = np.argsort(at, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(y, order, 1)


def test_smoother_follows_a_line_and_is_unsure_in_gaps():
    y = np.arange(60, dtype=float)[None, :].copy()
    y[0, 20:30] = np.nan
    level, sd = smooth(*at_starts(y), 60)
    assert np.allclose(level[0, 21:29], np.arange(21, 29), atol=1.0)
    assert sd[0, 25] > sd[0, 10]


def test_series_of_a_part_do_not_touch_each_other():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(5, 30)).cumsum(axis=1)
    y[rng.random(y.shape) < 0.4] = np.nan
    y[:, 3] = 1.0
    at, values = at_starts(y)
    together = smooth(at, values, 30)
    for i in range(5):
        k = int((~np.isnan(at[i])).sum())
        alone = smooth(at[i : i + 1, :k], values[i : i + 1, :k], 30)
        assert np.allclose(together[0][i], alone[0][0]) and np.allclose(together[1][i], alone[1][0])


def test_smoother_agrees_with_dense_gaussian_conditioning():
    """The smoothed level is the conditional mean of the Gaussian process that the state space defines, with several readings in a step."""
    from tapeline.operators import grid as g

    rng = np.random.default_rng(3)
    readings = np.sort(np.r_[rng.random(8) * 11.9, 4.1, 4.3, 4.9, 0.0, 7.0])
    z = rng.normal(size=len(readings)).cumsum()
    times = np.concatenate([np.arange(12.0), readings])
    order = np.argsort(times, kind="stable")
    values = np.concatenate([np.full(12, np.nan), z])[order][:, None]
    dt = np.diff(times[order], prepend=0.0)[:, None]
    ratio = np.array([0.5])
    level, deviation = (x[order < 12, 0] for x in g._filter(values, dt, ratio, keep=True))
    q = 1 / (1 + 2 * ratio[0])
    s, t = np.minimum.outer(times, times), np.maximum.outer(times, times)
    cov = 1e4 + 1e-2 * np.outer(times, times) + q * s + q * g.SLOPE * (s * s * t / 2 - s**3 / 6)
    a, b = cov[:12, 12:], cov[12:, 12:] + ratio[0] * q * np.eye(len(readings))
    gain = a @ np.linalg.inv(b)
    assert np.allclose(level, gain @ z, atol=1e-5)
    assert np.allclose(deviation**2, np.diag(cov[:12, :12] - gain @ a.T), atol=1e-5)


def test_more_series_than_are_smoothed_at_once(spark):
    rows = [row(i, OPEN + (i % 3) * MIN, 1.0 + i, ticker=f"t{i // 2}") for i in range(600)]
    assert len(grid(spark, rows)) == 1200
