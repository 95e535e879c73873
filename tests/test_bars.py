import pytest

from tapeline.operators import bars

SCHEMA = "ticker string, session_date string, length int, minute int, open double, high double, low double, close double, volume double, n_trans long"


def linear(spark, gap=None):
    """Opens of 100 plus the minute, closes half above; the bar of minute ``gap`` has a price but no volume."""
    rows = [("a", "d", 60, m, 100.0 + m, 101.0 + m, 100.0 + m, 100.5 + m, 0.0 if m == gap else 1000.0, 10) for m in range(60)]
    return bars.on_grid(spark.createDataFrame(rows, SCHEMA))


def by_minute(df):
    return {r.minute: r for r in df.collect()}


def test_label_enters_a_minute_late_and_holds_its_horizon(spark):
    out = by_minute(bars.labels(bars.priced(linear(spark)), (15,), 1))
    assert out[0].label_15 == pytest.approx(117 / 102 - 1)
    assert out[42].label_15 == pytest.approx(159 / 144 - 1) and out[43].label_15 is None


def test_a_bar_without_volume_is_no_price(spark):
    grid = linear(spark, gap=30)
    out = by_minute(bars.labels(bars.features(bars.priced(grid)), (5,), 1))
    assert by_minute(grid)[30].observed and not out[30].observed
    # it is in the window of returns of minutes 30 to 35, and in the holding windows of labels 23 to 28
    assert [m for m in range(5, 60) if out[m].ret_5 is None] == list(range(30, 36))
    assert [m for m in range(53) if out[m].label_5 is None] == [*range(23, 29), 30]
    assert out[30].range_pct is None and out[29].range_pct is not None


def test_no_bars(spark):
    assert bars.rolling_factors(bars.priced(linear(spark).limit(0))).collect() == []
