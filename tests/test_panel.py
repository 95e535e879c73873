
import pytest
from pyspark.sql import functions as F

from tapeline.operators import panel


def rows(prices, **more):
    return [("s", "d", sess, bkt, p) for sess, bkt, p in prices]


def test_labels_enter_a_row_late_and_stay_in_their_session(spark):
    df = spark.createDataFrame(rows([(0, 1, 10.0), (0, 2, 11.0), (0, 3, 12.1), (1, 9, 20.0), (1, 10, 30.0)]), "symbol string, trade_date string, sess int, bkt long, last_px double")
    out = {(r.sess, r.bkt): r for r in panel.with_labels(df, (1,)).collect()}
    assert out[0, 1].ret_next == pytest.approx(0.1) and out[0, 1].ret_skip == out[0, 1].ret_1 == pytest.approx(0.1)
    assert out[0, 2].ret_skip is None and out[0, 3].ret_next is None and out[1, 9].ret_next == pytest.approx(0.5)


def test_training_ranks_keep_nulls_and_leave_out_rows_without_label(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 5.0, 2.0), (1, None, 3.0), (1, 9.0, None)], "t int, x double, y double")
    got = sorted(((r.x, r.y_rank) for r in panel.ranked(df, ["x"], "y", ["t"]).collect()), key=str)
    assert got == [(0.75, 1 / 3), (0.75, 2 / 3), (None, 1.0)]


def test_groups_find_separate_clusters(spark):
    df = spark.createDataFrame([(f"{k}{i}", 100.0 * k + i, 1e-6 * k) for k in range(3) for i in range(10)] + [("null", None, 1.0)], "name string, a double, b double")
    out = panel.groups(df, ["a", "b"], 3).collect()
    assert len(out) == 30 and len({(r.name[0], r.grp) for r in out}) == 3


def test_monotonicity_of_a_rising_and_a_falling_label(spark):
    df = spark.createDataFrame([(d, i, float(i), float(i if d == "up" else -i)) for d in ("up", "down") for i in range(100)], "d string, t int, x double, y double")
    out = {r.d: r for r in panel.monotonicity(df, "x", "y", ["d"], ["d"]).collect()}
    assert out["up"].steady_raw == pytest.approx(1) and out["down"].steady_rest == pytest.approx(-1) and out["up"].groups == 10


def test_matches_with_nulls(spark):
    schema = "k int, x double, y long"
    a = spark.createDataFrame([(1, 1.0, 5), (2, 1.0, None), (3, None, None), (4, 0.0, 1)], schema)
    b = spark.createDataFrame([(1, 1.005, 5), (2, 1.02, 7), (3, None, None), (5, 0.0, 1)], schema)
    out = {r.field: r for r in panel.matches(a, b, ["k"], ["x", "y"]).collect()}
    assert out["x"].n == 3 and out["x"].share == pytest.approx(2 / 3) and out["y"].share == pytest.approx(2 / 3)


def test_spectrum_peaks_at_the_period_there_is(spark):
    times = spark.range(4000).withColumn("t", F.col("id")).where(F.pmod("t", F.lit(20)) < 3)
    out = sorted(panel.spectrum(times, "t", 1, 40, 5.0, 40.0, 100).collect(), key=lambda r: -r.power)
    assert out[0].period == pytest.approx(20) and out[0].power > 2 * out[2].power
    assert panel.spectrum(times.limit(0), "t", 1).collect() == []
