import numpy as np
from pyspark.sql import functions as F

from tapeline.operators import spikes

SCHEMA = "src string, source string, block string, field string, ord long, row_id long, value double"


def series(values, src="lob_records", field="price", source="s"):
    return [(src, source, "d", field, i, i, None if v is None else float(v)) for i, v in enumerate(values)]


def found(spark, rows, **kw):
    return sorted((r.source, r.row_id) for r in spikes.spikes(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def calm(n=200, seed=1, level=50.0):
    return np.round(level + np.random.default_rng(seed).normal(0, 0.05, n), 2)


def test_spike_short_run_and_lasting_move(spark):
    x = calm()
    x[50] += 3
    x[80:83] -= 4  # three rows: back within three
    y = calm(seed=2)
    y[100:] += 5  # a lasting move
    y[40:46] += 5  # six rows: no spike
    assert found(spark, series(x) + series(y, source="t")) == [("s", 50), ("s", 80), ("s", 81), ("s", 82)]


def test_bounds_null_and_nan(spark):
    x = list(calm(60))
    x[3], x[9], x[12], x[20], x[21] = 0.0, float("nan"), None, float("inf"), -1.0
    assert found(spark, series(x)) == [("s", 3), ("s", 9), ("s", 20), ("s", 21)]
    v = [0.0] * 30 + [100.0, 200.0, -1.0, 100.0]
    assert found(spark, series(v, "minute_bars", "volume")) == [("s", 32)]


def test_stuck_values_but_the_first(spark):
    x = calm(120)
    x[30:55] = 50.5
    assert found(spark, series(x)) == [("s", i) for i in range(31, 55)]
    x[70:80] = 50.7  # another run more than a third as long
    assert found(spark, series(x)) == []


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, series([1.0])) == []


def test_tiles_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = calm(3000, 7)
    x[rng.choice(3000, 20, replace=False)] += 4
    x[890:1310] = 50.5  # a stuck run over several tiles
    rows = series(x)
    whole = found(spark, rows)
    assert len(whole) > 420
    monkeypatch.setattr(spikes, "TILE", 300)
    assert found(spark, rows) == whole


def test_stuck_run_with_few_rows_before_the_border(spark, monkeypatch):
    rows = []
    for before in (1, 2, 3):
        x = calm(1200, 11) + np.arange(1200) % 2 * 0.001  # no equal neighbours
        x[330 : 330 + before] = 50.3  # an earlier run of the tile as long as the part before the border
        x[600 - before : 640] = 50.5
        rows += series(x, source=str(before))
    monkeypatch.setattr(spikes, "TILE", 300)
    assert found(spark, rows) == [(str(before), i) for before in (1, 2, 3) for i in range(601 - before, 640)]


def test_tiles_are_cut_by_rank(spark, monkeypatch):
    """A far-off place, a narrow stretch, and many rows of one place: tiles bounded, each with rows of its true neighbours."""
    monkeypatch.setattr(spikes, "TILE", 100)
    places = [*range(0, 700, 2), *[700] * 230, *range(10**6, 10**6 + 120), 2**62]
    order = np.random.default_rng(4).permutation(len(places))
    rows = [("lob_records", "s", "d", "price", places[i], int(i), 50.0) for i in order]
    long = spark.createDataFrame(rows, SCHEMA)
    spans = long.groupBy(*spikes.SERIES).agg(F.min("ord").alias("_lo"), F.max("ord").alias("_hi"), F.count("*").alias("_rows"))
    ranked = spikes._ranked(long.join(spans, spikes.SERIES).withColumn("usual", F.lit(None).cast("double")))
    assert [r["row_id"] for r in ranked.orderBy("_rank").collect()] == list(range(len(places)))
    tiles = {}
    for r in spikes._with_halos(ranked).collect():
        tiles.setdefault(r["tile"], {})[r["row_id"]] = r["own"]
    assert sorted(tiles) == list(range(8))
    for t in tiles.values():
        own = sorted(i for i in t if t[i])
        assert 80 <= len(own) <= 100
        assert sorted(t) == list(range(max(own[0] - spikes.HALO, 0), min(own[-1] + spikes.HALO, len(places) - 1) + 1))


def test_uneven_places_change_nothing(spark, monkeypatch):
    x = calm(900, 6)
    x[[100, 301, 650]] += 4
    x[899] -= 4
    rows = [(*r[:4], r[4] if i < 895 else 10**15 + i, *r[5:]) for i, r in enumerate(series(x))]
    whole = found(spark, rows)
    assert whole == [("s", i) for i in (100, 301, 650, 899)]
    monkeypatch.setattr(spikes, "TILE", 300)
    assert found(spark, rows) == whole


def test_tiles_change_nothing_for_sizes_that_drift(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sizes = np.round(100 * 30 ** (np.arange(3000) / 3000) * np.exp(rng.normal(0, 0.2, 3000)))
    lob, bars = sizes.copy(), sizes.copy()
    lob[400:440] = np.round(200 * 15 ** (np.arange(40) / 39))  # usual sizes of the series, far above those of this tile
    lob[[150, 1500, 2900]] = 60_000.0
    bars[[60, 200]] = 1500.0  # above the minutes around, but not above the usual size
    bars[[150, 1500, 2900]] = 90_000.0
    rows = series(lob, field="volume") + series(bars, "minute_bars", "volume", "t")
    whole = found(spark, rows)
    assert whole == [(s, i) for s in "st" for i in (150, 1500, 2900)]
    monkeypatch.setattr(spikes, "TILE", 300)
    assert found(spark, rows) == whole


def test_usual_size_is_the_median_of_the_series(spark):
    rng = np.random.default_rng(9)
    for n in (500, 501):
        x = np.r_[rng.integers(1, 40, n).astype(float), 0.0, -5.0, np.inf, np.nan]
        df = spark.createDataFrame(series(x, field="volume"), SCHEMA)
        spans = df.groupBy(*spikes.SERIES).agg(F.count_if(spikes._sizes()).alias("_sizes"))
        assert spikes._with_usual(df, spans).first()["usual"] == np.median(x[:n])


def test_radii_are_symmetric_in_sign():
    x = np.random.default_rng(0).normal(size=300)
    x[100] = 30
    axes = spikes.ellipsoids([spikes.moments(x, np.ones(300, bool))], 0.0)
    r = spikes.radius(x, *spikes.differences(x), axes)
    assert r[100] > 3 and np.allclose(spikes.radius(-x, *spikes.differences(-x), axes), r)


def test_the_ellipsoids_give_the_verdict(monkeypatch):
    """A size that is no greater than those of a slow swell, but stands alone: its differences leave the ellipsoids, its value does not."""
    x = np.round(1000 * np.exp(np.sin(np.arange(600) * 2 * np.pi / 600)) + np.random.default_rng(3).normal(0, 3, 600))
    x[450] = 2600.0
    rule = spikes.RULES["lob_records", "volume"]
    assert np.flatnonzero(spikes.whole(x, rule, 3.0, 3)).tolist() == [450]
    monkeypatch.setattr(spikes, "radius", lambda value, first, second, axes: np.abs(value) / axes[0])
    assert not spikes.whole(x, rule, 3.0, 3).any()


def test_long_series_in_tiles_have_the_ellipsoids_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.r_[np.round(50 + rng.normal(0, 0.02, 900), 3), np.round(80 + rng.normal(0, 0.6, 700), 3)]  # calm, then restless
    x[[100, 450]] += 1.5  # beyond the calm part's swing, within the whole series'
    x[[700, 1300]] += 15
    x[595:625] = 50.5  # stuck over a border
    whole = found(spark, series(x))
    assert ("s", 700) in whole and ("s", 1300) in whole and ("s", 100) not in whole and ("s", 620) in whole
    for size in (200, 1000):
        monkeypatch.setattr(spikes, "TILE", size)
        assert found(spark, series(x)) == whole
