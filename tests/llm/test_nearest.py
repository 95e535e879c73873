import random

from tapeline.llm import nearest

WANTED = "name string, symbol string, trade_date string, ticks long, extra int"
POINTS = "symbol string, trade_date string, ticks long, seqno long, sysid long, name string"


def brute(wanted, points, tolerance):
    out = []
    for name, symbol, day, ticks, _ in wanted:
        near = [
            (abs(p[2] - ticks), p[3], p[4])
            for p in points
            if None not in (symbol, day, ticks, p[2]) and p[:2] == (symbol, day) and abs(p[2] - ticks) <= tolerance
        ]
        if near:
            out.append((name, min(near)[2]))
    return sorted(out)


def run(spark, wanted, points, tolerance=20_000):
    out = nearest.nearest(spark.createDataFrame(wanted, WANTED), spark.createDataFrame(points, POINTS), tolerance, len(points))
    return sorted((r.name, r.sysid) for r in out.collect())


def test_against_all_pairs_with_ties_and_slice_ends(spark):
    rng = random.Random(6)
    edge = nearest.SLICE
    at = lambda: edge * rng.randint(0, 2) + rng.choice([-20_000, -10_000, -1, 0, 1, 5_000, 10_000, 20_000, 40_000])
    wanted = [(f"v{i}", rng.choice(["a", "b", None]), "d", rng.choice([at(), at(), None]), i) for i in range(120)]
    points = [(rng.choice(["a", "b", None]), "d", rng.choice([at(), at(), None]), i, 1000 + i, None) for i in range(150)]
    points += points[:20]
    assert run(spark, wanted, points) == brute(wanted, points, 20_000)


def test_equal_distance_takes_the_smaller_seqno(spark):
    points = [("a", "d", 100, 9, 1, None), ("a", "d", 300, 4, 2, None), ("a", "d", 300, 6, 3, None)]
    assert run(spark, [("v", "a", "d", 200, 0)], points) == [("v", 2)]
    assert run(spark, [("v", "a", "d", 20_301, 0)], points) == []
    assert run(spark, [], points) == [] == run(spark, [("v", "a", "d", 200, 0)], [])


def test_one_candidate_of_a_tick_is_sent(spark):
    points = [("a", "d", 100, seqno, 10 * seqno, None) for seqno in [9, 4, 6] * 50] + [("a", "d", 100, None, 1, None)]
    sent = nearest.first_of_tick(spark.createDataFrame(points, POINTS)).collect()
    assert [(r.ticks, r.seqno, r.sysid) for r in sent] == [(100, 4, 40)]
    assert run(spark, [("v", "a", "d", 200, 0)], points) == [("v", 40)]


def test_spellings_and_missing_clocks(spark):
    specs = [
        ("v1", "sz", " 1 ", "20200101", "36000000.5", None, None), ("v2", "SZ", "000001", "20200101", "10:00:00.0005", 36000.0005, None),
        ("v2", "SZ", "000001", "20200101", "10:00:00.0005", 36000.0005, None), ("v3", "sz", "000002", "20200101", None, None, None),
    ]
    feed = [
        ("000001", "20200101", 5, 0, 7_000_000_000_042, "10:00:01.000", None), ("000001", "20200101", 6, 1, 43, "10:00:00.000", 36000.0),
    ]
    out = nearest.order_matches(
        spark.createDataFrame(specs, "dispid string, market string, symbol string, trade_date string, t0s string, t0 double, loaded_at timestamp"),
        spark.createDataFrame(feed, "symbol string, trade_date string, seqno long, actiontype int, sysid long, hms string, timeseconds double"),
        len(feed),
    ).collect()
    assert sorted((r.dispid, r.sysid) for r in out) == [("v1", 42), ("v2", 42)]
