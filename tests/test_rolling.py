import datetime as dt
import random

from tapeline.operators import rolling


def brute(rows, spans):
    out = {}
    for e in {r[0] for r in rows}:
        days = {r[1]: r[2] for r in rows if r[0] == e and r[2] is not None}
        if not days:
            continue
        d = min(days)
        while d <= max(days):
            for s in spans:
                hit = [days[x] for x in days if 0 <= (d - x).days < s]
                out[e, d, s] = (round(sum(hit), 6), round(sum(hit) / s, 6), len(hit))
            d += dt.timedelta(1)
    return out


def test_against_sums_with_gaps_over_tiles(spark):
    rng = random.Random(1)
    start = dt.date(2020, 11, 1)
    rows = []
    for e in ("a", "b", None and "c", "c"):
        if e is None:
            continue
        for k in sorted(rng.sample(range(900), 60)):
            rows.append((e, start + dt.timedelta(k), rng.choice([None, 0.0, rng.uniform(-5, 5)])))
    df = spark.createDataFrame(rows, "who string, day date, v double")
    got = rolling.rolling(df, "who", "day", "v", (7, 30), 3).collect()
    assert {(r.who, r.asof, r.span): (round(r.total, 6), round(r.average, 6), r.active) for r in got} == brute(rows, (7, 30))


def test_empty(spark):
    df = spark.createDataFrame([], "who string, day date, v double")
    assert rolling.rolling(df, "who", "day", "v", (7,), 0).collect() == []


def test_latest_load_of_a_day_counts(spark):
    t = dt.datetime(2022, 1, 1)
    rows = [
        ("s", "20220101", 1.0, t, 0), ("s", "2022-01-01", None, t + dt.timedelta(1), 0),
        ("s", "20220102", None, t, 0), ("s", "20220102", 3.0, t + dt.timedelta(1), 0), ("s", "nonsense", 9.0, t, 0),
    ]
    got = rolling.daily_net(spark.createDataFrame(rows, "strat string, date string, net double, loaded_at timestamp, day int")).collect()
    assert sorted((str(r.day), r.net) for r in got) == [("2022-01-01", None), ("2022-01-02", 3.0)]


def test_infinities_stay_in_their_spans(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(k) for k in range(30)]
    rows = [("a", d, 1.0) for d in days] + [("b", d, 2.0) for d in days]
    rows[10], rows[15] = ("a", days[10], float("inf")), ("a", days[15], float("-inf"))
    got = {(r.who, r.asof): r.total for r in rolling.rolling(spark.createDataFrame(rows, "who string, day date, v double"), "who", "day", "v", (7,), 2).collect()}
    want = [7.0 if k >= 6 else k + 1.0 for k in range(30)]
    for k in range(30):
        up, down = 10 <= k < 17, 15 <= k < 22
        a = got["a", days[k]]
        assert a is None if up and down else a == (float("inf") if up else float("-inf") if down else want[k])
        assert got["b", days[k]] == 2 * want[k]
