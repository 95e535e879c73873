import random

from tapeline.operators import bars, book
from tapeline.operators import tape as tapes

TAPE = "symbol string, trade_date string, seqno long, actiontype int, market string, direction string, sysid long, buyid long, sellid long, price double, volume long, tradedirection int, ms long"
LOB = "rec_id long, symbol string, trade_date string, seqno long, sysid long, ordertype string, direction string, price double, volume long, bdp1 double, bdv1 long, akp1 double, akv1 long, timeseconds double"


def events(n, seed):
    """Orders with their cancels and trades, of which some are unknown or too large."""
    rng, out = random.Random(seed), []
    for seq in range(n):
        act = rng.choice([0, 0, 1, 2])
        one = lambda: rng.randint(1, max(seq, 2))  # noqa: B023, E731
        ms = 34_200_000 + seq * 20_000
        if act == 0:
            out.append(("s", "d", seq, 0, "sz", rng.choice("BS"), seq, 0, 0, 10 + rng.randint(0, 5) / 100, rng.randint(1, 3) * 100, 0, ms))
        elif act == 1:
            out.append(("s", "d", seq, 1, "sz", "B", one(), 0, 0, 0.0, rng.randint(1, 3) * 100, 0, ms))
        else:
            out.append(("s", "d", seq, 2, "sz", None, 0, one(), one(), 10.0, 100, 0, ms))
    return out


def replay(rows, every_ms):
    """Levels with volume and number of orders at each period's end."""
    live, out, periods = {}, {}, sorted({r[12] // every_ms for r in rows})
    for p in range(periods[0], periods[-1] + 1):
        for r in (r for r in rows if r[12] // every_ms == p):
            ids = [r[6]] if r[3] == 1 else [] if r[3] == 0 else [r[7], r[8]]
            if r[3] == 0:
                live[r[6]] = [r[5], round(r[9] * 100), r[10]]
            for i in ids:
                if i in live:
                    live[i][2] = max(live[i][2] - r[10], 0)
        for side, cents, v in live.values():
            if v:
                level = out.setdefault((p, side, cents), [0, 0])
                level[0] += v
                level[1] += 1
    return out


def test_snapshots_against_a_replay(spark):
    for seed in range(3):
        rows = events(400, seed)
        got = book.snapshots(spark.createDataFrame(rows, TAPE), 100, 900_000).collect()
        last = max(r.period for r in got)
        want = {k: tuple(v) for k, v in replay(rows, 900_000).items() if k[0] <= last}
        assert {(r.period, r.side, r.cents): (r.volume, r.orders) for r in got} == want
        for r in got:
            assert r.level == 1 + sum(1 for o in got if (o.period, o.side) == (r.period, r.side) and (o.cents > r.cents if r.side == "B" else o.cents < r.cents))


def lob_row(i, direction, price, volume, bid=(10.0, 300), ask=(10.02, 200), kind="wt", sysid=None):
    return (i, "s", "d", i, i if sysid is None else sysid, kind, direction, price, volume, *bid, *ask, 36000.0)


def test_six_types_of_orders(spark):
    none = (None, None)
    rows = [
        lob_row(1, "B", 10.03, 200), lob_row(2, "B", 10.02, 200), lob_row(3, "B", 10.03, 100), lob_row(4, "B", 10.01, 100), lob_row(5, "B", 10.0, 100), lob_row(6, "B", 9.0, 100),
        lob_row(11, "S", 9.99, 300), lob_row(12, "S", 10.0, 300), lob_row(13, "S", 10.0, 100), lob_row(14, "S", 10.01, 9), lob_row(15, "S", 10.02, 9), lob_row(16, "S", 11.0, 9),
        lob_row(20, "B", 10.0, 100, none, none), lob_row(25, "B", 10.0, 100, ask=none), lob_row(30, "B", 10.0, 100, none),
    ]
    got = spark.createDataFrame(rows, LOB).select("rec_id", book.aggressiveness().alias("kind")).collect()
    assert {r.rec_id: r.kind for r in got} == {r[0]: (0 if r[0] in (20, 30) else r[0] % 10) for r in rows}


def test_prices_that_can_not_be_true_are_repaired(spark):
    rows = [
        lob_row(1, "B", 10.01, 100), lob_row(2, "B", 0.0, 100, kind="cl", sysid=1), lob_row(3, "S", float("nan"), 100, kind="cl", sysid=99),
        lob_row(4, "B", -1.0, 100), lob_row(5, "S", None, 100, bid=(None, None), kind="zb"), lob_row(6, "S", 10.0, 100, kind="zb"),
    ]
    got = {r.rec_id: r.price for r in book.repaired_prices(spark.createDataFrame(rows, LOB)).collect()}
    assert got == {2: 10.01, 3: 10.0, 4: 10.02, 5: None}


def test_slots_take_stragglers_and_leave_none_out(spark):
    trade = lambda seq, ms: ("s", "d", seq, 2, "sz", None, 0, 1, 2, 10.0 + seq / 100, 100, 0, ms)
    rows = [trade(0, 34_199_000), trade(1, 34_200_000), trade(2, 34_259_999), trade(3, 41_405_000), trade(4, 46_800_000), trade(5, 54_000_100)]
    slots = bars.trade_slots(spark.createDataFrame(rows, TAPE), 60_000)
    assert {r.slot: r.n for r in slots.collect()} == {34_260_000: 2, 41_400_000: 1, 46_860_000: 1, 54_000_000: 1}
    every = bars.every_slot(slots, 60_000).orderBy("slot").collect()
    assert len(every) == 240 and every[1].last == every[0].last == 1002 and every[1].n == 0 and every[1].flag == 2 and every[0].flag == 0
    assert every[-1].flag == 1 and every[-1].day_volume == 500 and every[-2].flag == 1
    assert bars.every_slot(slots.limit(0), 60_000).collect() == []


def test_life_times_leave_the_break_out(spark):
    rows = [
        ("s", "d", 0, 0, "sz", "B", 1, 0, 0, 10.0, 100, 0, 41_000_000), ("s", "d", 1, 0, "sz", "S", 2, 0, 0, 10.0, 100, 0, 47_000_000),
        ("s", "d", 2, 2, "sz", None, 0, 1, 2, 10.0, 50, 0, 47_000_000), ("s", "d", 3, 1, "sz", "B", 1, 0, 0, 0.0, 50, 0, 47_000_500), ("s", "d", 4, 1, "sz", "B", 9, 0, 0, 0.0, 50, 0, 47_000_500),
    ]
    got = {r.seqno: r.life_ms for r in book.life_times(spark.createDataFrame(rows, TAPE)).collect()}
    assert got == {0: 0, 1: 600_000, 2: 600_000, 3: 600_500, 4: None}
    assert tapes.ENDS[0] < tapes.AFTERNOON[0]
