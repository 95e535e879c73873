import random

from tapeline.operators import auction

SCHEMA = "k string, id long, side string, cents long, volume long"


def brute(orders):
    """Clears, then matches order by order."""
    best = None
    for p in sorted({o[3] for o in orders}):
        demand, supply = sum(o[4] for o in orders if o[2] == "B" and o[3] >= p), sum(o[4] for o in orders if o[2] == "S" and o[3] <= p)
        rank = (min(demand, supply), -abs(demand - supply), p)
        best = max(best, rank) if best else rank
    executed = best[0] if best else 0
    buys = sorted([[-o[3], o[1], o[4]] for o in orders if o[2] == "B"])
    sells = sorted([[o[3], o[1], o[4]] for o in orders if o[2] == "S"])
    pairs, rest = 0, executed
    while rest and buys and sells:
        take = min(rest, buys[0][2], sells[0][2])
        pairs, rest = pairs + 1, rest - take
        for side in (buys, sells):
            side[0][2] -= take
            if not side[0][2]:
                side.pop(0)
    left = {}
    for name, side in (("B", buys), ("S", sells)):
        levels = {}
        for p, _, v in side:
            levels[abs(p)] = levels.get(abs(p), 0) + v
        left[name] = sorted(levels.items(), key=lambda x: -x[0] if name == "B" else x[0])[:3]
    return executed, best[2] if executed else None, pairs, left


def test_against_matching_order_by_order(spark):
    rng = random.Random(6)
    books = {f"k{i}": [(f"k{i}", j, rng.choice("BS"), rng.randint(995, 1005), rng.randint(1, 5) * 100) for j in range(rng.randint(1, 40))] for i in range(40)}
    books["one"] = [("one", 0, "B", 1000, 100)]
    df = spark.createDataFrame([o for b in books.values() for o in b], SCHEMA)
    stats = {r.k: r for r in auction.statistics(df, ["k"]).collect()}
    left = {}
    for r in auction.residual(df, ["k"]).orderBy("level").collect():
        left.setdefault((r.k, r.side), []).append((r.cents, r.volume))
    for k, orders in books.items():
        executed, price, pairs, rest = brute(orders)
        assert (stats[k].executed, stats[k].clear_cents, stats[k].pairs) == (executed, price, pairs)
        assert all(left.get((k, s), []) == rest[s] for s in "BS")
        if price:
            assert stats[k].better_buy == sum(o[4] for o in orders if o[2] == "B" and o[3] > price)
            assert stats[k].executable_for_buy == sum(o[4] for o in orders if o[2] == "S" and o[3] <= price)


def test_no_orders(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert auction.statistics(none, ["k"]).collect() == auction.residual(none, ["k"]).collect() == []
