import random

from tapeline.operators.compare import Field, differences

SCHEMA = "k string, v double, n long, c int"
FIELDS = [Field("v", tolerance=0.005), Field("n"), Field("c", unknown=0)]


def brute(a, b):
    x, y = {r[0]: r for r in a}, {r[0]: r for r in b}
    out = []
    for k in {*x, *y}:
        if k not in y:
            out.append((k, "a_only"))
        elif k not in x:
            out.append((k, "b_only"))
        else:
            (_, v, n, c), (_, w, m, d) = x[k], y[k]
            if (v is None) != (w is None) or (v is not None and abs(v - w) > 0.005):
                out.append((k, "v"))
            if n != m:
                out.append((k, "n"))
            if c != d and 0 not in (c, d):  # zero is equal to any, to null too
                out.append((k, "c"))
    return sorted(out, key=str)


def test_against_a_dictionary(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([None, 1.0, 1.0024, 1.0026, 1.0049, 1.0051, 1.01])
    make = lambda: [
        (f"k{i}", value(), rng.choice([None, 1, 2]), rng.choice([None, 0, 1, 2])) for i in range(300) if rng.random() < 0.9
    ] + [(None, 1.0, 1, 1)]
    a, b = make(), make()
    got = differences(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k"], FIELDS).collect()
    assert sorted(((r.k, r.diff) for r in got), key=str) == brute(a, b)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("k", 1.0, 1, 1)], SCHEMA)
    assert differences(none, none, ["k"], FIELDS).collect() == []
    assert [r.diff for r in differences(one, none, ["k"], FIELDS).collect()] == ["a_only"]
    assert [r.diff for r in differences(none, one, ["k"], FIELDS).collect()] == ["b_only"]
