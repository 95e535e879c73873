import random
import threading

import pytest

from tapeline.operators import changefeed

FEED = (
    "feed_id long, symbol string, trade_date string, seqno long, actiontype int, sysid long, buyid long, sellid long, volume long, extra string"
)


def brute(rows):
    live, done = {}, set()
    for r in sorted(rows, key=lambda r: (r[1] or "", r[2] or "", r[3], r[4])):
        _, symbol, day, seq, act, sysid, buy, sell, volume, _ = r
        if (symbol, day, seq, act) in done:
            continue
        done.add((symbol, day, seq, act))
        ids = [sysid] if act < 2 else list(dict.fromkeys([buy, sell]))
        for i in ids:
            key = (symbol, day, i % 10**12 if i > 10**12 else i)
            if act == 0:
                live[key] = [volume, seq]
            elif key in live:
                live[key] = [max(live[key][0] - volume, 0), seq]
            if key in live and live[key][0] <= 0:
                del live[key]
    return sorted((*k, v[1]) for k, v in live.items())


def feed(n, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        act = rng.choice([0, 0, 1, 2])
        prefix = rng.choice([0, 6 * 10**12])
        one = lambda: rng.randint(1, 12) + prefix  # noqa: B023, E731
        rows.append((seq, rng.choice("ab"), "d", seq // 2, act, one() if act < 2 else 0, one() if act == 2 else 0, one() if act == 2 else 0, rng.randint(1, 4) * 100, None))
    seen = {}
    for r in rows:
        seen.setdefault((r[1], r[2], r[3], r[4]), r)
    rows = list(seen.values())
    rows += rng.choices(rows, k=n // 4)
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, FEED)
    return sorted(tuple(r) for r in changefeed.live_orders(df, len(rows), "test-state").collect())


def test_against_a_replay(spark):
    for seed in range(3):
        rows = feed(400, seed)
        assert run(spark, rows) == brute(rows)


def test_tombstones_unknown_orders_nulls_and_empty(spark):
    rows = [
        (0, "a", "d", 1, 0, 7, 0, 0, 100, "x"),
        (1, "a", "d", 2, 1, 7, 0, 0, 500, None),
        (2, "a", "d", 3, 1, 8, 0, 0, 100, None),
        (3, None, "d", 3, 0, 9, 0, 0, 100, None),
        (4, "a", "d", 4, 0, 10, 0, 0, None, None),
    ]
    state = changefeed.upsert(changefeed.order_changes(spark.createDataFrame(rows, FEED)), 5).collect()
    assert sorted((r.sysid, r.left_over, r.deleted) for r in state) == [(7, 0, True), (10, 0, True)]
    assert run(spark, []) == []


def test_copies_of_one_change_become_one_and_the_greatest_volume_counts(spark):
    rows = [(i, "a", "d", 1, 0, 7, 0, 0, volume, None) for i, volume in enumerate([100, 300, 200] * 40)]
    rows += [(i, "a", "d", 2, 1, 7, 0, 0, volume, None) for i, volume in enumerate([10, 40, 20] * 40)]
    changes = changefeed.order_changes(spark.createDataFrame(rows, FEED).repartition(3))
    assert changefeed.distinct_changes(changes).count() == 2
    assert [(r.volume, r.left_over) for r in changefeed.upsert(changes, 1).collect()] == [(300, 260)]


def test_publish_replaces_whole_states(spark, tmp_path):
    path = str(tmp_path / "state")
    for n in (3, 5, 7, 9):
        assert changefeed.publish(spark.range(n), path).count() == n == changefeed.published(spark, path).count()
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == 2  # the current one and the one before


def test_a_reader_never_finds_nothing_while_states_are_replaced(spark, tmp_path):
    path, failed, seen, done = str(tmp_path / "state"), [], set(), threading.Event()
    changefeed.publish(spark.range(1), path)

    def read():
        while not done.is_set():
            try:
                seen.add(changefeed.published(spark, path).count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 8):
        changefeed.publish(spark.range(n), path)
    done.set()
    reader.join()
    assert not failed and seen <= set(range(1, 8))


def test_a_job_that_dies_leaves_the_state_as_it_was(spark, tmp_path):
    path = str(tmp_path / "state")
    changefeed.publish(spark.range(4), path)
    with pytest.raises(Exception):
        changefeed.publish(spark.range(2).selectExpr("assert_true(id > 5)"), path)
    assert changefeed.published(spark, path).count() == 4
