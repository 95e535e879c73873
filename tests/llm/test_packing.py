import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from tapeline.llm import corpus, packing


def test_best_two_fit_keeps_capacity_and_all_items():
    rng = random.Random(1)
    for capacity in (10, 97, 1024):
        sizes = np.array([rng.randint(1, capacity) for _ in range(500)])
        bins = packing.best_two_fit(sizes, capacity)
        assert sorted(x for b in bins for x in b) == sorted(sizes.tolist())
        assert all(sum(b) <= capacity for b in bins)
        assert len(bins) <= -(-sizes.sum() // capacity) * 1.25 + 1  # items of up to a whole container
    small = np.array([rng.randint(1, 50) for _ in range(2000)])
    assert len(packing.best_two_fit(small, 100)) <= -(-small.sum() // 100) + 1


def test_two_replace_the_smallest():
    # greedy leaves 6 + 3 with a gap of 1; 2 + 2 fill what 3 leaves
    assert sorted(map(sorted, packing.best_two_fit(np.array([6, 3, 2, 2]), 10))) == [[2, 2, 6], [3]]


def test_shard_splits_only_what_exceeds_the_capacity():
    ids, sizes = np.array([1, 1, 2, 3, 4]), np.array([25, 10, 0, 7, 3])
    out = packing.pack_shard(ids, sizes, 10)
    assert out["n_tokens"].sum() == sizes.sum()
    assert (out.groupby("container")["n_tokens"].sum() <= 10).all()
    assert len(out[out.doc_id == 2]) == len(out[out.doc_id == 3]) == len(out[out.doc_id == 4]) == 1
    assert len(out[out.doc_id == 1]) == 4


@pytest.mark.skipif(not Path(corpus.rank_file("byte_bpe_50k")).exists(), reason="no tokenizer files")
def test_documents_into_containers(spark):
    texts = [None, "", "one two three " * 40, "word", "word", "x " * 3]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, container string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 16), (2, "byte_bpe_multi_50k", 64)], "spec_id int, tokenizer string, capacity long")
    rows = packing.pack(docs, specs, len(texts)).collect()
    capacity, held, documents = {1: 16, 2: 64}, defaultdict(int), defaultdict(set)
    for r in rows:
        held[r.spec_id, r.container] += r.n_tokens
        documents[r.spec_id].add(r.doc_id)
    assert all(n <= capacity[s] for (s, _), n in held.items())
    assert documents == {1: set(range(6)), 2: set(range(6))}
    assert packing.pack(docs.limit(0), specs, 0).collect() == []
    assert packing.pack(docs, specs.limit(0), 6).collect() == []


def test_totals_see_what_is_wrong(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    specs = spark.createDataFrame([(1, 10)], "spec_id int, capacity long")
    good = [(1, "a", 0, 0, 0, 10), (1, "b", 0, 1, 10, 4), (1, "b", 1, 0, 0, 6), (1, "c", 2, 0, 0, 3), (1, "c", 3, 0, 0, 3), (1, "c", 4, 0, 0, 0)]
    run = lambda rows: tuple(packing.totals(spark.createDataFrame(rows, packing.PACKED), docs, specs).first())
    assert run(good) == (1, 5, 0, 0, 0, 0)
    assert run(good[:-1]) == (1, 4, 1, 0, 0, 0)
    bad = [*good[:1], (1, "b", 0, 1, 11, 4), (1, "c", 1, 0, 0, 4), (1, "c", 1, 1, 4, 2), (1, "c", 2, 0, 0, 9), *good[4:]]
    assert run(bad) == (1, 5, 0, 1, 1, 1)
