import base64
import random
from pathlib import Path

import numpy as np
import pytest

from tapeline.llm import bpe, corpus

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")
pytestmark = pytest.mark.skipif(not Path(corpus.rank_file(NAMES[0])).exists(), reason="no tokenizer files")

ODD = [
    "", " ", "\n\n  x", "a" * 97, "word's  WORD 123 ½ ①", "<|endoftext|> [PAD] </s>", "naïve café é́", "🙂👩‍🔬", "漢字かな交じり文。", "ภาษาไทยไม่มีช่องว่าง",
    "x\x1cy\x85z  　end", "\r\n\t tabs", "ab" * 3000, "\u200b\ufeff", "=" * 50, "हिन्दी में", "العربية",
]


def reference(name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(corpus.rank_file(name)).read_bytes().splitlines())}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_library_and_decode_again(name):
    own, other = bpe.encoder(corpus.rank_file(name)), reference(name)
    rng = random.Random(4)
    parts = ["a", "aa", "the", " ", "\n", "0", "é", "ก", "漢", "😀", "'s", "\xa0", "́", "ing", "==", "_"]
    for text in ODD + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(1500)]:
        ids = np.frombuffer(own.encode(text), np.int32).tolist()
        assert ids == other.encode_ordinary(text)
        assert own.automaton.decode(ids).decode("utf-8") == text
        assert own.count(bpe.pieces(text)) == len(ids)


def test_a_small_automaton_against_merging_by_rank():
    ranks = {bytes([c]): i for i, c in enumerate(b"ab")} | {b"ab": 2, b"aa": 3, b"aab": 4, b"abab": 5, b"aaaa": 6}
    automaton = bpe.MergeAutomaton(ranks)

    def merge(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(1, 11):
        for k in range(2**n):
            word = bytes(b"ab"[k >> i & 1] for i in range(n))
            assert automaton.encode(word) == merge(word), word


def test_query_over_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Hello world", 9), (1, "Hello world", 9), (2, None, 9), (3, "", 9), (None, "x", 9)]
    out = corpus.token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in out) == [("1", 2), ("1", 2), ("2", 0), ("3", 0), ("None", 1)]
    assert corpus.token_ids(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_tables_hold_exactly_the_pairs_that_no_merge_changes():
    """Walks the compiled tables: an arc leaves a state if and only if the two tokens, put together, are encoded as the two."""
    name = NAMES[0]
    automaton, other = bpe.encoder(corpus.rank_file(name)).automaton, reference(name)
    assert len(automaton.rows) < 20_000 and sum(map(len, automaton.rows.values())) < 1_000_000
    assert sorted(automaton.number.values()) == list(range(len(automaton.labels))[: len(automaton.number)])
    rng = random.Random(9)
    words = sorted(automaton.leads, key=lambda r: automaton.labels[r])
    short = [r for r in words if len(automaton.labels[r]) <= 2]
    arcs = 0
    for _ in range(20_000):
        x, y = rng.choice(rng.choice((words, short))), rng.choice(rng.choice((words, short)))
        leaves = automaton.arc(x, y)
        arcs += leaves
        assert leaves == (other._encode_single_piece(automaton.labels[x] + automaton.labels[y]) == [x, y])
    assert 1_000 < arcs < 19_999
    for token in rng.sample(words, 500):  # the byte table spells each arc's label
        node = 0
        for byte in automaton.labels[token]:
            node = automaton.step[node << 8 | byte]
        assert automaton.ends_at[node] == token
