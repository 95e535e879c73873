"""Documents into containers of fixed capacity: best-two-fit.

Documents are spread by hash over shards of about ``PER_SHARD``; each shard and
specification is packed by itself, so packing is as parallel as the corpus is large, and
what sharding costs is the last, part-filled containers of each shard.

A container is opened with the largest document left and filled greedily, each time
with the largest that fits. Then its smallest document gives way to two unpacked ones
that fill the gap it leaves more tightly, the tightest two there are, as long as there are any.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.corpus import TOKENIZERS, token_counts
from tapeline.session import buckets

PER_SHARD = 20_000

PACKED = "spec_id int, container string, doc_id long, piece int, start_token long, n_tokens long"


class _Stock:
    """Unpacked sizes: how many of each, and one bit a size that is there, so that the largest up to a bound is one shift away."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.left = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.there = 0
        for size, n in enumerate(self.left):
            if n and size:
                self.there |= 1 << size

    def largest(self, most: int) -> int:
        """The largest size up to ``most``; 0 if there is none."""
        return (self.there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.there & ((1 << (most + 1)) - 1) else 0

    def take(self, size: int) -> None:
        self.left[size] -= 1
        if not self.left[size]:
            self.there &= ~(1 << size)

    def give(self, size: int) -> None:
        self.left[size] += 1
        self.there |= 1 << size

    def tightest_two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Two sizes whose sum is the greatest up to ``room``, if it is above ``more_than``."""
        best, pair = more_than, None
        a = self.largest(room - 1)
        while a and 2 * a > best:
            b = self.largest(min(room - a, a))
            if b == a and self.left[a] < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = self.largest(a - 1)
        return pair


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; every size is at most ``capacity`` and above 0."""
    stock, out = _Stock(sizes, capacity), []
    while stock.there:
        first = stock.largest(capacity)
        stock.take(first)
        held, gap = [first], capacity - first
        while size := stock.largest(gap):
            stock.take(size)
            held.append(size)
            gap -= size
        while gap:
            smallest = held[-1]
            pair = stock.tightest_two(gap + smallest, smallest)
            if not pair:
                break
            stock.give(smallest)
            held.pop()
            for size in pair:
                stock.take(size)
                held.append(size)
                gap -= size
            gap += smallest
            held.sort(reverse=True)
        out.append(held)
    return out


def pack_shard(doc_id: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """Containers of one shard: container (a number), doc_id, piece, start_token, n_tokens.

    A document larger than the capacity is split into pieces that fill a container each and a rest, which is packed like any
    other; an empty one takes no room and goes into the first container.
    """
    full, rest = sizes // capacity, sizes % capacity
    whole = np.repeat(np.arange(len(sizes)), full)
    piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    packed = [(np.arange(len(whole)), whole, piece, np.full(len(whole), capacity))]
    some = np.flatnonzero(rest > 0)
    waiting: dict[int, list[int]] = {}
    for i in some[::-1]:
        waiting.setdefault(int(rest[i]), []).append(int(i))
    number, place = [], []
    for k, held in enumerate(best_two_fit(rest[some], capacity), len(whole)):
        for size in held:
            number.append(k)
            place.append(waiting[size].pop())
    place_, number_ = np.array(place, np.int64), np.array(number, np.int64)
    packed.append((number_, place_, full[place_], rest[place_]))
    empty = np.flatnonzero(sizes == 0)
    packed.append((np.zeros(len(empty), np.int64), empty, np.zeros(len(empty), np.int64), np.zeros(len(empty), np.int64)))
    number, at, piece, n = (np.concatenate(x) for x in zip(*packed, strict=True))
    return pd.DataFrame(
        {"container": number, "doc_id": doc_id[at], "piece": piece, "start_token": piece * capacity, "n_tokens": n}
    )


def pack(documents: DataFrame, pack_specs: DataFrame, rows: int, folder: str = TOKENIZERS) -> DataFrame:
    """Every document assigned to containers of each specification.

    ``rows``, the number of documents, sizes the shards. The specifications are a fixed handful and are read by the driver.
    A row with a null or empty text has no tokens and is in a container all the same. Repeated rows are packed each.
    """
    specs = pack_specs.select("spec_id", "tokenizer", "capacity").distinct().collect()
    names = sorted({s.tokenizer for s in specs})
    if not specs:
        return documents.sparkSession.createDataFrame([], PACKED)
    capacity = {s.spec_id: s.capacity for s in specs}
    items = (
        token_counts(documents, names, folder)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(buckets(rows, PER_SHARD))).cast("int"))
        .select(
            "doc_id",
            "shard",
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(s.spec_id).cast("int").alias("spec_id"), F.col("sizes")[names.index(s.tokenizer)].alias("size"))
                        for s in specs
                    ]
                )
            ),
        )
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        spec, shard = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["doc_id", "size"], kind="stable")
        out = pack_shard(pdf["doc_id"].to_numpy(), pdf["size"].to_numpy("int64"), capacity[spec])
        out["spec_id"] = spec
        out["container"] = f"{spec}-{shard}-" + out["container"].astype(str)
        return out[["spec_id", "container", "doc_id", "piece", "start_token", "n_tokens"]]

    return items.groupBy("spec_id", "shard").applyInPandas(run, PACKED)


def totals(packed: DataFrame, documents: DataFrame, pack_specs: DataFrame) -> DataFrame:
    """Accounts of a packing (of documents with an id each): spec_id, ``documents`` in it, and how many documents are ``missing`` or
    ``broken`` (their pieces don't follow one another from the first token to the last), containers ``overfull``, documents ``split_though_fitting``.

    One pass over pieces by document and one by container.
    """
    capacity = {r.spec_id: r.capacity for r in pack_specs.select("spec_id", "capacity").distinct().collect()}  # a fixed handful
    most = F.create_map(*[F.lit(x) for pair in capacity.items() for x in pair])[F.col("spec_id")]
    pieces = packed.groupBy("spec_id", "doc_id").agg(
        F.count("*").alias("n"),
        F.sum("n_tokens").alias("tokens"),
        F.max(F.col("start_token") + F.col("n_tokens")).alias("end"),
        F.min("start_token").alias("start"),
        F.max("piece").alias("last"),
    )
    wanted = documents.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(s).cast("int") for s in capacity])).alias("spec_id"))
    whole = (F.col("start") == 0) & (F.col("tokens") == F.col("end")) & (F.col("last") + 1 == F.col("n"))
    by_document = (
        wanted.join(pieces, ["spec_id", "doc_id"], "left")
        .groupBy("spec_id")
        .agg(
            F.count("n").alias("documents"),
            F.count_if(F.col("n").isNull()).alias("missing"),
            F.count_if(~whole).alias("broken"),
            F.count_if((F.col("n") > 1) & (F.col("tokens") <= most)).alias("split_though_fitting"),
        )
    )
    held = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("held"))
    by_container = held.groupBy("spec_id").agg(F.count_if(F.col("held") > most).alias("overfull"))
    return by_document.join(by_container, "spec_id", "left").select(
        "spec_id", "documents", "missing", "broken", F.coalesce("overfull", F.lit(0)).alias("overfull"), "split_though_fitting"
    )
