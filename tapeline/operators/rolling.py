"""Totals and averages over trailing days, days without activity included.

Entities are hashed into blocks and days cut into tiles. A block and tile is one
dense matrix of entities by days, with a halo of the preceding days that the longest
span needs; one product with a banded matrix gives a span's totals for all its
entities and days at once, a second the number of active days. An active day is sent
to its own tile and, if the next tile's halo holds it, to that one too, so no task
needs more than ``ENTITIES`` entities of ``TILE_DAYS`` days, whatever an entity's history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.clean import bar_ns, finite
from tapeline.session import buckets

TILE_DAYS = 256
ENTITIES = 256


def banded(days: int, halo: int, span: int) -> np.ndarray:
    """The (halo + days) x days matrix whose column d sums the ``span`` days that end with day d of the tile."""
    row, column = np.arange(halo + days)[:, None], np.arange(days)[None, :]
    end = column + halo
    return ((row <= end) & (row > end - span)).astype("float64")


def rolling(daily: DataFrame, entity: str, day: str, value: str, spans: tuple[int, ...], entities: int) -> DataFrame:
    """For each entity, each calendar day from its first to its last active one and each span: total, average, active days.

    ``daily`` has at most one row an entity and day, ``day`` as a date. A row with a null value is no activity; an
    entity without any has no rows. ``total`` is 0 and ``average`` 0 where the span has no active day; ``average`` divides
    by the span's calendar days, also those before the first active one. Columns: entity, ``asof``, ``span``, ``total``,
    ``average``, ``active``. ``entities``, how many there are about, sizes the blocks. Infinite values count as they do in a sum: a
    span with one has that total, one with both signs has none (null).
    """
    halo = max(spans) - 1
    if halo >= TILE_DAYS:
        raise ValueError(f"spans of up to {TILE_DAYS} days")
    kind = dict(daily.dtypes)[entity]
    at = daily.where(F.col(value).isNotNull()).select(
        F.col(entity), F.unix_date(F.col(day)).alias("_d"), F.col(value).cast("double").alias("_v")
    )
    extent = at.groupBy(entity).agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    tile = F.floor(F.col("_d") / TILE_DAYS).cast("int")
    points = at.select(
        entity,
        F.explode(
            F.when(
                F.pmod("_d", F.lit(TILE_DAYS)) >= TILE_DAYS - halo, F.array(tile, tile + 1)
            ).otherwise(F.array(tile))
        ).alias("_t"),
        "_d",
        "_v",
        F.lit(None).cast("int").alias("_first"),
        F.lit(None).cast("int").alias("_last"),
    )
    spine = extent.select(
        entity,
        F.explode(F.sequence(F.floor(F.col("_first") / TILE_DAYS).cast("int"), F.floor(F.col("_last") / TILE_DAYS).cast("int"))).alias("_t"),
        F.lit(None).cast("int").alias("_d"),
        F.lit(None).cast("double").alias("_v"),
        "_first",
        "_last",
    )
    grouped = points.unionByName(spine).withColumn("_b", F.pmod(F.xxhash64(entity), F.lit(buckets(entities, ENTITIES, 4))).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(key[1]) * TILE_DAYS
        given = pdf["_first"].notna().to_numpy()
        extents = pdf[given].sort_values(entity, kind="stable")
        data = pdf[~given]
        out: list[tuple] = []
        for lo in range(0, len(extents), ENTITIES):
            part = extents.iloc[lo : lo + ENTITIES]
            names = pd.Index(part[entity])
            place = names.get_indexer(data[entity])
            ours = place >= 0
            column = data["_d"].to_numpy("float64")[ours].astype("int64") - base + halo
            dense, active = np.zeros((len(names), halo + TILE_DAYS)), np.zeros((len(names), halo + TILE_DAYS))
            value = data["_v"].to_numpy("float64")[ours]
            infinite = np.isinf(value)
            dense[place[ours], column] = np.where(infinite, 0.0, value)
            # zero times infinity is no number: infinities are counted by themselves
            signs = [np.zeros_like(dense) for _ in range(2)] if infinite.any() else []
            for sign, there in zip((1, -1), signs):
                there[place[ours][infinite], column[infinite]] = np.sign(value[infinite]) == sign
            active[place[ours], column] = 1.0
            first = np.maximum(part["_first"].to_numpy("int64") - base, 0)
            last = np.minimum(part["_last"].to_numpy("int64") - base, TILE_DAYS - 1)
            days = np.arange(TILE_DAYS)[None, :]
            row, col = np.nonzero((days >= first[:, None]) & (days <= last[:, None]))
            for span in spans:
                band = banded(TILE_DAYS, halo, span)
                counts = (active @ band)[row, col]
                total = np.where(counts > 0, (dense @ band)[row, col], 0.0)
                if signs:
                    up, down = ((there @ band)[row, col] > 0 for there in signs)
                    total = np.select([up & down, up, down], [np.nan, np.inf, -np.inf], total)
                out.append((lo + row, col + base, np.full(len(row), span), total, total / span, counts.astype("int64")))
        names = extents[entity].to_numpy(dtype=object)
        if not out:
            out = [tuple(np.zeros(0, kind) for kind in ("int64", "int64", "int64", "float64", "float64", "int64"))]
        at, asof, span, total, average, counts = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame(
            {entity: names[at], "asof": asof, "span": span, "total": total, "average": average, "active": counts}
        )

    schema = f"`{entity}` {kind}, asof int, span long, total double, average double, active long"
    done = grouped.groupBy("_b", "_t").applyInPandas(run, schema)
    return done.withColumn("asof", F.date_from_unix_date("asof"))


def daily_net(daily_s1: DataFrame) -> DataFrame:
    """One row a strategy and day: the net loaded last. Dates come as ``YYYYMMDD`` or ISO; unreadable ones are left out.

    Ties of ``loaded_at`` go to the row with a net, then to the greater net; a null ``loaded_at`` is the earliest.
    """
    day = F.coalesce(F.try_to_date(F.col("date"), "yyyyMMdd"), F.try_to_date(F.col("date"), "yyyy-MM-dd"))
    return (
        daily_s1.select("strat", day.alias("day"), "net", "loaded_at")
        .where("strat IS NOT NULL AND day IS NOT NULL")
        .groupBy("strat", "day")
        .agg(F.max(F.struct("loaded_at", F.col("net").isNotNull(), F.nanvl("net", F.lit(None).cast("double")).alias("net")))["net"].alias("net"))
    )


def daily_volume(minute_bars: DataFrame) -> DataFrame:
    """Volume of each ticker and UTC day; of rows with the same stamp the one loaded last counts, faulty volumes (not finite or below zero) are none."""
    ns = bar_ns(F.col("profile"), F.col("window_start"))
    last = (
        minute_bars.where("ticker IS NOT NULL")
        .select("ticker", ns.alias("ns"), "volume", "loaded_at", "bar_id")
        .where("ns IS NOT NULL")
        .groupBy("ticker", "ns")
        .agg(F.max(F.struct("loaded_at", "bar_id", "volume"))["volume"].alias("volume"))
    )
    return (
        last.where(finite(F.col("volume")) & (F.col("volume") >= 0))
        .groupBy("ticker", F.to_date(F.timestamp_micros(F.floor(F.col("ns") / 1000).cast("long"))).alias("day"))
        .agg(F.sum("volume").alias("volume"))
    )
