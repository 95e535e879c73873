"""Guarded statistics and ranks as columns. Missing is null; a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def imbalance(buy: Column, sell: Column) -> Column:
    """``(buy - sell) / (buy + sell)``."""
    return ratio(buy - sell, buy + sell)


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def average_rank(x: Column, within: list[str], descending: bool = False) -> Column:
    """Rank from 1 with ties at their average, among rows with a value."""
    order = F.desc(x) if descending else F.asc(x)
    w = Window.partitionBy(*within, x.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*within, x))
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(order)) + (ties - 1) / 2.0)


def pct_rank(x: Column, within: list[str]) -> Column:
    """Average rank as a share of the rows with a value."""
    return average_rank(x, within) / F.count(x).over(Window.partitionBy(*within))


def zscore(x: Column, within: list[str]) -> Column:
    """Distance from the mean in deviations (n - 1); a deviation of zero counts as one, a single row has none."""
    w = Window.partitionBy(*within)
    deviation = F.stddev_samp(x).over(w)
    return (x - F.avg(x).over(w)) / F.when(deviation == 0, 1.0).otherwise(deviation)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate of centred moments, at any scale; null where either side is constant. Rows with a null are left out."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_ic(df: DataFrame, x: str, y: str, within: list[str], least: int, distinct: int = 2) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` in each cross-section with at least ``least`` complete rows: within, n, ic.

    Cross-sections with fewer than ``distinct`` values of ``x`` or two of ``y`` are left out; each of n equal values is
    the n-th part of a distinct one, so the ties that the ranks need count them without a sort of their own.
    """
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    share = lambda c: 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*within, c))
    ranked = full.select(
        *within, average_rank(F.col(x), within).alias("_rx"), average_rank(F.col(y), within).alias("_ry"), share(x).alias("_dx"), share(y).alias("_dy")
    )
    return (
        ranked.groupBy(*within)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(correlation(F.col("_rx"), F.col("_ry")), 12).alias("ic"),  # a correlation of zero has no sign
            F.round(F.sum("_dx")).alias("_dx"),
            F.round(F.sum("_dy")).alias("_dy"),
        )
        .where((F.col("n") >= least) & (F.col("_dx") >= distinct) & (F.col("_dy") >= 2))
        .select(*within, "n", "ic")
    )


def quantile_edges(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Quantiles of ``value`` by group, interpolated between its neighbours: ``by`` and ``_e1``, ``_e2`` and so on, one for each of ``shares``.

    Exact for groups of any size: equal values are counted before the shuffle, the counts run up in order of value by a sort that
    spills, and the values at the places wanted are picked, so no group's values are ever held together. Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    run = counts.withColumns({"_below": F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    picks = {}
    for k, share in enumerate(shares, 1):
        place = F.lit(share) * (F.col("_all") - 1)
        for name, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks[f"_{name}{k}"] = F.min(F.when(F.col("_below") > at, F.col("_v")))
    picked = run.groupBy(*by).agg(F.max("_all").alias("_all"), *[c.alias(n) for n, c in picks.items()])
    part = lambda share: F.lit(share) * (F.col("_all") - 1) - F.floor(F.lit(share) * (F.col("_all") - 1))
    return picked.select(
        *by, *[(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * part(share)).alias(f"_e{k}") for k, share in enumerate(shares, 1)]
    )


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that results of differently ordered sums are equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
