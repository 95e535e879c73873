"""Evaluation of features against labels: rank correlations, tails, groups, backtests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import average_rank, correlation, pct_rank, quantile_edges, rank_ic, ratio


def summary(values: DataFrame, by: list[str], x: str) -> DataFrame:
    """Count, mean, deviation (n - 1), t, share above zero and share of the mean's sign."""
    stats = values.where(F.col(x).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.avg((F.col(x) > 0).cast("double")).alias("positive"),
        F.avg((F.col(x) < 0).cast("double")).alias("_negative"),
    )
    return stats.select(
        *by, "n", "mean", "std", (ratio(F.col("mean"), F.col("std")) * F.sqrt("n")).alias("t"), "positive",
        F.when(F.col("mean") >= 0, F.col("positive")).otherwise(F.col("_negative")).alias("same_sign"),
    )


def ic_by_time(panel: DataFrame, feature: str, label: str, time: list[str], least: int, distinct: int = 2) -> DataFrame:
    """Rank correlation over the names of each moment."""
    return rank_ic(panel, feature, label, time, least, distinct)


def ic_by_horizon(panel: DataFrame, feature: str, labels: dict[int, str], time: list[str], least: int) -> DataFrame:
    """Rank correlation of a feature with the labels of several horizons at each moment, all ranked in one pass over the panel."""
    long = panel.select(*time, feature, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("_label")) for h, c in labels.items()])))
    return rank_ic(long, feature, "_label", [*time, "horizon"], least)


def ic_by_series(panel: DataFrame, feature: str, label: str, series: list[str], least: int) -> DataFrame:
    """Rank correlation over the time of each series."""
    return rank_ic(panel, feature, label, series, least)


def partial_ic(panel: DataFrame, x: str, y: str, control: str, time: list[str], least: int) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` with ``control`` held: (xy - xz yz) / sqrt((1 - xz^2)(1 - yz^2))."""
    full = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    ranked = full.select(*time, *[average_rank(F.col(c), time).alias(n) for c, n in ((x, "_x"), (y, "_y"), (control, "_z"))])
    pairs = ranked.groupBy(*time).agg(
        F.count(F.lit(1)).alias("n"),
        correlation(F.col("_x"), F.col("_y")).alias("xy"),
        correlation(F.col("_x"), F.col("_z")).alias("xz"),
        correlation(F.col("_y"), F.col("_z")).alias("yz"),
    )
    rest = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    return pairs.where(F.col("n") >= least).select(
        *time, "n", F.when(rest > 1e-9, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(F.when(rest > 0, rest))).alias("ic")
    )


def tails(panel: DataFrame, feature: str, label: str, time: list[str], groups: int, least: int) -> DataFrame:
    """Mean label of the top and bottom ``1 / groups`` by rank, ties kept together, and their spread, at each moment."""
    full = panel.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    ranked = full.select(*time, label, pct_rank(F.col(feature), time).alias("_p"))
    top, bottom = F.col("_p") > 1 - 1 / groups, F.col("_p") <= 1 / groups
    return (
        ranked.groupBy(*time)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(top, F.col(label))).alias("top"), F.avg(F.when(bottom, F.col(label))).alias("bottom"))
        .where(F.col("n") >= least)
        .withColumn("spread", F.col("top") - F.col("bottom"))
    )


def quantile_groups(panel: DataFrame, feature: str, label: str, by: list[str], groups: int) -> DataFrame:
    """Mean label of groups cut at interpolated quantiles of the feature; groups between equal edges are empty and don't come out."""
    full = panel.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    edges = quantile_edges(full, by, feature, [k / groups for k in range(1, groups)])
    group = F.lit(1)
    for k in range(1, groups):
        group = group + (F.col(feature) > F.col(f"_e{k}")).cast("int")
    return (
        full.join(edges, by)
        .groupBy(*by, group.alias("grp"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean_label"))
    )


def extremes(panel: DataFrame, feature: str, time: list[str], name: str, k: int) -> DataFrame:
    """The ``k`` names with the least and the greatest feature of each moment; ties go by name."""
    full = panel.where(F.col(feature).isNotNull())
    low = F.row_number().over(Window.partitionBy(*time).orderBy(F.asc(feature), name))
    high = F.row_number().over(Window.partitionBy(*time).orderBy(F.desc(feature), name))
    ranked = full.select(*time, name, feature, low.alias("_l"), high.alias("_h"))
    return ranked.where((F.col("_l") <= k) | (F.col("_h") <= k)).select(
        *time, name, feature, F.when(F.col("_h") <= k, 1).otherwise(0).alias("is_top")
    )


def correlations(panel: DataFrame, columns: list[str], time: list[str], least: int) -> DataFrame:
    """Mean over time of the cross-section correlation of each pair of columns, in one pass over wide rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = panel.groupBy(*time).agg(
        F.count(F.lit(1)).alias("n"), *[correlation(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs]
    ).where(F.col("n") >= least)
    means = wide.agg(*[F.avg(f"`{a}|{b}`").alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return means.select(F.inline(rows))


def long_short(panel: DataFrame, feature: str, label: str, time: list[str], name: str, k: int, fee: float, order: list[Column]) -> DataFrame:
    """Equal weights long the ``k`` greatest and short the ``k`` least, with turnover between moments and its cost."""
    weights = extremes(panel, feature, time, name, k).select(
        *time, name, F.when(F.col("is_top") == 1, 1.0 / k).otherwise(-1.0 / k).alias("w")
    )
    held = panel.select(*time, name, label).join(weights, [*time, name], "left").fillna(0.0, ["w"])
    w = Window.partitionBy(name).orderBy(*order)
    moved = held.withColumn("_dw", F.abs(F.col("w") - F.coalesce(F.lag("w").over(w), F.lit(0.0))))
    return moved.groupBy(*time).agg(
        F.sum(F.col("w") * F.coalesce(label, F.lit(0.0))).alias("gross"), F.sum("_dw").alias("turnover")
    ).withColumn("net", F.col("gross") - F.col("turnover") * fee)


def break_even(moments: DataFrame, by: list[str]) -> DataFrame:
    """A long-short backtest's moments (gross, turnover, net) summed up, with the fee at which nothing would be left."""
    return moments.groupBy(*by).agg(
        F.count("*").alias("moments"), F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"), F.sum("net").alias("net"),
        ratio(F.sum("gross"), F.sum("turnover")).alias("break_even"),
    )


def shuffled(panel: DataFrame, label: str, time: list[str], name: str, seed: str) -> DataFrame:
    """Labels permuted within each moment, the same way on every run and partitioning: by a digest of name and seed."""
    full = panel.where(F.col(label).isNotNull())
    ids = F.row_number().over(Window.partitionBy(*time).orderBy(name))
    drawn = F.row_number().over(Window.partitionBy(*time).orderBy(F.md5(F.concat_ws("|", name, F.lit(seed))), name))
    left = full.drop(label).withColumn("_i", ids)
    right = full.select(*time, F.col(label), drawn.alias("_i"))
    return left.join(right, [*time, "_i"]).drop("_i")


def renamed(panel: DataFrame, label: str, time: list[str], name: str, seed: str) -> DataFrame:
    """Each name with the labels of another one at the same moments, the same other one throughout: a permutation of the names by a
    digest of name and seed. Moments at which the other one has no label are left out."""
    names = panel.select(name).distinct()
    # the names themselves, not their rows: as many as there are symbols
    place = names.select(name, F.row_number().over(Window.orderBy(name)).alias("_i"))
    drawn = names.select(F.col(name).alias("_other"), F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", name, F.lit(seed))), name)).alias("_i"))
    mapped = panel.drop(label).join(place.join(drawn, "_i").drop("_i"), name)
    return mapped.join(panel.where(F.col(label).isNotNull()).select(*time, F.col(name).alias("_other"), label), [*time, "_other"]).drop("_other")


def lagged(panel: DataFrame, feature: str, series: list[str], order: str, lags: tuple[int, ...]) -> DataFrame:
    """The panel once for each lag, ``lag`` rows, with the feature as it was so many rows before within its series."""
    w = Window.partitionBy(*series).orderBy(order)
    staged = panel.withColumns({f"_l{k}": F.lag(feature, k).over(w) for k in lags})
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias(feature)) for k in lags])
    return staged.select(*[c for c in panel.columns if c != feature], F.inline(rows))


def curves(groups: DataFrame, day: str, a_year: int = 240) -> DataFrame:
    """Growth of each quantile group (day, grp, mean_label) and of the last less the first, with its ratio of mean to deviation a year: day, grp
    (0 for the difference), growth; ratio on every row of a group."""
    last, first = F.max(F.struct("grp", "mean_label")), F.min(F.struct("grp", "mean_label"))
    spread = groups.groupBy(day).agg((last["mean_label"] - first["mean_label"]).alias("mean_label")).select(day, F.lit(0).alias("grp"), "mean_label")
    every = groups.select(day, "grp", "mean_label").unionByName(spread)
    w, run = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return every.select(
        day, "grp", F.exp(F.sum(F.log1p("mean_label")).over(run)).alias("growth"),
        (ratio(F.avg("mean_label").over(w), F.stddev_samp("mean_label").over(w)) * a_year**0.5).alias("yearly"),
    )


def gram(panel: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Sums of products of each pair of columns over complete rows, in one pass: what a linear fit needs of the data.

    Columns: by, ``a``, ``b``, ``n``, ``product``; a pair comes once, with itself too.
    """
    full = panel
    for c in columns:
        full = full.where(F.col(c).isNotNull())
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return sums.select(
        *by, "n", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("product")) for a, b in pairs]))
    )


def walk_forward(panel: DataFrame, features: list[str], label: str, day: str, penalty: float, least: int, embargo: int = 1) -> DataFrame:
    """Ridge weights for each day from all days before it but the last ``embargo``: day, ``feature``, ``weight``. No intercept;
    the penalty is ``penalty`` times the number of rows.

    The sums of products are made a day at a time and run on over the days as a window, so each row of the data is read
    once; only the solution of a system as large as the features is left to Python, a day a row.
    """
    columns = [*features, label]
    ranked = panel.select(day, *[F.col(c) for c in columns])
    sums = gram(ranked, columns, [day])
    before = Window.partitionBy("a", "b").orderBy(day).rowsBetween(Window.unboundedPreceding, -1 - embargo)
    past = sums.withColumns({"_p": F.sum("product").over(before), "_n": F.sum("n").over(before)}).where(F.col("_n") >= least)
    rows = past.groupBy(day).agg(F.max("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "a", "b"), "_p"))).alias("p"))

    def solve(batches):
        for pdf in batches:
            out = []
            for when, n, p in zip(pdf[day], pdf["n"], pdf["p"], strict=True):
                p = dict(p)
                get = lambda a, b: p.get(f"{a}|{b}", p.get(f"{b}|{a}"))  # noqa: B023, E731
                x = np.array([[get(a, b) for b in features] for a in features]) + np.eye(len(features)) * penalty * n
                w = np.linalg.solve(x, np.array([get(a, label) for a in features]))
                out += [(when, f, float(v)) for f, v in zip(features, w, strict=True)]
            yield pd.DataFrame(out, columns=[day, "feature", "weight"])

    return rows.mapInPandas(solve, f"`{day}` {dict(panel.dtypes)[day]}, feature string, weight double")
