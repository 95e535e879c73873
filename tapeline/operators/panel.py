"""Panels of factors by name and minute: joins, prices carried, labels, ranks as training tables, profiles and groups of names."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import correlation, pct_rank, quantile_edges, ratio
from tapeline.operators.flow import BUCKET, eaten_age, minute_flow
from tapeline.operators.tape import DAY, TRADE, in_sessions

MOMENT = ["trade_date", "sess", "bkt"]
#: Holding periods in rows.
HORIZONS = (1, 2, 4, 8, 15, 30, 60)


def last_prices(tape: DataFrame) -> DataFrame:
    """The last trade's price of each symbol, day, session and minute."""
    trades = in_sessions(tape.where(F.col("actiontype") == TRADE))
    return trades.groupBy(*BUCKET).agg(F.max(F.struct("seqno", "price"))["price"].alias("last_px"))


def flow_panel(tape: DataFrame) -> DataFrame:
    """Two factor panels joined by their key, with the last price carried over minutes without a trade within a session."""
    joined = minute_flow(tape).join(eaten_age(tape), BUCKET).join(last_prices(tape), BUCKET, "left")
    w = Window.partitionBy(*DAY, "sess").orderBy("bkt").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("last_px", F.last("last_px", ignorenulls=True).over(w))


def with_labels(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Returns to the next row (``ret_next``), from the next to the one after (``ret_skip``), and from the next over each horizon.

    Rows of one symbol, day and session follow one another, so no return goes over the midday break.
    """
    w = Window.partitionBy(*DAY, "sess").orderBy("bkt")
    ahead = lambda n: F.lead("last_px", n).over(w)
    labels = {f"ret_{h}": ratio(ahead(1 + h) - ahead(1), ahead(1)) for h in horizons}
    return panel.withColumns({"ret_next": ratio(ahead(1) - F.col("last_px"), F.col("last_px")), "ret_skip": ratio(ahead(2) - ahead(1), ahead(1)), **labels})


def ranked(panel: DataFrame, features: list[str], label: str, moment: list[str]) -> DataFrame:
    """The training table: rows with a label, features and label as shares of their rank at each moment; nulls stay."""
    full = panel.where(F.col(label).isNotNull())
    return full.withColumns({c: pct_rank(F.col(c), moment) for c in features} | {"y_rank": pct_rank(F.col(label), moment)})


def market_means(panel: DataFrame, columns: list[str], moment: list[str]) -> DataFrame:
    """Means over all names at each moment."""
    return panel.groupBy(*moment).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def profiles(panel: DataFrame, name: str, day: str, least: int = 1) -> DataFrame:
    """Each name's medians over days of its daily activity, informedness, order size and cancel share; names with fewer than ``least`` days are left out."""
    daily = panel.groupBy(name, day).agg(
        F.avg("n_ord").alias("activity"), F.avg(F.abs("age_imb")).alias("informed"), F.median("mean_size").alias("size"), F.median("cxl_ratio").alias("cancels")
    )
    middle = [F.median(c).alias(c) for c in ("activity", "informed", "size", "cancels")]
    return daily.groupBy(name).agg(F.count("*").alias("days"), *middle).where(F.col("days") >= least)


def groups(profile: DataFrame, columns: list[str], k: int = 4, seed: int = 7) -> DataFrame:
    """``profile`` with ``grp``, by k-means (MLlib) over the standardised columns; rows with a null are left out."""
    full = profile.dropna(subset=columns)
    wide = VectorAssembler(inputCols=columns, outputCol="_x").transform(full)
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(wide).transform(wide)
    return KMeans(featuresCol="_z", predictionCol="grp", k=k, seed=seed).fit(scaled).transform(scaled).drop("_x", "_z")


def monotonicity(panel: DataFrame, feature: str, label: str, by: list[str], moment: list[str], n: int = 10) -> DataFrame:
    """How steadily the mean label rises with the feature's groups (``n``, cut at quantiles of each ``by``): the rank correlation of group
    and mean, the last group's mean less the first's, each also for the label less its mean at the moment."""
    full = panel.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    full = full.withColumn("_rest", F.col(label) - F.avg(label).over(Window.partitionBy(*moment)))
    edges = quantile_edges(full, by, feature, [k / n for k in range(1, n)])
    group = F.lit(0)
    for k in range(1, n):
        group = group + (F.col(feature) > F.col(f"_e{k}")).cast("int")
    means = full.join(edges, by).groupBy(*by, group.alias("grp")).agg(F.avg(label).alias("raw"), F.avg("_rest").alias("rest"))
    w = Window.partitionBy(*by)
    rank = lambda c: F.rank().over(w.orderBy(c)).cast("double")
    staged = means.withColumns({"_g": rank("grp"), "_r": rank(F.round("raw", 12)), "_d": rank(F.round("rest", 12))})
    ends = lambda c: F.max(F.struct("grp", c))[c] - F.min(F.struct("grp", c))[c]
    return staged.groupBy(*by).agg(
        F.count("*").alias("groups"),
        correlation(F.col("_g"), F.col("_r")).alias("steady_raw"),
        correlation(F.col("_g"), F.col("_d")).alias("steady_rest"),
        ends("raw").alias("spread_raw"),
        ends("rest").alias("spread_rest"),
    )


def matches(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], tolerance: float = 0.01) -> DataFrame:
    """How well two panels agree field by field: rows in both, share of them within the relative ``tolerance``, medians of both sides.

    Each key is at most once in either. A null agrees with a null only. One join, then one aggregation over fields as rows.
    """
    long = lambda df, c: df.select(*key, F.array(*[F.col(f).cast("double") for f in fields]).alias(c))
    pairs = long(a, "_x").join(long(b, "_y"), key)
    rows = pairs.select(F.posexplode(F.arrays_zip("_x", "_y")).alias("_i", "_z")).select("_i", F.col("_z._x").alias("x"), F.col("_z._y").alias("y"))
    near = F.abs(F.col("x") - F.col("y")) / F.when(F.abs("y") > 1e-9, F.abs("y")).otherwise(1.0) < tolerance
    agrees = F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("x").isNull() & F.col("y").isNull()).otherwise(near)
    out = rows.groupBy("_i").agg(F.count("*").alias("n"), F.avg(agrees.cast("double")).alias("share"), F.median("x").alias("median_a"), F.median("y").alias("median_b"))
    return out.select(F.array(*[F.lit(f) for f in fields])[F.col("_i")].alias("field"), "n", "share", "median_a", "median_b")


def spectrum(times: DataFrame, second: str, days: int, periods: int = 40, shortest: float = 5.0, longest: float = 1800.0, smooth: int = 300) -> DataFrame:
    """Power of the mean number of events in a second of the day at ``periods`` periods, in equal ratios: period, power.

    The day's curve, one row a second and so no more than 86,400 whatever the data's size, is freed of its trend by a centred mean of ``smooth``
    seconds (zero beyond the ends); what is left is summed up against sine and cosine of each period.
    """
    counts = times.groupBy(F.col(second).alias("t")).agg((F.count("*") / days).alias("c"))
    span = counts.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo IS NOT NULL")
    curve = span.select(F.explode(F.sequence("lo", "hi")).alias("t")).join(counts, "t", "left").select("t", F.coalesce("c", F.lit(0.0)).alias("c"))
    w = Window.orderBy("t").rowsBetween(-(smooth // 2), smooth - smooth // 2 - 1)
    rest = curve.select("t", (F.col("c") - F.sum("c").over(w) / smooth).alias("x"))
    period = F.lit(shortest) * F.pow(F.lit(longest / shortest), F.col("k") / (periods - 1))
    waves = rest.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("k")).withColumn("angle", 2 * F.pi() * F.col("t") / period)
    sums = waves.groupBy("k").agg(
        F.sum(F.col("x") * F.cos("angle")).alias("u"), F.sum(F.col("x") * F.sin("angle")).alias("v"), F.sum(F.col("x") * F.col("x")).alias("s"), F.count("*").alias("n")
    )
    return sums.select(period.alias("period"), ratio(2 * (F.col("u") * F.col("u") + F.col("v") * F.col("v")), F.col("n") * F.col("s")).alias("power"))
