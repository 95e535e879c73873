"""Minute bars: quality counters, the session grid, features that look back, labels that look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.clean import MINUTE_NS, bar_ns, finite
from tapeline.functions.stats import ratio
from tapeline.operators.sessions import in_session
from tapeline.operators.tape import AFTERNOON, DAY, ENDS, MORNING, TRADE, cents, slot

SERIES = ["ticker", "session_date"]
PRICES = ["open", "high", "low", "close"]


def sane() -> Column:
    """Prices finite and above zero, high and low around open and close, volume finite and not below zero."""
    good = finite(F.col("volume")) & (F.col("volume") >= 0)
    for c in PRICES:
        good = good & finite(F.col(c)) & (F.col(c) > 0)
    return F.coalesce(good & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")), F.lit(False))


def stamped(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ns", bar_ns(F.col("profile"), F.col("window_start"))).where("ticker IS NOT NULL AND ns IS NOT NULL")


def minutes(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """One sane bar for each ticker, session and minute: the last by stamp, then by ``loaded_at``, then by ``bar_id``.

    Columns: SERIES, ``minute`` (from 0 at the open), ``length`` of the session in minutes, open, high, low, close, volume, n_trans.
    """
    inside = in_session(stamped(bars).where(sane()), sessions)
    minute = F.round((F.col("ns") - F.col("open_ns") - F.pmod(F.col("ns") - F.col("open_ns"), F.lit(MINUTE_NS))) / MINUTE_NS).cast("int")
    length = F.round((F.col("close_ns") - F.col("open_ns")) / MINUTE_NS).cast("int")
    return (
        inside.groupBy(*SERIES, minute.alias("minute"), length.alias("length"))
        .agg(F.max(F.struct("ns", "loaded_at", "bar_id", *PRICES, "volume", "n_trans")).alias("_r"))
        .select(*SERIES, "minute", "length", *[F.col(f"_r.{c}").alias(c) for c in [*PRICES, "volume", "n_trans"]])
    )


def on_grid(bars: DataFrame) -> DataFrame:
    """Every minute of each series' session, observed or not; nothing is filled. Each series spans its own grid, so no cross join."""
    grid = bars.select(*SERIES, "length").distinct().select(
        *SERIES, "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("minute")
    )
    return grid.join(bars.drop("length"), [*SERIES, "minute"], "left").withColumn("observed", F.col("close").isNotNull())


def priced(grid: DataFrame) -> DataFrame:
    """The grid as features and labels see it: a bar without volume is no price, so its fields are null and it counts as not observed."""
    traded = F.col("volume") > 0
    return grid.withColumns({c: F.when(traded, F.col(c)) for c in [*PRICES, "volume"]}).withColumn("observed", F.col("close").isNotNull())


def complete(x: Column, w, n: int) -> Column:
    """True where all ``n`` rows of the window have a value."""
    return F.count(x).over(w) == n


def features(grid: DataFrame, lookbacks: tuple[int, ...] = (5, 15), base: int = 30) -> DataFrame:
    """Returns over the lookbacks, volatility, volume against its trailing mean (the minute itself left out), range.

    Each looks back only, within the session, and is null where a row of its window is missing.
    """
    order = Window.partitionBy(*SERIES).orderBy("minute")
    back = lambda n: order.rowsBetween(-n, 0)
    before = order.rowsBetween(-base, -1)
    one = F.log(ratio(F.col("close"), F.lag("close").over(order)))
    stepped = grid.withColumn("_one", one)
    columns: dict[str, Column] = {
        f"ret_{n}": F.when(complete(F.col("close"), back(n), n + 1), ratio(F.col("close"), F.lag("close", n).over(order)) - 1) for n in lookbacks
    }
    last = order.rowsBetween(-base + 1, 0)
    columns[f"rv_{base}"] = F.when(complete(F.col("_one"), last, base), F.sqrt(F.sum(F.col("_one") * F.col("_one")).over(last)))
    columns[f"volume_ratio_{base}"] = F.when(
        complete(F.col("volume"), before, base), ratio(F.col("volume"), F.avg("volume").over(before))
    )
    columns["range_pct"] = ratio(F.col("high") - F.col("low"), F.col("close"))
    return stepped.withColumns(columns).drop("_one")


def labels(grid: DataFrame, horizons: tuple[int, ...] = (5, 15), skip: int = 1) -> DataFrame:
    """Forward returns from the open of minute ``t + 1 + skip`` to the open ``h`` later, where signal and holding window are observed."""
    order = Window.partitionBy(*SERIES).orderBy("minute")
    entry = 1 + skip
    return grid.withColumns(
        {
            f"label_{h}": F.when(
                F.col("observed") & complete(F.col("close"), order.rowsBetween(entry, entry + h), h + 1),
                ratio(F.lead("open", entry + h).over(order), F.lead("open", entry).over(order)) - 1,
            )
            for h in horizons
        }
    )


def rolling_factors(grid: DataFrame, hour: int = 60, long: int = 240) -> DataFrame:
    """Factors of bars by minute: returns over five spans, volatility over two, range, Parkinson range, volume against its means,
    mean trade size, distance from the bar's VWAP, place in the long range, volume acceleration, illiquidity.

    Returns look at rows back in the grid, whose missing minutes are null; means take what there is of their window,
    volatilities want all of it. The spans end at the session's open.
    """
    order = Window.partitionBy(*SERIES).orderBy("minute")
    close, volume = F.col("close"), F.col("volume")
    back = lambda n: ratio(close, F.lag("close", n).over(order)) - 1
    last = lambda n: order.rowsBetween(-n + 1, 0)
    staged = grid.withColumns({"ret_1": back(1), **{f"ret_{n}": back(n) for n in (5, 15, hour, long)}})
    spread = lambda n: F.when(complete(F.col("ret_1"), last(n), n), F.stddev_samp("ret_1").over(last(n)) * n**0.5)
    low, high = F.min("low").over(last(long)), F.max("high").over(last(long))
    wide = F.log(ratio(F.col("high"), F.col("low")))
    return staged.select(
        *SERIES,
        "minute",
        *[f"ret_{n}" for n in (1, 5, 15, hour, long)],
        spread(hour).alias("rv_hour"),
        spread(long).alias("rv_long"),
        ratio(F.col("high") - F.col("low"), close).alias("range_pct"),
        (wide * wide / 2.772588722239781).alias("parkinson"),
        ratio(volume, F.avg("volume").over(last(hour))).alias("volume_ratio_hour"),
        ratio(volume, F.avg("volume").over(last(long))).alias("volume_ratio_long"),
        ratio(volume, F.col("n_trans")).alias("trade_size"),
        ratio(close - low, high - low).alias("place"),
        ratio(F.sum("volume").over(last(hour)) / hour, F.sum("volume").over(last(long)) / long).alias("volume_acc"),
        (ratio(F.abs("ret_1"), volume) * 1e9).alias("amihud"),
    )


def quality(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counters a ticker: rows, outside any session, not sane, without volume, off the full minute, repeated stamps, minutes missing."""
    own = stamped(bars).withColumn("_ok", sane())
    rows = own.groupBy("ticker").agg(
        F.count("*").alias("n_rows"),
        F.count_if(~F.col("_ok")).alias("faulty"),
        F.count_if(F.col("volume") == 0).alias("no_volume"),
        F.count_if(F.pmod("ns", F.lit(MINUTE_NS)) != 0).alias("off_minute"),
    )
    inside = in_session(own.select("ticker", "ns"), sessions).groupBy("ticker").agg(F.count("*").alias("_in"))
    repeated = own.groupBy("ticker", "ns").count().groupBy("ticker").agg(F.sum(F.col("count") - 1).alias("repeated"))
    missing = on_grid(minutes(bars, sessions)).groupBy("ticker").agg(F.count_if(~F.col("observed")).alias("missing"))
    out = rows.join(inside, "ticker", "left").join(repeated, "ticker", "left").join(missing, "ticker", "left")
    return out.select(
        "ticker", "n_rows", (F.col("n_rows") - F.coalesce("_in", F.lit(0))).alias("outside"), "faulty", "no_volume", "off_minute", "repeated",
        F.coalesce("missing", F.lit(0)).alias("missing"),
    )


def trade_slots(tape: DataFrame, width: int) -> DataFrame:
    """Trade bars of slots of ``width`` milliseconds, labelled by their end, in cents: DAY, slot, open, high, low, close, volume, amount, n."""
    trades = tape.where(F.col("actiontype") == TRADE).withColumns({"slot": slot(F.col("ms"), width), "cents": cents(F.col("price"))}).where("slot IS NOT NULL")
    return trades.groupBy(*DAY, "slot").agg(
        F.min(F.struct("seqno", "cents"))["cents"].alias("open"),
        F.max("cents").alias("high"),
        F.min("cents").alias("low"),
        F.max(F.struct("seqno", "cents"))["cents"].alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("cents") * F.col("volume")).alias("amount"),
        F.count("*").alias("n"),
    )


def every_slot(slots: DataFrame, width: int) -> DataFrame:
    """All slots of a day, with or without trades: last price and the day's totals carried, ``flag`` 1 in the closing auction, else 2
    where nothing was traded and 0 where something was. Each symbol and day spans its own grid."""
    half = lambda lo, hi: F.sequence(*[F.lit(x).cast("long") for x in (lo + width, hi, width)])
    grid = slots.select(*DAY).distinct().select(*DAY, F.explode(F.concat(half(MORNING[0], ENDS[0]), half(AFTERNOON[0], ENDS[1]))).alias("slot"))
    w = Window.partitionBy(*DAY).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(slots, [*DAY, "slot"], "left")
    flag = F.when((F.col("slot") > AFTERNOON[1]), 1).when(F.col("n").isNull(), 2).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return joined.select(
        *DAY, "slot", F.coalesce("n", F.lit(0)).alias("n"), F.last("close", ignorenulls=True).over(w).alias("last"),
        F.max("high").over(w).alias("day_high"), F.min("low").over(w).alias("day_low"), total("volume").alias("day_volume"), total("amount").alias("day_amount"), flag.alias("flag"),
    )
