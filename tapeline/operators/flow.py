"""Order-flow factors per symbol, day and minute, from the tape.

Only changes within the continuous sessions count, and aggressors are told by their ids: the greater one came later.
Ages and lives are counted in events. Where a rule compares an id with a place in the tape, the place of the id's first order stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import imbalance, ratio, sum_if
from tapeline.operators.tape import CANCEL, DAY, ORDER, TRADE, aggressor_side, cents, first_orders, in_sessions

BUCKET = [*DAY, "sess", "bkt"]


def minute_flow(tape: DataFrame, large: float = 0.9) -> DataFrame:
    """Counts, volumes and imbalances of orders, cancels and trades by minute, in one aggregation.

    ``large_share`` is the volume share of orders at or above the ``large`` quantile (linear) of the symbol and day's orders.
    """
    ordered = in_sessions(tape)
    cut = (
        ordered.where(F.col("actiontype") == ORDER)
        .groupBy(*DAY)
        .agg(F.percentile("volume", F.lit(large)).alias("large_at"))
    )
    traded = aggressor_side(ordered, stated=False).select(*BUCKET, "actiontype", F.col("side").alias("direction"), "volume")
    rest = ordered.where(F.col("actiontype") != TRADE).select(*BUCKET, "actiontype", "direction", "volume")
    is_ = lambda a, d=None: (F.col("actiontype") == a) & (F.col("direction") == d if d else F.lit(True))
    one, volume = F.lit(1), F.col("volume")
    sums = (
        rest.unionByName(traded)
        .join(cut, DAY, "left")
        .groupBy(*BUCKET)
        .agg(
            sum_if(is_(ORDER), one).alias("n_ord"),
            sum_if(is_(ORDER, "B"), one).alias("n_buy"),
            sum_if(is_(ORDER, "S"), one).alias("n_sell"),
            sum_if(is_(ORDER, "B"), volume).alias("v_buy"),
            sum_if(is_(ORDER, "S"), volume).alias("v_sell"),
            sum_if(is_(CANCEL), one).alias("n_cxl"),
            sum_if(is_(TRADE, "B"), volume).alias("t_buy"),
            sum_if(is_(TRADE, "S"), volume).alias("t_sell"),
            sum_if(is_(ORDER) & (volume >= F.col("large_at")), volume).alias("v_large"),
            sum_if(is_(ORDER), volume).alias("v_ord"),
        )
    )
    return sums.select(
        *BUCKET,
        "n_ord",
        "n_cxl",
        ratio(F.col("v_ord"), F.col("n_ord")).alias("mean_size"),
        imbalance(F.col("n_buy"), F.col("n_sell")).alias("ord_imb_cnt"),
        imbalance(F.col("v_buy"), F.col("v_sell")).alias("ord_imb_vol"),
        imbalance(F.col("t_buy"), F.col("t_sell")).alias("trd_imb"),
        ratio(F.col("n_cxl"), F.col("n_ord")).alias("cxl_ratio"),
        ratio(F.col("v_large"), F.col("v_ord")).alias("large_share"),
    )


def cancel_life(tape: DataFrame, flash: float = 0.1) -> DataFrame:
    """Life of cancelled orders by minute of the cancel: median log life, and the flash cancels' share and imbalance, by volume.

    A life is the events between order and cancel; flash cancels live no longer than the ``flash`` quantile (linear) of the symbol's day.
    """
    ours = in_sessions(tape)
    lived = (
        ours.where(F.col("actiontype") == CANCEL)
        .join(first_orders(ours).select(*DAY, "sysid", "order_seq"), [*DAY, "sysid"])
        .withColumn("life", F.col("seqno") - F.col("order_seq"))
        .where("life > 0")
    )
    cut = lived.groupBy(*DAY).agg(F.percentile("life", F.lit(flash)).alias("flash_at"))
    quick, buy = F.col("life") <= F.col("flash_at"), F.coalesce(F.col("direction") == "B", F.lit(False))
    return (
        lived.join(cut, DAY)
        .groupBy(*BUCKET)
        .agg(
            F.count("*").alias("n"),
            F.median(F.log1p("life")).alias("life_med"),
            ratio(sum_if(quick, F.col("volume")), F.sum("volume")).alias("flash_ratio"),
            imbalance(sum_if(quick & buy, F.col("volume")), sum_if(quick & ~buy, F.col("volume"))).alias("flash_imb"),
        )
    )


def eaten_age(tape: DataFrame) -> DataFrame:
    """Age of resting orders when they are hit, as the log distance of the two ids: imbalance of its volume-weighted mean by
    aggressor side, its median, and the imbalance of the volume that hits orders as old as the day's median or older."""
    trades = aggressor_side(in_sessions(tape), stated=False).withColumn("age", F.log1p(F.abs(F.col("buyid") - F.col("sellid")).cast("double")))
    middle = trades.groupBy(*DAY).agg(F.median("age").alias("middle"))
    buy, old = F.col("side") == "B", F.col("age") >= F.col("middle")
    volume, weighted = F.col("volume"), F.col("volume") * F.col("age")
    return (
        trades.join(middle, DAY)
        .groupBy(*BUCKET)
        .agg(
            ratio(sum_if(buy, weighted), sum_if(buy, volume)).alias("_b"),
            ratio(sum_if(~buy, weighted), sum_if(~buy, volume)).alias("_s"),
            F.median("age").alias("age_med"),
            imbalance(sum_if(buy & old, volume), sum_if(~buy & old, volume)).alias("old_imb"),
        )
        .select(*BUCKET, imbalance(F.col("_b"), F.col("_s")).alias("age_imb"), "age_med", "old_imb")
    )


def aggressor_moves(tape: DataFrame) -> DataFrame:
    """Trades merged by aggressor, then by millisecond: signed volume, aggressors and trades of each moment."""
    merged = aggressor_side(tape).groupBy(*DAY, "active_id", "side").agg(
        F.min("ms").alias("ms"), F.sum("volume").alias("volume"), F.count("*").alias("trades")
    )
    return merged.groupBy(*DAY, "ms").agg(
        F.sum(F.when(F.col("side") == "B", F.col("volume")).otherwise(-F.col("volume"))).alias("net"),
        F.count("*").alias("aggressors"),
        F.sum("trades").alias("trades"),
    )


def _sides(df: DataFrame, value: str, buy: str, sell: str, mean: str | None, difference: str) -> DataFrame:
    """Two rows a minute (``side``, ``value``) as columns, with their mean and difference; null where one side is missing."""
    wide = df.groupBy(*BUCKET).agg(
        F.max(F.when(F.col("side") == "B", F.col(value))).alias(buy), F.max(F.when(F.col("side") == "S", F.col(value))).alias(sell)
    )
    out = wide.withColumn(difference, F.col(buy) - F.col(sell))
    return out.withColumn(mean, (F.col(buy) + F.col(sell)) / 2) if mean else out


def aggressor_hhi(tape: DataFrame) -> DataFrame:
    """Concentration of aggressive volume over aggressors, by side, and the mean and difference of the two."""
    by_id = aggressor_side(in_sessions(tape), stated=False).groupBy(*BUCKET, "side", "active_id").agg(F.sum("volume").cast("double").alias("v"))
    by_side = by_id.groupBy(*BUCKET, "side").agg(ratio(F.sum(F.col("v") * F.col("v")), F.sum("v") * F.sum("v")).alias("hhi"))
    return _sides(by_side, "hhi", "hhi_buy", "hhi_sell", "hhi_mean", "hhi_imb")


def order_chains(tape: DataFrame, gap: int = 64, size: float = 2.0, least: int = 3) -> DataFrame:
    """Volume share of orders within chains: orders of one side one after another by id, ids at most ``gap`` apart, sizes within a factor."""
    w = Window.partitionBy(*DAY).orderBy("sysid", "seqno")
    orders = in_sessions(tape.where(F.col("actiontype") == ORDER)).withColumn("buy", F.coalesce(F.col("direction") == "B", F.lit(False)))
    before = orders.withColumns({"_s": F.lag("buy").over(w), "_q": F.lag("sysid").over(w), "_v": F.lag("volume").over(w)})
    breaks = (
        F.col("_q").isNull()
        | (F.col("buy") != F.col("_s"))
        | (F.col("sysid") - F.col("_q") > gap)
        | (F.greatest("volume", "_v") > size * F.greatest(F.least("volume", "_v"), F.lit(1)))
    )
    chained = before.withColumn("chain", F.sum(breaks.cast("int")).over(w))
    long = chained.withColumn("n", F.count("*").over(Window.partitionBy(*DAY, "chain")))
    inside, volume = F.col("n") >= least, F.col("volume")
    return long.groupBy(*BUCKET).agg(
        ratio(sum_if(inside, volume), F.sum(volume)).alias("chain_share"),
        imbalance(sum_if(inside & F.col("buy"), volume), sum_if(inside & ~F.col("buy"), volume)).alias("chain_imb"),
    )


def kept_residual(tape: DataFrame, window: int = 5000) -> DataFrame:
    """What aggressors leave resting and keep: order volume less all fills, not cancelled up to ``window`` events after the last
    aggressive trade, in that trade's minute. A cancel before it keeps nothing."""
    ours = in_sessions(tape)
    trades = aggressor_side(ours, stated=False)
    fills = trades.select(*DAY, F.explode(F.array("buyid", "sellid")).alias("sysid"), "volume").groupBy(*DAY, "sysid").agg(F.sum("volume").alias("filled"))
    last = trades.groupBy(*DAY, F.col("active_id").alias("sysid")).agg(F.max(F.struct("seqno", "sess", "bkt")).alias("_l"))
    cancels = ours.where(F.col("actiontype") == CANCEL).groupBy(*DAY, "sysid").agg(F.min("seqno").alias("cancel_seq"))
    kept = (
        last.join(first_orders(ours), [*DAY, "sysid"])
        .join(fills, [*DAY, "sysid"])
        .join(cancels, [*DAY, "sysid"], "left")
        .withColumn("residual", F.col("order_volume") - F.col("filled"))
        .where((F.col("residual") > 0) & (F.col("cancel_seq").isNull() | (F.col("cancel_seq") - F.col("_l.seqno") > window)))
    )
    buy = F.coalesce(F.col("order_side") == "B", F.lit(False))
    return kept.groupBy(*DAY, "_l.sess", "_l.bkt").agg(
        F.count("*").alias("n"), imbalance(sum_if(buy, F.col("residual")), sum_if(~buy, F.col("residual"))).alias("kept_imb")
    )


def chases(tape: DataFrame, gap: int = 256, low: float = 0.7, high: float = 1.4) -> DataFrame:
    """Cancels followed by the next order of their side (as-of forward, the same event included) at a price that chases the market:
    a buy higher, a sell lower than the cancelled order's own, of like size. By minute and volume of the new order.

    A cancel's price is looked up, as feeds leave it out. As-of by one window over both kinds of row, read backwards, not by a range join.
    """
    ours = in_sessions(tape).where("direction IS NOT NULL")
    plain = [*DAY, "direction", "seqno", "actiontype", "volume", "sess", "bkt"]
    orders = ours.where(F.col("actiontype") == ORDER).select(*plain, cents(F.col("price")).alias("cents"))
    cancels = ours.where(F.col("actiontype") == CANCEL).join(first_orders(in_sessions(tape)).select(*DAY, "sysid", "order_cents"), [*DAY, "sysid"])
    rows = orders.unionByName(cancels.select(*plain, F.col("order_cents").alias("cents")))
    w = Window.partitionBy(*DAY, "direction").orderBy(F.desc("seqno"), "actiontype").rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("actiontype") == ORDER, F.struct("seqno", "volume", "cents", "sess", "bkt")), ignorenulls=True).over(w)
    found = rows.withColumn("_n", following).where((F.col("actiontype") == CANCEL) & F.col("_n").isNotNull())
    buy = F.col("direction") == "B"
    ahead = F.when(buy, F.col("_n.cents") > F.col("cents")).otherwise(F.col("_n.cents") < F.col("cents"))
    chased = found.where((F.col("_n.seqno") - F.col("seqno") <= gap) & (F.col("_n.volume") / F.col("volume")).between(low, high) & ahead)
    volume = F.col("_n.volume")
    return chased.groupBy(*DAY, "_n.sess", "_n.bkt").agg(
        F.count("*").alias("n"), imbalance(sum_if(buy, volume), sum_if(~buy, volume)).alias("chase_imb")
    )


def book_age(tape: DataFrame) -> DataFrame:
    """Log mean age of each side's resting volume at each minute's last event, in events, their difference and mean.

    An order counts in full until it is filled or first cancelled. Births and deaths are summed up by event first; what stands at a
    minute's end is the last running sum up to it.
    """
    ours = in_sessions(tape)
    orders = first_orders(ours)
    ids = aggressor_side(ours, stated=False).select(*DAY, "seqno", "volume", F.explode(F.array("buyid", "sellid")).alias("sysid"))
    running = F.sum("volume").over(Window.partitionBy(*DAY, "sysid").orderBy("seqno"))
    full = (
        ids.withColumn("filled", running)
        .join(orders.select(*DAY, "sysid", "order_volume"), [*DAY, "sysid"])
        .where("filled >= order_volume")
        .groupBy(*DAY, "sysid")
        .agg(F.min("seqno").alias("full_seq"))
    )
    cancels = ours.where(F.col("actiontype") == CANCEL).groupBy(*DAY, "sysid").agg(F.min("seqno").alias("cancel_seq"))
    lives = orders.join(full, [*DAY, "sysid"], "left").join(cancels, [*DAY, "sysid"], "left")
    volume, born = F.col("order_volume"), F.col("order_volume") * F.col("order_seq")
    buy = F.coalesce(F.col("order_side") == "B", F.lit(False))
    move = lambda at, sign: F.struct(
        at.alias("seqno"),
        *[F.when(side, sign * x).otherwise(0).alias(name) for name, side, x in (("vb", buy, volume), ("bb", buy, born), ("vs", ~buy, volume), ("bs", ~buy, born))],
    )
    sums = ["vb", "bb", "vs", "bs"]
    moves = (
        lives.select(*DAY, F.inline(F.array(move(F.col("order_seq"), 1), move(F.least("full_seq", "cancel_seq"), -1))))
        .where("seqno IS NOT NULL")
        .groupBy(*DAY, "seqno")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    ends = ours.groupBy(*BUCKET).agg(F.max("seqno").alias("seqno"))
    both = moves.unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*DAY).orderBy("seqno").rangeBetween(Window.unboundedPreceding, 0)
    standing = both.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).where("bkt IS NOT NULL")
    age = lambda v, b: F.log1p(F.greatest(F.when(F.col(v) > 0, (F.col("seqno") * F.col(v) - F.col(b)) / F.col(v)), F.lit(0.0)))
    aged = standing.select(
        *BUCKET, F.col("vb").alias("alive_buy"), F.col("vs").alias("alive_sell"),
        F.when(F.col("vb") > 0, age("vb", "bb")).alias("age_buy"), F.when(F.col("vs") > 0, age("vs", "bs")).alias("age_sell"),
    )
    return aged.withColumns(
        {"age_imb": F.col("age_buy") - F.col("age_sell"), "age_mean": (F.col("age_buy") + F.col("age_sell")) / 2}
    )


def refill(tape: DataFrame, cap: float = 5.0) -> DataFrame:
    """Volume that comes back at price levels that were eaten in the same minute, against what was eaten, capped, by side, and the difference."""
    ours = in_sessions(tape)
    level = cents(F.col("price")).alias("cents")
    eaten = aggressor_side(ours, stated=False).groupBy(*BUCKET, level, F.when(F.col("side") == "B", "S").otherwise("B").alias("side")).agg(
        F.sum("volume").alias("eaten")
    )
    rested = F.when(F.col("direction") == "B", "B").otherwise("S").alias("side")
    back = ours.where(F.col("actiontype") == ORDER).groupBy(*BUCKET, level, rested).agg(F.sum("volume").alias("back"))
    by_side = eaten.join(back, [*BUCKET, "cents", "side"]).groupBy(*BUCKET, "side").agg(
        F.least(F.sum("back") / F.greatest(F.sum("eaten"), F.lit(1)), F.lit(cap)).alias("refill")
    )
    return _sides(by_side, "refill", "refill_bid", "refill_ask", None, "refill_imb")


def sweep_budget(tape: DataFrame) -> DataFrame:
    """Volume an id that traded can take: its order's volume and what it traded before the order row, or, without an order, all it traded."""
    ids = tape.where(F.col("actiontype") == TRADE).select(*DAY, "seqno", "volume", F.explode(F.array("buyid", "sellid")).alias("sysid"))
    joined = ids.join(first_orders(tape), [*DAY, "sysid"], "left")
    return joined.groupBy(*DAY, "sysid").agg(
        F.coalesce(
            F.max("order_volume") + sum_if(F.col("seqno") < F.col("order_seq"), F.col("volume")), F.sum("volume")
        ).alias("budget"),
        F.sum("volume").alias("traded"),
        F.max(F.col("order_seq").isNotNull()).alias("has_order"),
    )


def bursts(tape: DataFrame, short_ms: int = 60_000, long_ms: int = 600_000, times: float = 2.0) -> DataFrame:
    """Trades of the last minute against the trailing ten, at each minute's last trade, and where that ratio first rises above ``times``."""
    w = Window.partitionBy(*DAY, "sess").orderBy("ms")
    trades = in_sessions(tape.where(F.col("actiontype") == TRADE))
    counted = trades.withColumns(
        {"n_short": F.count("*").over(w.rangeBetween(-short_ms + 1, 0)), "n_long": F.count("*").over(w.rangeBetween(-long_ms + 1, 0))}
    )
    at_end = counted.groupBy(*BUCKET).agg(F.max(F.struct("ms", "n_short", "n_long")).alias("_l")).select(
        *BUCKET, (F.col("_l.n_short") * (long_ms / short_ms) / F.col("_l.n_long")).alias("burst")
    )
    v = Window.partitionBy(*DAY, "sess").orderBy("bkt")
    high = F.col("burst") > times
    return at_end.withColumn("rises", high & ~F.coalesce(F.lag(high).over(v), F.lit(False)))
