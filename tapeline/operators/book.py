"""Book levels, call-auction clearing and statistics of book rows, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.clean import finite
from tapeline.functions.stats import imbalance, ratio, sum_if
from tapeline.operators.tape import CANCEL, DAY, MINUTE_MS, ORDER, TRADE, aggressor_side, cents, first_orders


def depth_changes(tape: DataFrame) -> DataFrame:
    """Every change of resting volume with the price and side of its order: DAY, seqno, ms, side, cents, delta, and the same of the number of orders, ``dn``.

    An order adds its volume; cancels and trades take from it, never more than is left, in order of the tape. Changes of
    unknown orders change nothing.
    """
    orders = first_orders(tape)
    touched = tape.where(F.col("actiontype") == TRADE).select(*DAY, "seqno", "actiontype", "ms", "volume", F.explode(F.array("buyid", "sellid")).alias("sysid"))
    touched = touched.unionByName(tape.where(F.col("actiontype") == CANCEL).select(*DAY, "seqno", "actiontype", "ms", "volume", "sysid"))
    w = Window.partitionBy(*DAY, "sysid").orderBy("seqno", "actiontype").rowsBetween(Window.unboundedPreceding, 0)
    known = touched.join(orders, [*DAY, "sysid"]).where(F.col("seqno") >= F.col("order_seq"))
    taken = known.withColumn("_sum", F.sum("volume").over(w))
    left_before = F.greatest(F.col("order_volume") - (F.col("_sum") - F.col("volume")), F.lit(0))
    cuts = taken.select(
        *DAY, "seqno", "ms", F.col("order_side").alias("side"), F.col("order_cents").alias("cents"), (-F.least("volume", left_before)).alias("delta"),
        F.when((left_before > 0) & (F.col("volume") >= left_before), -1).otherwise(0).alias("dn"),
    )
    adds = orders.select(
        *DAY, F.col("order_seq").alias("seqno"), F.col("order_ms").alias("ms"), F.col("order_side").alias("side"),
        F.col("order_cents").alias("cents"), F.col("order_volume").alias("delta"), F.when(F.col("order_volume") > 0, 1).otherwise(0).alias("dn"),
    )
    return adds.unionByName(cuts).where("side IS NOT NULL")


def snapshots(tape: DataFrame, levels: int = 10, every_ms: int = 15 * MINUTE_MS) -> DataFrame:
    """The best levels of each side at the end of each period: per symbol, day, period and level price, volume and number of orders.

    Changes are summed per period and price first, so the running sums go over periods, not over events.
    """
    period = F.floor(F.col("ms") / every_ms).cast("long")
    summed = depth_changes(tape).groupBy(*DAY, "side", "cents", period.alias("period")).agg(F.sum("delta").alias("delta"), F.sum("dn").alias("dn"))
    ends = summed.groupBy(*DAY).agg(F.max("period").alias("_hi"))
    price = Window.partitionBy(*DAY, "side", "cents").orderBy("period")
    standing = summed.withColumns({"volume": F.sum("delta").over(price), "orders": F.sum("dn").over(price), "_next": F.lead("period").over(price)}).where("volume > 0")
    every = standing.join(ends, DAY).select(
        *DAY, "side", "cents", "volume", "orders", F.explode(F.sequence("period", F.coalesce(F.col("_next") - 1, F.col("_hi")))).alias("period")
    )
    best = F.when(F.col("side") == "B", -F.col("cents")).otherwise(F.col("cents"))
    rank = F.row_number().over(Window.partitionBy(*DAY, "period", "side").orderBy(best))
    return every.withColumn("level", rank).where(F.col("level") <= levels).select(*DAY, "period", "side", "level", "cents", "volume", "orders")


def depth_features(levels: DataFrame, few: int = 5, bins: tuple[int, ...] = (5, 20)) -> DataFrame:
    """What book levels (DAY, period, side, level, cents, volume) say of the depth: volume of the first ``few`` and of all levels by side and
    their imbalance, price of level ``few``, and volume within so many cents of the side's best, all in one aggregation."""
    rows = levels.withColumn("_away", F.abs(F.col("cents") - F.first("cents").over(Window.partitionBy(*DAY, "period", "side").orderBy("level"))))
    volume = F.col("volume")
    columns = {}
    for name, side in (("bid", F.col("side") == "B"), ("ask", F.col("side") == "S")):
        columns[f"{name}_few"] = sum_if(side & (F.col("level") <= few), volume)
        columns[f"{name}_all"] = sum_if(side, volume)
        columns[f"{name}_price_{few}"] = F.max(F.when(side & (F.col("level") == few), F.col("cents")))
        columns |= {f"{name}_within_{n}": sum_if(side & (F.col("_away") <= n), volume) for n in bins}
    out = rows.groupBy(*DAY, "period").agg(*[c.alias(n) for n, c in columns.items()])
    return out.withColumns({f"imbalance_{k}": imbalance(F.col(f"bid_{k}"), F.col(f"ask_{k}")) for k in ("few", "all")})


def repaired_prices(lob: DataFrame) -> DataFrame:
    """Rows whose price can't be true with the one that stands for it: a cancel's is its order's, others' the other side's best; null if
    that is missing too. Columns: rec_id, ordertype, price."""
    good = lambda c: finite(c) & (c > 0)
    key = [*DAY, "sysid"]
    own = lob.where((F.col("ordertype") == "wt") & good(F.col("price"))).groupBy(*key).agg(F.min(F.struct("seqno", "rec_id", "price"))["price"].alias("_own"))
    bad = lob.where(~F.coalesce(good(F.col("price")), F.lit(False))).join(own, key, "left")
    other = F.when(F.col("direction") == "B", F.col("akp1")).when(F.col("direction") == "S", F.col("bdp1"))
    price = F.when(F.col("ordertype") == "cl", F.coalesce(F.col("_own"), F.when(good(other), other))).otherwise(F.when(good(other), other))
    return bad.select("rec_id", "ordertype", price.alias("price"))


def uncross(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Clearing of orders (keys, side, cents, volume) as in a call auction: the price that executes most.

    Ties go to the smaller surplus, then to the higher price. Demand and supply are running sums over the price levels
    of a key, whose number is bounded by the ticks between its prices. Columns: keys, clear_cents, executed, surplus.
    """
    levels = orders.groupBy(*keys, "cents").agg(
        sum_if(F.col("side") == "B", F.col("volume")).alias("_b"), sum_if(F.col("side") == "S", F.col("volume")).alias("_s")
    )
    w = Window.partitionBy(*keys).orderBy("cents")
    staged = levels.withColumns(
        {
            "_demand": F.sum("_b").over(w.rowsBetween(0, Window.unboundedFollowing)),
            "_supply": F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    done = F.least("_demand", "_supply")
    best = F.max(F.struct(done.alias("executed"), (-F.abs(F.col("_demand") - F.col("_supply"))).alias("_i"), F.col("cents"), (F.col("_demand") - F.col("_supply")).alias("surplus")))
    return staged.groupBy(*keys).agg(best.alias("_x")).where("_x.executed > 0").select(
        *keys, F.col("_x.cents").alias("clear_cents"), F.col("_x.executed").alias("executed"), F.col("_x.surplus").alias("surplus")
    )


def usable_book(lob: DataFrame) -> DataFrame:
    """Book rows with a price and volume that can be true."""
    return lob.where(finite(F.col("price")) & (F.col("price") > 0) & (F.col("volume") > 0) & F.col("timeseconds").isNotNull())


def aggressiveness() -> Column:
    """An order against the best levels before it, 1 to 6: beyond the other side's best and taking all of it, at it and taking all,
    at or beyond it with less, between both sides, at its own side's best, behind it; 0 where the levels that tell are missing."""
    buy, volume = F.col("direction") == "B", F.col("volume")
    sign = F.when(buy, 1).otherwise(-1)
    at = cents(F.col("price")) * sign
    far, far_volume = F.when(buy, F.col("akp1")).otherwise(F.col("bdp1")), F.when(buy, F.col("akv1")).otherwise(F.col("bdv1"))
    near = F.when(buy, F.col("bdp1")).otherwise(F.col("akp1"))
    has_far, has_near = F.coalesce(finite(far) & (far > 0), F.lit(False)), F.coalesce(finite(near) & (near > 0), F.lit(False))
    f, n, all_of_it = cents(F.when(has_far, far)) * sign, cents(F.when(has_near, near)) * sign, volume >= F.coalesce(far_volume, F.lit(0))
    return (
        F.when(has_far & (at > f) & all_of_it, 1)
        .when(has_far & (at == f) & all_of_it, 2)
        .when(has_far & (at >= f), 3)
        .when(has_far & has_near & (at < f) & (at > n), 4)
        .when(has_near & (at == n), 5)
        .when(has_near & (at < n), 6)
        .otherwise(0)
    )


def crossing_class(lob: DataFrame) -> DataFrame:
    """Orders by how aggressive they are, by day and side: counts and volume."""
    return (
        usable_book(lob)
        .where("ordertype = 'wt' AND direction IS NOT NULL")
        .groupBy("trade_date", "direction", aggressiveness().alias("kind"))
        .agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    )


def life_times(tape: DataFrame) -> DataFrame:
    """Milliseconds of each change since what came before it in its life: an order since the order before it (the first: 0), a cancel
    since its own order, a trade since the resting side's order; the midday break left out, null where that order is unknown."""
    w = Window.partitionBy(*DAY).orderBy("seqno")
    orders = tape.where(F.col("actiontype") == ORDER).select(*DAY, "seqno", "actiontype", "ms", F.coalesce(F.lag("ms").over(w), F.col("ms")).alias("since"))
    cancels = tape.where(F.col("actiontype") == CANCEL).select(*DAY, "seqno", "actiontype", "ms", "sysid")
    trades = aggressor_side(tape).select(*DAY, "seqno", "actiontype", "ms", F.col("passive_id").alias("sysid"))
    known = cancels.unionByName(trades).join(first_orders(tape).select(*DAY, "sysid", F.col("order_ms").alias("since")), [*DAY, "sysid"], "left")
    every = orders.unionByName(known.drop("sysid"))
    noon = 43_200_000
    pause = F.when((F.col("since") < noon) & (F.col("ms") > noon), 5_400_000).otherwise(0)
    return every.select(*DAY, "seqno", "actiontype", (F.col("ms") - F.col("since") - pause).alias("life_ms"))


def flow_rollup(lob: DataFrame, slot_seconds: int = 300) -> DataFrame:
    """Counts, volume, amount, mean and last price per slot (labelled by its right edge), by type and side, by type, and in all."""
    slot = ((F.floor(F.col("timeseconds") / slot_seconds) + 1) * slot_seconds).cast("long").alias("slot")
    rows = usable_book(lob).select("symbol", "trade_date", slot, "ordertype", "direction", "price", "volume", "seqno", "rec_id")
    amount = F.sum(F.col("price") * F.col("volume"))
    stats = [
        F.count("*").alias("n"),
        F.sum("volume").alias("volume"),
        ratio(amount, F.sum("volume")).alias("vwap"),
        F.max(F.struct("seqno", "rec_id", "price"))["price"].alias("last_price"),
    ]
    sets = [["symbol", "trade_date", "slot", "ordertype", "direction"], ["symbol", "trade_date", "slot", "ordertype"], ["symbol", "trade_date", "slot"]]
    return rows.groupingSets(sets, "symbol", "trade_date", "slot", "ordertype", "direction").agg(*stats)


def book_features(lob: DataFrame) -> DataFrame:
    """Mid, spread, micro price and imbalance of each minute's last row, carried over minutes without one, up to the day's last."""
    good = usable_book(lob).where(finite(F.col("bdp1")) & finite(F.col("akp1")) & (F.col("bdp1") > 0) & (F.col("akp1") > F.col("bdp1")))
    minute = F.floor(F.col("timeseconds") / 60).cast("long")
    last = good.groupBy(*DAY, minute.alias("minute")).agg(F.max(F.struct("seqno", "rec_id", "bdp1", "bdv1", "akp1", "akv1")).alias("_r"))
    state = last.select(
        *DAY,
        "minute",
        ((F.col("_r.bdp1") + F.col("_r.akp1")) / 2).alias("mid"),
        (F.col("_r.akp1") - F.col("_r.bdp1")).alias("spread"),
        ratio(F.col("_r.bdp1") * F.col("_r.akv1") + F.col("_r.akp1") * F.col("_r.bdv1"), F.col("_r.bdv1") + F.col("_r.akv1")).alias("micro"),
        imbalance(F.col("_r.bdv1"), F.col("_r.akv1")).alias("imb"),
    )
    grid = state.groupBy(*DAY).agg(F.min("minute").alias("_a"), F.max("minute").alias("_b")).select(*DAY, F.explode(F.sequence("_a", "_b")).alias("minute"))
    w = Window.partitionBy(*DAY).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(state.withColumn("fresh", F.lit(True)), [*DAY, "minute"], "left")
    return joined.select(
        *DAY, "minute", F.coalesce("fresh", F.lit(False)).alias("fresh"),
        *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("mid", "spread", "micro", "imb")],
    )


def after_state(lob: DataFrame) -> DataFrame:
    """The best levels after each row: those before the next row of the symbol and day; the last row keeps its own."""
    w = Window.partitionBy(*DAY).orderBy("seqno", "rec_id")
    return lob.select("rec_id", *[F.coalesce(F.lead(c).over(w), F.col(c)).alias(f"{c}_after") for c in ("bdp1", "bdv1", "akp1", "akv1")])


def ordered_gaps(tape: DataFrame) -> DataFrame:
    """Milliseconds between an order and the one before it, the midday break left out, summed up by symbol and day."""
    w = Window.partitionBy(*DAY).orderBy("seqno")
    orders = tape.where(F.col("actiontype") == ORDER).withColumn("_p", F.lag("ms").over(w)).where("_p IS NOT NULL")
    over_noon = (F.col("_p") < 41_400_000) & (F.col("ms") >= 46_800_000)
    gap = F.col("ms") - F.col("_p") - F.when(over_noon, 5_400_000).otherwise(0)
    return orders.groupBy(*DAY).agg(F.count("*").alias("n"), F.sum(gap).alias("gap_sum"), F.median(gap).alias("gap_median"), F.max(gap).alias("gap_max"))
