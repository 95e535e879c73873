"""Statistics of call auctions: clearing, what is better than the clearing price, what is left, pairs, totals by side.

Orders (keys, id, side ``B`` or ``S``, cents, volume) of one key are called at once. Everything is running sums over
price levels or over orders by priority (price, then id) within a key and side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import ratio, sum_if
from tapeline.operators.book import uncross

#: An order of at least this amount is a big one.
BIG = 500_000.0


def _priority(side: str = "side", cents: str = "cents"):
    """Best price first: the highest of buys, the lowest of sells."""
    return F.when(F.col(side) == "B", -F.col(cents)).otherwise(F.col(cents))


def statistics(orders: DataFrame, keys: list[str], big: float = BIG) -> DataFrame:
    """One row a key: clearing (null and 0 if nothing crosses), imbalance over both sides' volume at it, volume strictly better than it by
    side, volume of the other side that can be executed at it, totals, counts, mean prices and big orders by side, and ``pairs``.

    ``pairs`` is how many trades matching by priority makes: each trade ends where an order of either side is used up or where
    the matched volume ends, so it is the number of different running sums of both sides up to that volume.
    """
    clear = uncross(orders, keys)
    joined = orders.join(clear, keys, "left").withColumn("executed", F.coalesce("executed", F.lit(0)))
    buy, volume, at = F.col("side") == "B", F.col("volume"), F.col("clear_cents")
    amount = F.col("cents") * volume
    above, below = F.col("cents") > at, F.col("cents") < at
    w = Window.partitionBy(*keys, "side").orderBy(_priority(), "id").rowsBetween(Window.unboundedPreceding, 0)
    used = joined.withColumn("_used", F.sum("volume").over(w))
    return (
        used.groupBy(*keys)
        .agg(
            F.max("clear_cents").alias("clear_cents"),
            F.max("executed").alias("executed"),
            sum_if(buy & ~below, volume).alias("_demand"),
            sum_if(~buy & ~above, volume).alias("_supply"),
            sum_if(buy & above, volume).alias("better_buy"),
            sum_if(~buy & below, volume).alias("better_sell"),
            *[
                x.alias(f"{name}_{n}")
                for name, side in (("buy", buy), ("sell", ~buy))
                for n, x in (
                    ("volume", sum_if(side, volume)),
                    ("orders", F.count_if(side)),
                    ("vwap", ratio(sum_if(side, amount), sum_if(side, volume) * 100)),
                    ("big", sum_if(side & (amount >= big * 100), volume)),
                )
            ],
            F.count_distinct(F.when((F.col("_used") > 0) & (F.col("_used") < F.col("executed")), F.col("_used"))).alias("_ends"),
        )
        .select(
            *keys, "clear_cents", "executed", ratio(F.col("_demand") - F.col("_supply"), F.col("_demand") + F.col("_supply")).alias("imbalance"),
            "better_buy", "better_sell", F.col("_supply").alias("executable_for_buy"), F.col("_demand").alias("executable_for_sell"),
            *[f"{s}_{n}" for s in ("buy", "sell") for n in ("volume", "orders", "vwap", "big")],
            (F.col("_ends") + (F.col("executed") > 0).cast("long")).alias("pairs"),
        )
    )


def residual(orders: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """The best levels of each side after matching: keys, side, level (from 1), cents, volume."""
    clear = uncross(orders, keys)
    summed = orders.groupBy(*keys, "side", "cents").agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy(*keys, "side").orderBy(_priority())
    left = (
        summed.join(clear.select(*keys, "executed"), keys, "left")
        .withColumn("_used", F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("volume", F.least("volume", F.col("_used") - F.coalesce("executed", F.lit(0))))
        .where("volume > 0")
    )
    return left.withColumn("level", F.row_number().over(w)).where(F.col("level") <= levels).select(*keys, "side", "level", "cents", "volume")
