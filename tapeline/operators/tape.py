"""The event tape: a feed brought to one row a change, in order, with plain ids and one clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.clean import clock_ticks, plain_id, second_ticks

ORDER, CANCEL, TRADE = 0, 1, 2
DAY = ["symbol", "trade_date"]
MINUTE_MS = 60_000
#: The two continuous sessions, in milliseconds since midnight; the second one ends where the closing auction begins.
MORNING, AFTERNOON = (34_200_000, 41_400_000), (46_800_000, 53_820_000)


def tape(feed: DataFrame) -> DataFrame:
    """One row for each (symbol, trade_date, seqno, actiontype): of repeated deliveries the first (smallest ``feed_id``).

    The clock is ``ms``, whole milliseconds since midnight, from whichever of the two clock fields is there. The first
    delivery is taken with a min over structs, so copies are dropped before the shuffle.
    """
    kept = [
        "feed_id",
        "market",
        "direction",
        plain_id(F.col("sysid")).alias("sysid"),
        plain_id(F.col("buyid")).alias("buyid"),
        plain_id(F.col("sellid")).alias("sellid"),
        "price",
        "volume",
        "tradedirection",
        F.coalesce(second_ticks(F.col("timeseconds"), 1000), clock_ticks(F.col("hms"), 1000)).alias("ms"),
    ]
    return (
        feed.groupBy(*DAY, "seqno", "actiontype").agg(F.min(F.struct(*kept)).alias("_r")).select(*DAY, "seqno", "actiontype", "_r.*")
    )


def session(ms: Column) -> Column:
    """0 in the morning session, 1 in the afternoon's, null outside."""
    return F.when(ms.between(MORNING[0], MORNING[1] - 1), 0).when(ms.between(AFTERNOON[0], AFTERNOON[1] - 1), 1)


#: Where the trading day's halves end, the closing auction included; the second half of the day begins at AFTERNOON[0].
ENDS = (41_400_000, 54_000_000)


def slot(ms: Column, width: int) -> Column:
    """The end of the slot of ``width`` milliseconds that holds ``ms``, of slots closed on the left; what comes after a half of the day
    has ended belongs to that half's last slot. Null before the open."""
    edge = ((F.floor(ms / width) + 1) * width).cast("long")
    return F.when(ms.between(MORNING[0], AFTERNOON[0] - 1), F.least(edge, F.lit(ENDS[0]))).when(ms >= AFTERNOON[0], F.least(edge, F.lit(ENDS[1])))


def in_sessions(df: DataFrame) -> DataFrame:
    """Rows of the continuous sessions, with ``sess`` and the minute ``bkt``."""
    return df.withColumns(
        {"sess": session(F.col("ms")), "bkt": F.floor(F.col("ms") / MINUTE_MS).cast("long")}
    ).where("sess IS NOT NULL")


def cents(price: Column) -> Column:
    """Price as whole cents, truncated after a millionth is added."""
    return F.floor((price + 1e-6) * 100).cast("long")


def aggressor_side(df: DataFrame, stated: bool = True) -> DataFrame:
    """Trades with the aggressor's side and the ids of both: the stated direction, else the later (greater) id.

    Without ``stated`` the ids alone decide, and trades that lack one of them are left out.
    """
    trades = df.where(F.col("actiontype") == TRADE)
    buy = F.col("buyid") > F.col("sellid")
    if stated:
        buy = F.when(F.col("tradedirection") == 1, True).when(F.col("tradedirection") == 2, False).otherwise(buy)
    else:
        trades = trades.where("buyid > 0 AND sellid > 0")
    return trades.withColumns(
        {
            "side": F.when(buy, "B").otherwise("S"),
            "active_id": F.when(buy, F.col("buyid")).otherwise(F.col("sellid")),
            "passive_id": F.when(buy, F.col("sellid")).otherwise(F.col("buyid")),
        }
    )


def first_orders(df: DataFrame) -> DataFrame:
    """The first order row of each id: DAY, sysid, order_seq, order_ms, order_side, order_volume, order_cents."""
    return (
        df.where(F.col("actiontype") == ORDER)
        .groupBy(*DAY, "sysid")
        .agg(
            F.min(
                F.struct(
                    F.col("seqno").alias("order_seq"),
                    F.col("ms").alias("order_ms"),
                    F.col("direction").alias("order_side"),
                    F.col("volume").alias("order_volume"),
                    cents(F.col("price")).alias("order_cents"),
                )
            ).alias("_o")
        )
        .select(*DAY, "sysid", "_o.*")
    )
