"""Queries that list and link records: instruments, trades, keys, fingerprints, as-of looks backward; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.clean import plain_id, six_digits
from tapeline.functions.stats import ratio, round_all
from tapeline.operators import bars
from tapeline.operators import tape as tapes
from tapeline.plans.bars import MINUTES
from tapeline.plans.flow import TAPE
from tapeline.sources.tables import table


def _tape(spark: SparkSession, d: str) -> DataFrame:
    return tapes.tape(table(spark, d, "event_feed"))


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """Every market and symbol of the feed with its first and last day and its rows."""
    return table(spark, d, "event_feed").groupBy("market", "symbol").agg(
        F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count("*").alias("n_rows")
    )


def trade_records(spark: SparkSession, d: str) -> DataFrame:
    """Every trade with its side, both ids, the resting order's age in changes and what was left of it before, and a 17-digit stamp."""
    t = _tape(spark, d)
    key = [*tapes.DAY, "sysid"]
    trades = tapes.aggressor_side(t).withColumn("sysid", F.col("passive_id"))
    w = Window.partitionBy(*key).orderBy("seqno").rowsBetween(Window.unboundedPreceding, -1)
    before = trades.withColumn("_taken", F.coalesce(F.sum("volume").over(w), F.lit(0)))
    orders = tapes.first_orders(t).select(*key, "order_seq", "order_volume")
    second = F.floor(F.col("ms") / 1000)
    clock = (F.floor(second / 3600) * 10_000 + F.floor(F.pmod(second, F.lit(3600)) / 60) * 100 + F.pmod(second, F.lit(60))) * 1000 + F.pmod("ms", F.lit(1000))
    return before.join(orders, key, "left").select(
        *tapes.DAY, "seqno", (F.col("trade_date").cast("long") * 1_000_000_000 + clock).cast("long").alias("stamp"), tapes.cents(F.col("price")).alias("cents"), "volume", "side",
        "active_id", "passive_id", (F.col("seqno") - F.col("order_seq")).alias("rested"), (F.col("order_volume") - F.col("_taken")).alias("left_before"),
    )


def day_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of each symbol's day that neither the order of rows nor repeated deliveries change."""
    text = F.concat_ws("|", "seqno", "actiontype", "sysid", "buyid", "sellid", "volume", tapes.cents(F.col("price")))
    return _tape(spark, d).groupBy(*tapes.DAY).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("fingerprint"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """The number in the events' JSON by type of event."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def filled_returns(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute changes of closes carried over minutes without one, and each ticker's ordinal place among them (ties by ticker)."""
    grid = bars.priced(bars.on_grid(bars.minutes(table(spark, d, "minute_bars"), table(spark, d, "sessions"))))
    w = Window.partitionBy(*bars.SERIES).orderBy("minute")
    filled = grid.withColumn("close", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = filled.select(*bars.SERIES, "minute", (ratio(F.col("close"), F.lag("close", 5).over(w)) - 1).alias("change")).where("change IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("session_date", "minute").orderBy(F.round("change", 12), "ticker")) - 1
    return round_all(change.withColumn("place", place))


def key_union(spark: SparkSession, d: str) -> DataFrame:
    """Orders that any of the two builds' tables knows, by day."""
    keys = [
        table(spark, d, name).select(six_digits(F.col("symbol")).alias("symbol"), "trade_date", plain_id(F.col("sysid")).alias("sysid")) for name in ("order_rows", "trade_rows")
    ]
    return keys[0].unionByName(keys[1]).distinct().groupBy("trade_date").agg(F.count("*").alias("orders"), F.count_distinct("symbol").alias("symbols"))


def last_trade_at_order(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the last trade before it (as-of backward) of its symbol and day: its price and how many changes ago; none before the first."""
    rows = _tape(spark, d).where("actiontype IN (0, 2)")
    w = Window.partitionBy(*tapes.DAY).orderBy("seqno", "actiontype").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("actiontype") == 2, F.struct("seqno", tapes.cents(F.col("price")).alias("cents"))), ignorenulls=True).over(w)
    return rows.withColumn("_l", last).where("actiontype = 0 AND _l IS NOT NULL").select(*tapes.DAY, "seqno", F.col("_l.cents").alias("cents"), (F.col("seqno") - F.col("_l.seqno")).alias("ago"))


QUERIES = {f.__name__: f for f in (instruments, trade_records, day_fingerprints, event_props, filled_returns, key_union, last_trade_at_order)}

_KEYS = "SELECT lpad(regexp_extract(symbol, '([0-9]+)', 1), 6, '0') AS symbol, trade_date, CASE WHEN sysid > 1000000000000 THEN sysid % 1000000000000 ELSE sysid END AS sysid FROM"
SQL = {
    "instruments": "SELECT market, symbol, min(trade_date) AS first_day, max(trade_date) AS last_day, count(*) AS n_rows FROM event_feed GROUP BY ALL",
    "trade_records": f"""
WITH {TAPE},
t AS (SELECT *, coalesce(sum(volume) OVER (PARTITION BY symbol, trade_date, passive_id ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM sided)
SELECT t.symbol, t.trade_date, t.seqno, t.trade_date::BIGINT * 1000000000 + (ms // 3600000 * 10000 + ms // 60000 % 60 * 100 + ms // 1000 % 60) * 1000 + ms % 1000 AS stamp, t.cents, t.volume, t.side,
  t.active_id, t.passive_id, t.seqno - o.order_seq AS rested, (o.order_volume - taken)::BIGINT AS left_before
FROM t LEFT JOIN orders_first o ON o.symbol = t.symbol AND o.trade_date = t.trade_date AND o.sysid = t.passive_id""",
    "day_fingerprints": f"""
WITH {TAPE}
SELECT symbol, trade_date, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', seqno, actiontype, sysid, buyid, sellid, volume, cents)), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM timed GROUP BY ALL""",
    "event_props": """
WITH e AS (SELECT event_type, CAST(nullif(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1), '') AS BIGINT) AS k FROM events)
SELECT event_type, count(*) AS n, count(k) AS with_k, sum(k)::BIGINT AS k_sum, max(k) AS k_max FROM e GROUP BY ALL""",
    "filled_returns": f"""
WITH {MINUTES},
carried AS (SELECT ticker, session_date, minute, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker, session_date ORDER BY minute ROWS UNBOUNDED PRECEDING) AS c FROM grid),
changes AS (SELECT ticker, session_date, minute, c / lag(c, 5) OVER (PARTITION BY ticker, session_date ORDER BY minute) - 1 AS change FROM carried)
SELECT ticker, session_date, minute, round(change, 6) AS change, (row_number() OVER (PARTITION BY session_date, minute ORDER BY round(change, 12), ticker) - 1)::INTEGER AS place FROM changes WHERE change IS NOT NULL""",
    "key_union": f"SELECT trade_date, count(*) AS orders, count(DISTINCT symbol) AS symbols FROM ({_KEYS} order_rows UNION {_KEYS} trade_rows) GROUP BY ALL",
    "last_trade_at_order": f"""
WITH {TAPE}
SELECT o.symbol, o.trade_date, o.seqno, t.cents, o.seqno - t.seqno AS ago FROM (SELECT * FROM timed WHERE actiontype = 0) o
ASOF JOIN (SELECT * FROM timed WHERE actiontype = 2) t ON o.symbol = t.symbol AND o.trade_date = t.trade_date AND o.seqno > t.seqno""",
}
