"""Queries over books, builds and daily results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.clean import plain_id, six_digits
from tapeline.functions.stats import ratio, round_all
from tapeline.operators import bars, book, rolling
from tapeline.operators import tape as tapes
from tapeline.plans.flow import TAPE
from tapeline.sources.tables import table

_GOOD = "isfinite(price) AND price > 0 AND volume > 0 AND timeseconds IS NOT NULL"
_CENTS = "CAST(floor(({0} + 1e-6) * 100) AS BIGINT)"


def book_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return book.snapshots(tapes.tape(table(spark, d, "event_feed")))


def depth_features(spark: SparkSession, d: str) -> DataFrame:
    return round_all(book.depth_features(book_snapshots(spark, d)))


def repaired_prices(spark: SparkSession, d: str) -> DataFrame:
    return book.repaired_prices(table(spark, d, "lob_records"))


def level_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders and cancels of each five minutes by how deep in their own side's book they stand: crossing, first level, to 5, to 10, beyond."""
    rows = book.usable_book(table(spark, d, "lob_records")).where("ordertype IN ('wt', 'cl') AND direction IS NOT NULL")
    place = F.when(F.col("direction") == "B", F.col("bidposition")).otherwise(F.col("askposition"))
    depth = F.when(place == 0, 0).when(place == 1, 1).when(place <= 5, 5).when(place <= 10, 10).otherwise(11)
    slot = ((F.floor(F.col("timeseconds") / 300) + 1) * 300).cast("long")
    return rows.where(place.isNotNull()).groupBy(*tapes.DAY, slot.alias("slot"), "ordertype", "direction", depth.alias("depth")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def type_slots(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each five minutes by their aggressiveness and side."""
    rows = book.usable_book(table(spark, d, "lob_records")).where("ordertype = 'wt' AND direction IS NOT NULL")
    slot = ((F.floor(F.col("timeseconds") / 300) + 1) * 300).cast("long")
    return rows.groupBy(*tapes.DAY, slot.alias("slot"), "direction", book.aggressiveness().alias("kind")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def auction_uncross(spark: SparkSession, d: str) -> DataFrame:
    """Clearing of the orders of each five minutes as if they were called at once."""
    orders = tapes.tape(table(spark, d, "event_feed")).where("actiontype = 0 AND direction IS NOT NULL").select(
        *tapes.DAY, F.floor(F.col("ms") / 300_000).cast("long").alias("block"), F.col("direction").alias("side"), tapes.cents(F.col("price")).alias("cents"), "volume"
    )
    return book.uncross(orders, [*tapes.DAY, "block"])


def crossing_class(spark: SparkSession, d: str) -> DataFrame:
    return book.crossing_class(table(spark, d, "lob_records"))


def flow_rollup(spark: SparkSession, d: str) -> DataFrame:
    return round_all(book.flow_rollup(table(spark, d, "lob_records")))


def book_features(spark: SparkSession, d: str) -> DataFrame:
    return round_all(book.book_features(table(spark, d, "lob_records")))


def after_state(spark: SparkSession, d: str) -> DataFrame:
    return book.after_state(table(spark, d, "lob_records"))


def ordered_gaps(spark: SparkSession, d: str) -> DataFrame:
    return book.ordered_gaps(tapes.tape(table(spark, d, "event_feed")))


def second_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Changes by second of the minute and action, over all days."""
    t = tapes.tape(table(spark, d, "event_feed"))
    return t.groupBy(F.pmod(F.floor(F.col("ms") / 1000), F.lit(60)).cast("long").alias("second"), "actiontype").agg(F.count("*").alias("n"))


def bars_3s(spark: SparkSession, d: str) -> DataFrame:
    """Three-second trade bars, left-closed and labelled by their right edge, with the day's running high, low and VWAP."""
    bars_ = bars.trade_slots(tapes.tape(table(spark, d, "event_feed")), 3000)
    w = Window.partitionBy(*tapes.DAY).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return round_all(
        bars_.withColumns(
            {"day_high": F.max("high").over(w), "day_low": F.min("low").over(w), "day_vwap": ratio(F.sum("amount").over(w), F.sum("volume").over(w))}
        )
    )


def minute_slots(spark: SparkSession, d: str) -> DataFrame:
    """Every minute of every symbol and day with trades, what stood before carried over minutes without any."""
    return bars.every_slot(bars.trade_slots(tapes.tape(table(spark, d, "event_feed")), 60_000), 60_000)


def life_times(spark: SparkSession, d: str) -> DataFrame:
    return book.life_times(tapes.tape(table(spark, d, "event_feed")))


def id_index(spark: SparkSession, d: str) -> DataFrame:
    """What happened to each id: its first order, what was cancelled of it, its trades and how many others it traded with."""
    t = tapes.tape(table(spark, d, "event_feed"))
    cancels = t.where("actiontype = 1").groupBy(*tapes.DAY, "sysid").agg(F.sum("volume").alias("cancelled"))
    sides = F.inline(F.array(F.struct(F.col("buyid").alias("sysid"), F.col("sellid").alias("other")), F.struct(F.col("sellid").alias("sysid"), F.col("buyid").alias("other"))))
    trades = t.where("actiontype = 2").select(*tapes.DAY, "volume", sides).groupBy(*tapes.DAY, "sysid").agg(
        F.count("*").alias("trades"), F.sum("volume").alias("traded"), F.count_distinct("other").alias("others")
    )
    key = [*tapes.DAY, "sysid"]
    orders = tapes.first_orders(t).select(*key, "order_seq", "order_volume")
    return orders.join(cancels, key, "full").join(trades, key, "full").na.fill(0, ["cancelled", "trades", "traded", "others"])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each half hour by symbol and day, a column an action."""
    t = tapes.tape(table(spark, d, "event_feed"))
    wide = t.groupBy(*tapes.DAY, F.floor(F.col("ms") / 1_800_000).cast("long").alias("half_hour")).pivot("actiontype", [0, 1, 2]).agg(F.count(F.lit(1)))
    return wide.select(*tapes.DAY, "half_hour", *[F.coalesce(str(k), F.lit(0)).alias(n) for k, n in enumerate(("orders", "cancels", "trades"))])


def feed_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the two builds by day and type: on both sides, on A's only, on B's only."""
    rows = table(spark, d, "order_rows").select(
        "feed", six_digits(F.col("symbol")).alias("symbol"), "trade_date", plain_id(F.col("sysid")).alias("sysid"), "ordertype"
    )
    sides = rows.groupBy("symbol", "trade_date", "sysid", "ordertype").agg(F.max(F.col("feed") == "A").alias("a"), F.max(F.col("feed") == "B").alias("b"))
    return sides.groupBy("trade_date", "ordertype").agg(
        F.count_if(F.col("a") & F.col("b")).alias("both_sides"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only")
    )


def _builds(spark: SparkSession, d: str, feed: str) -> DataFrame:
    return table(spark, d, "trade_rows").where(F.col("feed") == feed).select(six_digits(F.col("symbol")).alias("symbol"), "trade_date")


def days_in_both(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and days that both builds have trades of."""
    return _builds(spark, d, "A").intersect(_builds(spark, d, "B"))


def days_in_one(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and days with trades in one build only."""
    a, b = _builds(spark, d, "A").distinct(), _builds(spark, d, "B").distinct()
    return a.subtract(b).withColumn("feed", F.lit("A")).unionByName(b.subtract(a).withColumn("feed", F.lit("B")))


def strategy_summary(spark: SparkSession, d: str) -> DataFrame:
    """Daily results a strategy: days, total, mean, deviation, t, win rate, largest fall from a running high."""
    daily = rolling.daily_net(table(spark, d, "daily_s1")).where("net IS NOT NULL")
    run = Window.partitionBy("strat").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_c", F.sum("net").over(run)).withColumn("_fall", F.max("_c").over(run) - F.col("_c"))
    stats = curve.groupBy("strat").agg(
        F.count("*").alias("days"), F.sum("net").alias("total"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"),
        F.avg((F.col("net") > 0).cast("double")).alias("wins"), F.max("_fall").alias("fall"),
    )
    return round_all(stats.withColumn("t", ratio(F.col("mean"), F.col("std")) * F.sqrt("days")), 4)


def strategy_weekdays(spark: SparkSession, d: str) -> DataFrame:
    """Mean net a strategy, one column a day of the week (0 is Monday)."""
    daily = rolling.daily_net(table(spark, d, "daily_s1")).where("net IS NOT NULL")
    wide = daily.withColumn("_w", F.weekday("day")).groupBy("strat").pivot("_w", list(range(7)))
    return round_all(wide.agg(F.avg("net")).select("strat", *[F.col(str(k)).alias(f"d{k}") for k in range(7)]), 4)


def held_position(spark: SparkSession, d: str) -> DataFrame:
    """A position that changes only when the net of the last 7 days leaves a band: +1 above, -1 below, else as it was."""
    daily = table(spark, d, "daily_s1")
    rolled = rolling.rolling(rolling.daily_net(daily), "strat", "day", "net", (7,), daily.select("strat").distinct().count())
    want = F.when(F.col("total") > 1000, 1).when(F.col("total") < -1000, -1)
    w = Window.partitionBy("strat").orderBy("asof")
    held = rolled.select("strat", "asof", F.coalesce(F.last(want, ignorenulls=True).over(w), F.lit(0)).alias("position"))
    return held.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))


def clean_specs(spark: SparkSession, d: str) -> DataFrame:
    """Order specifications with one spelling of market, side and symbol; repeated rows once."""
    specs = table(spark, d, "order_specs")
    market = F.lower(F.trim("market"))
    side = F.lower(F.trim("side"))
    return specs.select(
        "dispid",
        F.when(market.isin("101", "sh"), "sh").when(market.isin("102", "sz"), "sz").alias("market"),
        six_digits(F.col("symbol")).alias("symbol"),
        "trade_date",
        F.when(side.isin("1", "b", "buy"), "B").when(side.isin("2", "s", "sell"), "S").alias("side"),
        "qty",
    ).distinct()


def lot_schedule(spark: SparkSession, d: str, parts: int = 4) -> DataFrame:
    """Quantities cut into lots of 100 by weights 1..parts: whole lots first, what is left by the largest remainders."""
    specs = clean_specs(spark, d)
    lots = F.floor(F.col("qty") / 100).cast("long")
    total = parts * (parts + 1) // 2
    cut = specs.select("dispid", lots.alias("lots"), F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("slice")).withColumns(
        {
            "_w": F.floor(F.col("lots") * F.col("slice") / total).cast("long"),
            "_r": F.pmod(F.col("lots") * F.col("slice"), F.lit(total)).cast("long"),
        }
    )
    w = Window.partitionBy("dispid", "lots")
    rank = F.row_number().over(w.orderBy(F.desc("_r"), "slice"))
    short = F.col("lots") - F.sum("_w").over(w)
    return cut.withColumn("_k", rank).select("dispid", "slice", ((F.col("_w") + (F.col("_k") <= short).cast("long")) * 100).alias("qty"))


QUERIES = {
    f.__name__: f
    for f in (
        book_snapshots, depth_features, repaired_prices, level_ranges, type_slots, auction_uncross, crossing_class, flow_rollup, book_features, after_state, ordered_gaps, second_histogram, bars_3s, minute_slots,
        life_times, id_index, event_windows,
        feed_coverage, days_in_both, days_in_one, strategy_summary, strategy_weekdays, held_position, clean_specs, lot_schedule,
    )
}

_NET = """
days AS (
  SELECT strat, coalesce(try_strptime(date, '%Y%m%d'), try_strptime(date, '%Y-%m-%d'))::DATE AS day, net
  FROM daily_s1 QUALIFY row_number() OVER (PARTITION BY strat, coalesce(try_strptime(date, '%Y%m%d'), try_strptime(date, '%Y-%m-%d'))::DATE ORDER BY loaded_at DESC) = 1),
active AS (SELECT * FROM days WHERE net IS NOT NULL)"""
_SYM = "lpad(regexp_extract(symbol, '([0-9]+)', 1), 6, '0')"
_PLAIN = "CASE WHEN sysid > 1000000000000 THEN sysid % 1000000000000 ELSE sysid END"
_SPECS = f"""
specs AS (
  SELECT DISTINCT dispid, CASE WHEN lower(trim(market)) IN ('101', 'sh') THEN 'sh' WHEN lower(trim(market)) IN ('102', 'sz') THEN 'sz' END AS market,
    {_SYM} AS symbol, trade_date, CASE WHEN lower(trim(side)) IN ('1', 'b', 'buy') THEN 'B' WHEN lower(trim(side)) IN ('2', 's', 'sell') THEN 'S' END AS side, qty
  FROM order_specs)"""
_SLOTS = """
b AS (
  SELECT symbol, trade_date, CASE WHEN ms < 46800000 THEN least((ms // {0} + 1) * {0}, 41400000) ELSE least((ms // {0} + 1) * {0}, 54000000) END AS slot,
    arg_min(cents, seqno) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, seqno) AS close, sum(volume)::BIGINT AS volume, sum(cents * volume)::BIGINT AS amount, count(*) AS n
  FROM timed WHERE actiontype = 2 AND ms >= 34200000 GROUP BY ALL)"""

_BOOK = f"""
WITH {TAPE},
touched AS (
  SELECT symbol, trade_date, seqno, actiontype, ms, volume, unnest([buyid, sellid]) AS sysid FROM timed WHERE actiontype = 2
  UNION ALL SELECT symbol, trade_date, seqno, actiontype, ms, volume, sysid FROM timed WHERE actiontype = 1),
known AS (
  SELECT t.*, o.order_side, o.order_cents, o.order_volume,
    sum(t.volume) OVER (PARTITION BY t.symbol, t.trade_date, t.sysid ORDER BY t.seqno, t.actiontype ROWS UNBOUNDED PRECEDING) AS s
  FROM touched t JOIN orders_first o USING (symbol, trade_date, sysid) WHERE t.seqno >= o.order_seq),
deltas AS (
  SELECT symbol, trade_date, order_side AS side, order_cents AS cents, order_ms // 900000 AS period, order_volume AS delta, (order_volume > 0)::INT AS dn FROM orders_first
  UNION ALL SELECT symbol, trade_date, order_side, order_cents, ms // 900000, -least(volume, greatest(order_volume - (s - volume), 0)),
    -(order_volume - (s - volume) > 0 AND volume >= order_volume - (s - volume))::INT FROM known),
summed AS (SELECT symbol, trade_date, side, cents, period, sum(delta) AS delta, sum(dn) AS dn FROM deltas WHERE side IS NOT NULL GROUP BY ALL),
ends AS (SELECT symbol, trade_date, max(period) AS hi FROM summed GROUP BY ALL),
standing AS (
  SELECT *, sum(delta) OVER w AS volume, sum(dn) OVER w AS orders, lead(period) OVER w AS nxt FROM summed WINDOW w AS (PARTITION BY symbol, trade_date, side, cents ORDER BY period)),
every AS (
  SELECT symbol, trade_date, side, cents, volume, orders, unnest(generate_series(period, coalesce(nxt - 1, hi))) AS period
  FROM standing JOIN ends USING (symbol, trade_date) WHERE volume > 0),
levels AS (
  SELECT symbol, trade_date, period, side, row_number() OVER (PARTITION BY symbol, trade_date, period, side ORDER BY CASE side WHEN 'B' THEN -cents ELSE cents END)::INTEGER AS level,
    cents, volume::BIGINT AS volume, orders::BIGINT AS orders FROM every QUALIFY level <= 10)"""
_DEPTH = ", ".join(
    f"coalesce(sum(volume) FILTER (side = '{s}' AND level <= 5), 0)::BIGINT AS {n}_few, coalesce(sum(volume) FILTER (side = '{s}'), 0)::BIGINT AS {n}_all, max(cents) FILTER (side = '{s}' AND level = 5) AS {n}_price_5, "
    + ", ".join(f"coalesce(sum(volume) FILTER (side = '{s}' AND away <= {k}), 0)::BIGINT AS {n}_within_{k}" for k in (5, 20))
    for n, s in (("bid", "B"), ("ask", "S"))
)
_TYPES = f"""
WITH o AS (
  SELECT *, CASE direction WHEN 'B' THEN 1 ELSE -1 END AS sign, CASE direction WHEN 'B' THEN akp1 ELSE bdp1 END AS far, CASE direction WHEN 'B' THEN bdp1 ELSE akp1 END AS near,
    CASE direction WHEN 'B' THEN akv1 ELSE bdv1 END AS fv FROM lob_records WHERE {_GOOD} AND ordertype = 'wt' AND direction IS NOT NULL),
k AS (SELECT *, {_CENTS.format('price')} * sign AS p, CASE WHEN isfinite(far) AND far > 0 THEN {_CENTS.format('far')} * sign END AS f, CASE WHEN isfinite(near) AND near > 0 THEN {_CENTS.format('near')} * sign END AS n FROM o)"""
_KIND = "CASE WHEN p > f AND volume >= coalesce(fv, 0) THEN 1 WHEN p = f AND volume >= coalesce(fv, 0) THEN 2 WHEN p >= f THEN 3 WHEN p < f AND p > n THEN 4 WHEN p = n THEN 5 WHEN p < n THEN 6 ELSE 0 END"

SQL = {
    "book_snapshots": f"{_BOOK} SELECT * FROM levels",
    "depth_features": f"""{_BOOK},
away AS (SELECT *, abs(cents - first_value(cents) OVER (PARTITION BY symbol, trade_date, period, side ORDER BY level)) AS away FROM levels),
sums AS (
  SELECT symbol, trade_date, period, {_DEPTH} FROM away GROUP BY ALL)
SELECT *, round((bid_few - ask_few)::DOUBLE / nullif(bid_few + ask_few, 0), 6) AS imbalance_few, round((bid_all - ask_all)::DOUBLE / nullif(bid_all + ask_all, 0), 6) AS imbalance_all FROM sums""",
    "repaired_prices": """
WITH own AS (
  SELECT symbol, trade_date, sysid, price AS own FROM lob_records WHERE ordertype = 'wt' AND isfinite(price) AND price > 0
  QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, sysid ORDER BY seqno, rec_id) = 1),
bad AS (SELECT *, CASE direction WHEN 'B' THEN akp1 WHEN 'S' THEN bdp1 END AS other FROM lob_records LEFT JOIN own USING (symbol, trade_date, sysid) WHERE NOT coalesce(isfinite(price) AND price > 0, false)),
fit AS (SELECT *, CASE WHEN isfinite(other) AND other > 0 THEN other END AS o FROM bad)
SELECT rec_id, ordertype, CASE WHEN ordertype = 'cl' THEN coalesce(own, o) ELSE o END AS price FROM fit""",
    "level_ranges": f"""
WITH r AS (
  SELECT *, CASE direction WHEN 'B' THEN bidposition ELSE askposition END AS place FROM lob_records WHERE {_GOOD} AND ordertype IN ('wt', 'cl') AND direction IS NOT NULL)
SELECT symbol, trade_date, CAST((floor(timeseconds / 300) + 1) * 300 AS BIGINT) AS slot, ordertype, direction, CASE WHEN place = 0 THEN 0 WHEN place = 1 THEN 1 WHEN place <= 5 THEN 5 WHEN place <= 10 THEN 10 ELSE 11 END AS depth,
  count(*) AS n, sum(volume)::BIGINT AS volume FROM r WHERE place IS NOT NULL GROUP BY ALL""",
    "type_slots": f"{_TYPES} SELECT symbol, trade_date, CAST((floor(timeseconds / 300) + 1) * 300 AS BIGINT) AS slot, direction, {_KIND} AS kind, count(*) AS n, sum(volume)::BIGINT AS volume FROM k GROUP BY ALL",
    "auction_uncross": f"""
WITH {TAPE},
called AS (SELECT symbol, trade_date, ms // 300000 AS block, direction AS side, cents, volume FROM timed WHERE actiontype = 0 AND direction IS NOT NULL),
prices AS (SELECT DISTINCT symbol, trade_date, block, cents FROM called),
curve AS (
  SELECT p.symbol, p.trade_date, p.block, p.cents, coalesce(sum(c.volume) FILTER (c.side = 'B' AND c.cents >= p.cents), 0) AS demand,
    coalesce(sum(c.volume) FILTER (c.side = 'S' AND c.cents <= p.cents), 0) AS supply
  FROM prices p JOIN called c ON c.symbol = p.symbol AND c.trade_date = p.trade_date AND c.block = p.block GROUP BY ALL)
SELECT symbol, trade_date, block, cents AS clear_cents, least(demand, supply)::BIGINT AS executed, (demand - supply)::BIGINT AS surplus
FROM curve WHERE least(demand, supply) > 0
QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, block ORDER BY least(demand, supply) DESC, abs(demand - supply), cents DESC) = 1""",
    "crossing_class": f"{_TYPES} SELECT trade_date, direction, {_KIND} AS kind, count(*) AS n, sum(volume)::BIGINT AS volume FROM k GROUP BY ALL",
    "flow_rollup": f"""
WITH r AS (SELECT symbol, trade_date, CAST((floor(timeseconds / 300) + 1) * 300 AS BIGINT) AS slot, ordertype, direction, price, volume, seqno, rec_id FROM lob_records WHERE {_GOOD})
SELECT symbol, trade_date, slot, ordertype, direction, count(*) AS n, sum(volume)::BIGINT AS volume, round(sum(price * volume) / sum(volume), 6) AS vwap,
  round(arg_max(price, seqno * 1000000000 + rec_id), 6) AS last_price
FROM r GROUP BY GROUPING SETS ((symbol, trade_date, slot, ordertype, direction), (symbol, trade_date, slot, ordertype), (symbol, trade_date, slot))""",
    "book_features": f"""
WITH good AS (
  SELECT *, CAST(floor(timeseconds / 60) AS BIGINT) AS minute FROM lob_records
  WHERE {_GOOD} AND isfinite(bdp1) AND isfinite(akp1) AND bdp1 > 0 AND akp1 > bdp1),
lasts AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, minute ORDER BY seqno DESC, rec_id DESC) = 1),
grid AS (SELECT symbol, trade_date, unnest(generate_series(min(minute), max(minute))) AS minute FROM lasts GROUP BY symbol, trade_date),
states AS (
  SELECT symbol, trade_date, minute, (bdp1 + akp1) / 2 AS mid, akp1 - bdp1 AS spread, (bdp1 * akv1 + akp1 * bdv1) / nullif(bdv1 + akv1, 0) AS micro,
    (bdv1 - akv1)::DOUBLE / nullif(bdv1 + akv1, 0) AS imb, true AS fresh FROM lasts)
SELECT symbol, trade_date, minute, coalesce(fresh, false) AS fresh, round(last_value(mid IGNORE NULLS) OVER w, 6) AS mid, round(last_value(spread IGNORE NULLS) OVER w, 6) AS spread,
  round(last_value(micro IGNORE NULLS) OVER w, 6) AS micro, round(last_value(imb IGNORE NULLS) OVER w, 6) AS imb
FROM grid LEFT JOIN states USING (symbol, trade_date, minute)
WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY minute ROWS UNBOUNDED PRECEDING)""",
    "after_state": """
SELECT rec_id, coalesce(lead(bdp1) OVER w, bdp1) AS bdp1_after, coalesce(lead(bdv1) OVER w, bdv1) AS bdv1_after, coalesce(lead(akp1) OVER w, akp1) AS akp1_after,
  coalesce(lead(akv1) OVER w, akv1) AS akv1_after FROM lob_records WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY seqno, rec_id)""",
    "ordered_gaps": f"""
WITH {TAPE}, p AS (SELECT *, lag(ms) OVER (PARTITION BY symbol, trade_date ORDER BY seqno) AS before FROM tape WHERE actiontype = 0),
g AS (SELECT symbol, trade_date, ms - before - CASE WHEN before < 41400000 AND ms >= 46800000 THEN 5400000 ELSE 0 END AS gap FROM p WHERE before IS NOT NULL)
SELECT symbol, trade_date, count(*) AS n, sum(gap)::BIGINT AS gap_sum, median(gap)::DOUBLE AS gap_median, max(gap) AS gap_max FROM g GROUP BY ALL""",
    "second_histogram": f"WITH {TAPE} SELECT ms // 1000 % 60 AS second, actiontype, count(*) AS n FROM tape GROUP BY ALL",
    "bars_3s": f"""
WITH {TAPE}, {_SLOTS.format(3000)}
SELECT *, max(high) OVER w AS day_high, min(low) OVER w AS day_low, round(sum(amount) OVER w / sum(volume) OVER w, 6) AS day_vwap
FROM b WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY slot ROWS UNBOUNDED PRECEDING)""",
    "minute_slots": f"""
WITH {TAPE}, {_SLOTS.format(60000)},
grid AS (SELECT symbol, trade_date, unnest(generate_series(34260000, 41400000, 60000) || generate_series(46860000, 54000000, 60000)) AS slot FROM (SELECT DISTINCT symbol, trade_date FROM b))
SELECT symbol, trade_date, slot, coalesce(n, 0) AS n, last_value(close IGNORE NULLS) OVER w AS last, max(high) OVER w AS day_high, min(low) OVER w AS day_low,
  coalesce(sum(volume) OVER w, 0)::BIGINT AS day_volume, coalesce(sum(amount) OVER w, 0)::BIGINT AS day_amount, CASE WHEN slot > 53820000 THEN 1 WHEN n IS NULL THEN 2 ELSE 0 END AS flag
FROM grid LEFT JOIN b USING (symbol, trade_date, slot) WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY slot ROWS UNBOUNDED PRECEDING)""",
    "life_times": f"""
WITH {TAPE}, e AS (
  SELECT symbol, trade_date, seqno, actiontype, ms, coalesce(lag(ms) OVER (PARTITION BY symbol, trade_date ORDER BY seqno), ms) AS since FROM tape WHERE actiontype = 0
  UNION ALL SELECT t.symbol, t.trade_date, t.seqno, t.actiontype, t.ms, o.order_ms FROM tape t LEFT JOIN orders_first o USING (symbol, trade_date, sysid) WHERE t.actiontype = 1
  UNION ALL SELECT t.symbol, t.trade_date, t.seqno, t.actiontype, t.ms, o.order_ms FROM sided t LEFT JOIN orders_first o ON o.symbol = t.symbol AND o.trade_date = t.trade_date AND o.sysid = t.passive_id)
SELECT symbol, trade_date, seqno, actiontype, ms - since - CASE WHEN since < 43200000 AND ms > 43200000 THEN 5400000 ELSE 0 END AS life_ms FROM e""",
    "id_index": f"""
WITH {TAPE},
c AS (SELECT symbol, trade_date, sysid, sum(volume) AS cancelled FROM tape WHERE actiontype = 1 GROUP BY ALL),
s AS (SELECT symbol, trade_date, buyid AS sysid, sellid AS other, volume FROM tape WHERE actiontype = 2 UNION ALL SELECT symbol, trade_date, sellid, buyid, volume FROM tape WHERE actiontype = 2),
t AS (SELECT symbol, trade_date, sysid, count(*) AS trades, sum(volume) AS traded, count(DISTINCT other) AS others FROM s GROUP BY ALL)
SELECT symbol, trade_date, sysid, order_seq, order_volume, coalesce(cancelled, 0)::BIGINT AS cancelled, coalesce(trades, 0) AS trades, coalesce(traded, 0)::BIGINT AS traded, coalesce(others, 0) AS others
FROM orders_first FULL JOIN c USING (symbol, trade_date, sysid) FULL JOIN t USING (symbol, trade_date, sysid)""",
    "event_windows": f"WITH {TAPE} SELECT symbol, trade_date, ms // 1800000 AS half_hour, count(*) FILTER (actiontype = 0) AS orders, count(*) FILTER (actiontype = 1) AS cancels, count(*) FILTER (actiontype = 2) AS trades FROM tape GROUP BY ALL",
    "feed_coverage": f"""
WITH k AS (SELECT {_SYM} AS symbol, trade_date, {_PLAIN} AS sysid, ordertype, max((feed = 'A')::INT) AS a, max((feed = 'B')::INT) AS b FROM order_rows GROUP BY ALL)
SELECT trade_date, ordertype, count(*) FILTER (a = 1 AND b = 1) AS both_sides, count(*) FILTER (a = 1 AND b = 0) AS a_only, count(*) FILTER (a = 0 AND b = 1) AS b_only FROM k GROUP BY ALL""",
    "days_in_both": f"SELECT {_SYM} AS symbol, trade_date FROM trade_rows WHERE feed = 'A' INTERSECT SELECT {_SYM}, trade_date FROM trade_rows WHERE feed = 'B'",
    "days_in_one": f"""
SELECT *, 'A' AS feed FROM (SELECT {_SYM} AS symbol, trade_date FROM trade_rows WHERE feed = 'A' EXCEPT SELECT {_SYM}, trade_date FROM trade_rows WHERE feed = 'B')
UNION ALL SELECT *, 'B' FROM (SELECT {_SYM} AS symbol, trade_date FROM trade_rows WHERE feed = 'B' EXCEPT SELECT {_SYM}, trade_date FROM trade_rows WHERE feed = 'A')""",
    "strategy_summary": f"""
WITH {_NET}, c AS (SELECT *, sum(net) OVER (PARTITION BY strat ORDER BY day) AS c FROM active), f AS (SELECT *, max(c) OVER (PARTITION BY strat ORDER BY day) - c AS fall FROM c)
SELECT strat, count(*) AS days, round(sum(net), 4) AS total, round(avg(net), 4) AS mean, round(stddev_samp(net), 4) AS std, round(avg((net > 0)::INT), 4) AS wins, round(max(fall), 4) AS fall,
  round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(count(*)), 4) AS t FROM f GROUP BY ALL""",
    "strategy_weekdays": f"WITH {_NET} SELECT strat, "
    + ", ".join(f"round(avg(net) FILTER (isodow(day) = {k + 1}), 4) AS d{k}" for k in range(7))
    + " FROM active GROUP BY ALL",
    "held_position": f"""
WITH {_NET}, spine AS (SELECT strat, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM active GROUP BY strat),
r AS (SELECT s.strat, s.d, coalesce(sum(a.net), 0) AS total FROM spine s LEFT JOIN active a ON a.strat = s.strat AND a.day <= s.d AND a.day > s.d - 7 GROUP BY ALL),
h AS (SELECT strat, d, coalesce(last_value(CASE WHEN total > 1000 THEN 1 WHEN total < -1000 THEN -1 END IGNORE NULLS) OVER (PARTITION BY strat ORDER BY d ROWS UNBOUNDED PRECEDING), 0) AS position FROM r)
SELECT strat, d AS "asof", position, abs(position - coalesce(lag(position) OVER (PARTITION BY strat ORDER BY d), 0)) AS turnover FROM h""",
    "clean_specs": f"WITH {_SPECS} SELECT * FROM specs",
    "lot_schedule": f"""
WITH {_SPECS}, c AS (SELECT dispid, qty // 100 AS lots, unnest([1, 2, 3, 4])::INTEGER AS slice FROM specs),
w AS (SELECT *, lots * slice // 10 AS w, lots * slice % 10 AS r FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY dispid, lots ORDER BY r DESC, slice) AS k, lots - sum(w) OVER (PARTITION BY dispid, lots) AS short FROM w)
SELECT dispid, slice, ((w + (k <= short)::INT) * 100)::BIGINT AS qty FROM k""",
}
