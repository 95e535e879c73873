"""Queries over factor panels, auctions and windows, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.clean import plain_id, six_digits
from tapeline.functions.stats import ratio, round_all, rank_ic
from tapeline.operators import auction, book, evaluate, panel, rolling
from tapeline.operators import tape as tapes
from tapeline.plans import bars as bar_plans
from tapeline.plans.bars import MINUTES, corr, ranks
from tapeline.plans.flow import _B, _SUM, TAPE, _imb
from tapeline.sources.tables import table

FEATURES = ["trd_imb", "ord_imb_vol", "cxl_ratio", "age_imb"]
LEAST = 5
BLOCK = [*tapes.DAY, "block"]


def _tape(spark: SparkSession, d: str) -> DataFrame:
    return tapes.tape(table(spark, d, "event_feed"))


def _called(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each five minutes, as if they were called at once."""
    return _tape(spark, d).where("actiontype = 0 AND direction IS NOT NULL").select(
        *tapes.DAY, F.floor(F.col("ms") / 300_000).cast("long").alias("block"), F.col("direction").alias("side"), F.col("seqno").alias("id"), tapes.cents(F.col("price")).alias("cents"), "volume"
    )


def auction_statistics(spark: SparkSession, d: str) -> DataFrame:
    return auction.statistics(_called(spark, d), BLOCK)


def auction_residual(spark: SparkSession, d: str) -> DataFrame:
    return auction.residual(_called(spark, d), BLOCK)


def market_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the order-flow factors over all symbols in each minute."""
    return round_all(panel.market_means(panel.flow_panel(_tape(spark, d)), FEATURES, panel.MOMENT))


def training_table(spark: SparkSession, d: str) -> DataFrame:
    """Two factor panels joined, ranked at each minute, with the skipped return as label."""
    full = panel.with_labels(panel.flow_panel(_tape(spark, d)))
    return round_all(panel.ranked(full, FEATURES, "ret_skip", panel.MOMENT).select(*_B.split(", "), *FEATURES, "ret_skip", "y_rank"))


def ic_horizons(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the trade imbalance with returns over seven horizons: the mean of each day, then over days."""
    full = panel.with_labels(panel.flow_panel(_tape(spark, d)))
    ics = evaluate.ic_by_horizon(full, "trd_imb", {h: f"ret_{h}" for h in panel.HORIZONS}, panel.MOMENT, LEAST)
    return round_all(evaluate.summary(ics.groupBy("trade_date", "horizon").agg(F.avg("ic").alias("ic")), ["horizon"], "ic"))


def symbol_profiles(spark: SparkSession, d: str) -> DataFrame:
    return round_all(panel.profiles(panel.flow_panel(_tape(spark, d)), "symbol", "trade_date"))


def symbol_groups(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in two groups of like profiles, by k-means over their standardised logs."""
    profile = panel.profiles(panel.flow_panel(_tape(spark, d)), "symbol", "trade_date").where("activity > 0 AND size > 0")
    logs = profile.select("symbol", F.log10("activity").alias("activity"), "informed", F.log10("size").alias("size"), "cancels")
    return panel.groups(logs, ["activity", "informed", "size", "cancels"], 2)


def group_ic(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the eaten orders' age with the skipped return, within each group of symbols."""
    full = panel.with_labels(panel.flow_panel(_tape(spark, d)))
    grouped = full.join(symbol_groups(spark, d).select("symbol", "grp"), "symbol")
    ics = rank_ic(grouped, "age_imb", "ret_skip", [*panel.MOMENT, "grp"], 3)
    return round_all(evaluate.summary(ics.groupBy("trade_date", "grp").agg(F.avg("ic").alias("ic")), ["grp"], "ic"))


def decile_steadiness(spark: SparkSession, d: str) -> DataFrame:
    return round_all(panel.monotonicity(bar_plans.panel(spark, d), "ret_15", "label_15", ["session_date"], bar_plans.TIME))


def build_match(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the two builds' trade rows that agree within a hundredth."""
    rows = table(spark, d, "trade_rows").select(
        "feed", "row_no", six_digits(F.col("symbol")).alias("symbol"), "trade_date", plain_id(F.col("sysid")).alias("sysid"), *_MATCHED
    )
    first = rows.groupBy("feed", *_KEY).agg(F.min(F.struct("row_no", *_MATCHED)).alias("_r")).select("feed", *_KEY, "_r.*")
    a, b = (first.where(F.col("feed") == x).drop("feed") for x in "AB")
    return round_all(panel.matches(a, b, _KEY, _MATCHED))


def rhythm(spark: SparkSession, d: str) -> DataFrame:
    """Power of trading at periods from five seconds to half an hour, from the mean curve of the day."""
    t = tapes.in_sessions(_tape(spark, d).where("actiontype = 2"))
    days = table(spark, d, "event_feed").select("trade_date").distinct().count()
    return round_all(panel.spectrum(t.withColumn("second", F.floor(F.col("ms") / 1000).cast("long")), "second", days))


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Trades of the last 600 seconds every 300 seconds: each trade goes into the two windows that cover it."""
    t = tapes.in_sessions(_tape(spark, d).where("actiontype = 2"))
    first = ((F.floor(F.col("ms") / 300_000) + 1) * 300).cast("long")
    return t.select(*tapes.DAY, F.explode(F.array(first, first + 300)).alias("until"), "volume").groupBy(*tapes.DAY, "until").agg(
        F.count("*").alias("n"), F.sum("volume").alias("volume")
    )


def sequence_bins(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each minute in 32 equal parts of it: one row a part that has any."""
    t = tapes.in_sessions(_tape(spark, d))
    part = F.floor(F.pmod("ms", F.lit(60_000)) / 1875).cast("int")
    trade = F.col("actiontype") == 2
    return t.groupBy(*_B.split(", "), part.alias("part")).agg(
        F.count("*").alias("n"), F.count_if(trade).alias("trades"), F.sum(F.when(trade, F.col("volume")).otherwise(0)).alias("traded")
    )


def mid_right_closed(spark: SparkSession, d: str) -> DataFrame:
    """Mid price of the last row up to and at each full minute, carried over minutes without a row."""
    lob = table(spark, d, "lob_records").where("timeseconds IS NOT NULL AND bdp1 > 0 AND akp1 > bdp1")
    minute = F.ceil(F.round(F.col("timeseconds") * 1000) / 60_000).cast("long")
    last = lob.groupBy(*tapes.DAY, minute.alias("minute")).agg(F.max(F.struct("seqno", "rec_id", ((F.col("bdp1") + F.col("akp1")) / 2).alias("mid")))["mid"].alias("mid"))
    grid = last.groupBy(*tapes.DAY).agg(F.min("minute").alias("_a"), F.max("minute").alias("_b")).select(*tapes.DAY, F.explode(F.sequence("_a", "_b")).alias("minute"))
    w = Window.partitionBy(*tapes.DAY).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return round_all(grid.join(last, [*tapes.DAY, "minute"], "left").withColumn("mid", F.last("mid", ignorenulls=True).over(w)))


def phase_cancels(spark: SparkSession, d: str) -> DataFrame:
    """Cancels so far within each phase of the day (before the open, morning, afternoon, close), by minute."""
    ms = F.col("ms")
    phase = F.when(ms < tapes.MORNING[0], 0).when(ms < tapes.AFTERNOON[0], 1).when(ms < tapes.AFTERNOON[1], 2).otherwise(3)
    cancels = _tape(spark, d).where("actiontype = 1").withColumns({"phase": phase, "minute": F.floor(ms / tapes.MINUTE_MS).cast("long")})
    by_minute = cancels.groupBy(*tapes.DAY, "phase", "minute").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    w = Window.partitionBy(*tapes.DAY, "phase").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return by_minute.withColumns({"n": F.sum("n").over(w), "volume": F.sum("volume").over(w)})


def strategy_growth(spark: SparkSession, d: str) -> DataFrame:
    """Each strategy's running product of daily returns (basis points of the row loaded last), as a factor."""
    daily = table(spark, d, "daily_s1").select(
        "strat", F.coalesce(F.try_to_date(F.col("date"), "yyyyMMdd"), F.try_to_date(F.col("date"), "yyyy-MM-dd")).alias("day"), F.nanvl("bp", F.lit(None).cast("double")).alias("bp"), "loaded_at"
    ).where("strat IS NOT NULL AND day IS NOT NULL")
    last = daily.groupBy("strat", "day").agg(F.max(F.struct("loaded_at", "bp"))["bp"].alias("bp")).where("bp IS NOT NULL")
    w = Window.partitionBy("strat").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return round_all(last.select("strat", "day", F.exp(F.sum(F.log1p(F.col("bp") / 10_000)).over(w)).alias("growth")))


def busiest(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    """The symbols of each day with the most traded, of those that begin with 0, 3 or 6 and trade between 5 and 200 on average."""
    trades = _tape(spark, d).where("actiontype = 2").where(F.substring("symbol", 1, 1).isin("0", "3", "6"))
    sums = trades.groupBy(*tapes.DAY).agg(F.sum("volume").alias("volume"), F.avg("price").alias("price")).where(F.col("price").between(5, 200))
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("volume"), "symbol"))
    return round_all(sums.withColumn("place", rank).where(F.col("place") <= most))


def next_session(spark: SparkSession, d: str) -> DataFrame:
    """Each strategy day with the first session on or after it (as-of forward), by one window over both kinds of day, read backwards."""
    days = rolling.daily_net(table(spark, d, "daily_s1")).select("day").distinct().withColumn("session", F.lit(None).cast("date"))
    sessions = table(spark, d, "sessions").select(F.to_date("session_date").alias("day")).distinct().withColumn("session", F.col("day"))
    # days of a calendar: a few thousand rows, whatever the data's size
    w = Window.orderBy(F.desc("day"), F.col("session").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = days.withColumn("own", F.lit(True)).unionByName(sessions.withColumn("own", F.lit(False)))
    return both.withColumn("session", F.last("session", ignorenulls=True).over(w)).where("own").select("day", "session")


def order_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far each order's price is from the best of both sides, in price and as a ratio of the mid."""
    orders = book.usable_book(table(spark, d, "lob_records")).where("ordertype = 'wt' AND bdp1 > 0 AND akp1 > bdp1")
    mid = (F.col("bdp1") + F.col("akp1")) / 2
    away = {"to_bid": F.col("price") - F.col("bdp1"), "to_ask": F.col("akp1") - F.col("price")}
    return round_all(orders.select("rec_id", *[x.alias(n) for n, x in away.items()], *[ratio(x, mid).alias(f"{n}_ratio") for n, x in away.items()]))


def position_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each five minutes by where they stand in their own side's book: active (no place, they cross), passive, mean and most used place."""
    orders = book.usable_book(table(spark, d, "lob_records")).where("ordertype = 'wt' AND direction IS NOT NULL")
    place = F.when(F.col("direction") == "B", F.col("bidposition")).otherwise(F.col("askposition"))
    slot = ((F.floor(F.col("timeseconds") / 300) + 1) * 300).cast("long")
    keys = [*tapes.DAY, "slot", "direction"]
    by_place = orders.groupBy(*tapes.DAY, slot.alias("slot"), "direction", place.alias("place")).agg(F.count("*").alias("n"), F.sum("volume").alias("v"))
    active = F.col("place") == 0
    n, v = F.sum("n"), F.sum("v")
    return round_all(
        by_place.where("place IS NOT NULL")
        .groupBy(*keys)
        .agg(
            n.alias("n"),
            ratio(F.sum(F.when(active, F.col("n")).otherwise(0)), n).alias("active_share"),
            ratio(F.sum(F.when(active, F.col("v")).otherwise(0)), v).alias("active_volume"),
            ratio(F.sum(F.col("place") * F.col("n")), F.sum(F.when(~active, F.col("n")).otherwise(0))).alias("mean_place"),
            F.min(F.when(~active, F.struct(-F.col("v"), "place")))["place"].alias("most_used"),
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        auction_statistics, auction_residual, market_means, training_table, ic_horizons, symbol_profiles, symbol_groups, group_ic, decile_steadiness,
        build_match, rhythm, sliding_counts, sequence_bins, mid_right_closed, phase_cancels, strategy_growth, busiest, next_session, order_distance,
        position_statistics,
    )
}

_KEY = ["symbol", "trade_date", "sysid"]
_MATCHED = ["trans_vlm", "vwap", "act_vlm", "pas_vlm", "act_num", "pas_num"]
_K = "symbol, trade_date, block"
_CALLED = f"""
WITH {TAPE},
called AS (SELECT symbol, trade_date, ms // 300000 AS block, direction AS side, seqno AS id, cents, volume FROM timed WHERE actiontype = 0 AND direction IS NOT NULL),
prices AS (SELECT DISTINCT {_K}, cents FROM called),
curve AS (
  SELECT {_K}, p.cents, coalesce(sum(c.volume) FILTER (c.side = 'B' AND c.cents >= p.cents), 0) AS demand, coalesce(sum(c.volume) FILTER (c.side = 'S' AND c.cents <= p.cents), 0) AS supply
  FROM prices p JOIN called c USING ({_K}) GROUP BY {_K}, p.cents),
clear AS (
  SELECT {_K}, cents AS clear_cents, least(demand, supply) AS executed FROM curve WHERE least(demand, supply) > 0
  QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY least(demand, supply) DESC, abs(demand - supply), cents DESC) = 1),
used AS (
  SELECT c.*, clear_cents, coalesce(executed, 0) AS executed,
    sum(volume) OVER (PARTITION BY {_K}, side ORDER BY CASE side WHEN 'B' THEN -cents ELSE cents END, id ROWS UNBOUNDED PRECEDING) AS used
  FROM called c LEFT JOIN clear USING ({_K}))"""
_SIDE = ", ".join(
    f"{_SUM.format('volume', s)}::BIGINT AS {n}_volume, count(*) FILTER ({s}) AS {n}_orders, sum(cents * volume) FILTER ({s})::DOUBLE / (sum(volume) FILTER ({s}) * 100) AS {n}_vwap, "
    f"{_SUM.format('volume', s + ' AND cents * volume >= 50000000')}::BIGINT AS {n}_big"
    for n, s in (("buy", "side = 'B'"), ("sell", "side = 'S'"))
)
_DEMAND, _SUPPLY = _SUM.format("volume", "side = 'B' AND cents >= clear_cents"), _SUM.format("volume", "side = 'S' AND cents <= clear_cents")
_PANEL = f"""
WITH {TAPE},
cut AS (SELECT symbol, trade_date, quantile_cont(volume, 0.9) AS large_at FROM sessed WHERE actiontype = 0 GROUP BY ALL),
flows AS (
  SELECT {_B}, actiontype, direction, volume FROM sessed WHERE actiontype <> 2
  UNION ALL SELECT {_B}, actiontype, CASE WHEN by_buyer THEN 'B' ELSE 'S' END, volume FROM ours),
orders_ AS (
  SELECT {_B}, count(*) FILTER (actiontype = 0) AS n_ord,
    {_imb(_SUM.format('volume', "actiontype = 2 AND direction = 'B'"), _SUM.format('volume', "actiontype = 2 AND direction = 'S'"))} AS trd_imb,
    {_imb(_SUM.format('volume', "actiontype = 0 AND direction = 'B'"), _SUM.format('volume', "actiontype = 0 AND direction = 'S'"))} AS ord_imb_vol,
    sum(volume) FILTER (actiontype = 0)::DOUBLE / nullif(count(*) FILTER (actiontype = 0), 0) AS mean_size,
    count(*) FILTER (actiontype = 1)::DOUBLE / nullif(count(*) FILTER (actiontype = 0), 0) AS cxl_ratio
  FROM flows GROUP BY ALL),
aged AS (
  SELECT {_B}, sum(volume * ln(1 + abs(buyid - sellid))) FILTER (by_buyer) / sum(volume) FILTER (by_buyer) AS b,
    sum(volume * ln(1 + abs(buyid - sellid))) FILTER (NOT by_buyer) / sum(volume) FILTER (NOT by_buyer) AS s FROM ours GROUP BY ALL),
lasts AS (SELECT {_B}, arg_max(price, seqno) AS px FROM sessed WHERE actiontype = 2 GROUP BY ALL),
carried AS (
  SELECT o.*, {_imb('b', 's')} AS age_imb, last_value(px IGNORE NULLS) OVER (PARTITION BY symbol, trade_date, sess ORDER BY bkt ROWS UNBOUNDED PRECEDING) AS last_px
  FROM orders_ o JOIN aged USING ({_B}) LEFT JOIN lasts USING ({_B})),
panel AS (
  SELECT *, lead(last_px, 2) OVER w / lead(last_px) OVER w - 1 AS ret_skip, {', '.join(f"lead(last_px, {1 + h}) OVER w / lead(last_px) OVER w - 1 AS ret_{h}" for h in panel.HORIZONS)}
  FROM carried WINDOW w AS (PARTITION BY symbol, trade_date, sess ORDER BY bkt))"""
_M = "trade_date, sess, bkt"


def _pct(x: str) -> str:
    tied = f"rank() OVER (PARTITION BY {_M}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {_M}, {x}) - 1) / 2.0::DOUBLE"
    return f"round(CASE WHEN {x} IS NOT NULL THEN ({tied}) / count({x}) OVER (PARTITION BY {_M}) END, 6)"


def _horizon(h: int) -> str:
    by = f"{_M}, horizon"
    source = f"(SELECT *, {h} AS horizon FROM panel)"
    return (
        f"SELECT {by}, round({corr('rx', 'ry')}, 12) AS ic FROM ({ranks('trd_imb', f'ret_{h}', by, source)}) GROUP BY ALL "
        f"HAVING count(*) >= {LEAST} AND count(DISTINCT trd_imb) >= 2 AND count(DISTINCT ret_{h}) >= 2"
    )


_STATS = """count(*) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)), 6) AS t,
  round(avg((ic > 0)::INT), 6) AS positive, round(CASE WHEN avg(ic) >= 0 THEN avg((ic > 0)::INT) ELSE avg((ic < 0)::INT) END, 6) AS same_sign"""
_EDGES = ", ".join(f"quantile_cont(ret_15, {k / 10}) AS e{k}" for k in range(1, 10))
_GROUP = reduce(lambda a, b: f"{a} + {b}", (f"(ret_15 > e{k})::INT" for k in range(1, 10)))
_SYM = "lpad(regexp_extract(symbol, '([0-9]+)', 1), 6, '0')"
_PLAIN = "CASE WHEN sysid > 1000000000000 THEN sysid % 1000000000000 ELSE sysid END"
_FIRST = f"""
  SELECT feed, {_SYM} AS symbol, trade_date, {_PLAIN} AS sysid, {', '.join(_MATCHED)} FROM trade_rows
  QUALIFY row_number() OVER (PARTITION BY feed, {_SYM}, trade_date, {_PLAIN} ORDER BY row_no) = 1"""
_GOOD = "isfinite(price) AND price > 0 AND volume > 0 AND timeseconds IS NOT NULL AND ordertype = 'wt'"

SQL = {
    "auction_statistics": f"""{_CALLED}
SELECT {_K}, max(clear_cents) AS clear_cents, max(executed)::BIGINT AS executed, {_imb(_DEMAND, _SUPPLY)} AS imbalance,
  {_SUM.format('volume', "side = 'B' AND cents > clear_cents")}::BIGINT AS better_buy, {_SUM.format('volume', "side = 'S' AND cents < clear_cents")}::BIGINT AS better_sell,
  {_SUPPLY}::BIGINT AS executable_for_buy, {_DEMAND}::BIGINT AS executable_for_sell, {_SIDE},
  count(DISTINCT used) FILTER (used > 0 AND used < executed) + (max(executed) > 0)::INT AS pairs
FROM used GROUP BY {_K}""",
    "auction_residual": f"""{_CALLED},
levels AS (
  SELECT {_K}, side, cents, sum(volume) AS v, max(executed) AS executed,
    sum(sum(volume)) OVER (PARTITION BY {_K}, side ORDER BY CASE side WHEN 'B' THEN -cents ELSE cents END ROWS UNBOUNDED PRECEDING) AS cum
  FROM used GROUP BY {_K}, side, cents),
rest AS (SELECT {_K}, side, cents, greatest(0, least(v, cum - executed))::BIGINT AS volume FROM levels)
SELECT {_K}, side, row_number() OVER (PARTITION BY {_K}, side ORDER BY CASE side WHEN 'B' THEN -cents ELSE cents END)::INTEGER AS level, cents, volume
FROM rest WHERE volume > 0 QUALIFY level <= 3""",
    "market_means": f"{_PANEL} SELECT {_M}, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in FEATURES)} FROM panel GROUP BY ALL",
    "training_table": f"{_PANEL} SELECT {_B}, {', '.join(f'{_pct(c)} AS {c}' for c in FEATURES)}, round(ret_skip, 6) AS ret_skip, {_pct('ret_skip')} AS y_rank FROM (SELECT * FROM panel WHERE ret_skip IS NOT NULL)",
    "ic_horizons": f"{_PANEL}, ics AS ({' UNION ALL '.join(map(_horizon, panel.HORIZONS))}), daily AS (SELECT trade_date, horizon, avg(ic) AS ic FROM ics GROUP BY ALL) "
    f"SELECT horizon, {_STATS} FROM daily WHERE ic IS NOT NULL GROUP BY ALL",
    "symbol_profiles": f"{_PANEL}, daily AS (SELECT symbol, trade_date, avg(n_ord) AS a, avg(abs(age_imb)) AS i, median(mean_size) AS z, median(cxl_ratio) AS c FROM panel GROUP BY ALL) "
    "SELECT symbol, count(*) AS days, round(median(a), 6) AS activity, round(median(i), 6) AS informed, round(median(z), 6) AS size, round(median(c), 6) AS cancels FROM daily GROUP BY ALL",
    "decile_steadiness": f"""
WITH {MINUTES},
full_ AS (SELECT session_date, ret_15, label_15, label_15 - avg(label_15) OVER (PARTITION BY session_date, minute) AS rest FROM panel WHERE ret_15 IS NOT NULL AND label_15 IS NOT NULL),
edges AS (SELECT session_date, {_EDGES} FROM full_ GROUP BY ALL),
means AS (SELECT session_date, {_GROUP} AS grp, avg(label_15) AS raw, avg(rest) AS rest FROM full_ JOIN edges USING (session_date) GROUP BY ALL),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY session_date ORDER BY grp) AS g, rank() OVER (PARTITION BY session_date ORDER BY round(raw, 12)) AS r,
    rank() OVER (PARTITION BY session_date ORDER BY round(rest, 12)) AS d FROM means)
SELECT session_date, count(*) AS groups, round({corr('g', 'r')}, 6) AS steady_raw, round({corr('g', 'd')}, 6) AS steady_rest,
  round(arg_max(raw, grp) - arg_min(raw, grp), 6) AS spread_raw, round(arg_max(rest, grp) - arg_min(rest, grp), 6) AS spread_rest FROM ranked GROUP BY ALL""",
    "build_match": f"WITH f AS ({_FIRST}), p AS (SELECT {', '.join(f'a.{c}::DOUBLE AS a_{c}, b.{c}::DOUBLE AS b_{c}' for c in _MATCHED)} FROM f a JOIN f b USING (symbol, trade_date, sysid) WHERE a.feed = 'A' AND b.feed = 'B') "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS n, round(avg(CASE WHEN a_{c} IS NULL OR b_{c} IS NULL THEN (a_{c} IS NULL AND b_{c} IS NULL)::INT "
        f"ELSE (abs(a_{c} - b_{c}) / CASE WHEN abs(b_{c}) > 1e-9 THEN abs(b_{c}) ELSE 1 END < 0.01)::INT END), 6) AS share, round(median(a_{c}), 6) AS median_a, round(median(b_{c}), 6) AS median_b FROM p"
        for c in _MATCHED
    ),
    "rhythm": f"""
WITH {TAPE},
counts AS (SELECT ms // 1000 AS t, count(*)::DOUBLE / (SELECT count(DISTINCT trade_date) FROM event_feed) AS c FROM sessed WHERE actiontype = 2 GROUP BY ALL),
curve AS (SELECT s.t, coalesce(c, 0) AS c FROM (SELECT unnest(generate_series(min(t), max(t))) AS t FROM counts) s LEFT JOIN counts USING (t)),
rest AS (SELECT t, c - sum(c) OVER (ORDER BY t ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING) / 300 AS x FROM curve),
periods AS (SELECT 5 * pow(360, k / 39) AS period FROM (SELECT unnest(generate_series(0, 39)) AS k)),
sums AS (
  SELECT period, sum(x * cos(2 * pi() * t / period)) AS u, sum(x * sin(2 * pi() * t / period)) AS v, sum(x * x) AS s, count(*) AS n FROM rest CROSS JOIN periods GROUP BY ALL)
SELECT round(period, 6) AS period, round(2 * (u * u + v * v) / (n * s), 6) AS power FROM sums""",
    "sliding_counts": f"WITH {TAPE}, w AS (SELECT symbol, trade_date, unnest([(ms // 300000 + 1) * 300, (ms // 300000 + 2) * 300]) AS until, volume FROM sessed WHERE actiontype = 2) "
    "SELECT symbol, trade_date, until, count(*) AS n, sum(volume)::BIGINT AS volume FROM w GROUP BY ALL",
    "sequence_bins": f"WITH {TAPE} SELECT {_B}, (ms % 60000 // 1875)::INTEGER AS part, count(*) AS n, count(*) FILTER (actiontype = 2) AS trades, {_SUM.format('volume', 'actiontype = 2')}::BIGINT AS traded FROM sessed GROUP BY ALL",
    "mid_right_closed": """
WITH l AS (
  SELECT symbol, trade_date, CAST(ceil(round(timeseconds * 1000) / 60000) AS BIGINT) AS minute, (bdp1 + akp1) / 2 AS mid FROM lob_records
  WHERE timeseconds IS NOT NULL AND bdp1 > 0 AND akp1 > bdp1
  QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, ceil(round(timeseconds * 1000) / 60000) ORDER BY seqno DESC, rec_id DESC) = 1),
g AS (SELECT symbol, trade_date, unnest(generate_series(min(minute), max(minute))) AS minute FROM l GROUP BY symbol, trade_date)
SELECT symbol, trade_date, minute, round(last_value(mid IGNORE NULLS) OVER (PARTITION BY symbol, trade_date ORDER BY minute ROWS UNBOUNDED PRECEDING), 6) AS mid
FROM g LEFT JOIN l USING (symbol, trade_date, minute)""",
    "phase_cancels": f"""
WITH {TAPE}, c AS (
  SELECT symbol, trade_date, CASE WHEN ms < 34200000 THEN 0 WHEN ms < 46800000 THEN 1 WHEN ms < 53820000 THEN 2 ELSE 3 END AS phase, ms // 60000 AS minute, count(*) AS n, sum(volume) AS v
  FROM timed WHERE actiontype = 1 GROUP BY ALL)
SELECT symbol, trade_date, phase, minute, (sum(n) OVER w)::BIGINT AS n, (sum(v) OVER w)::BIGINT AS volume FROM c WINDOW w AS (PARTITION BY symbol, trade_date, phase ORDER BY minute)""",
    "strategy_growth": """
WITH d AS (
  SELECT strat, coalesce(try_strptime(date, '%Y%m%d'), try_strptime(date, '%Y-%m-%d'))::DATE AS day, CASE WHEN isnan(bp) THEN NULL ELSE bp END AS bp FROM daily_s1
  QUALIFY row_number() OVER (PARTITION BY strat, coalesce(try_strptime(date, '%Y%m%d'), try_strptime(date, '%Y-%m-%d'))::DATE ORDER BY loaded_at DESC) = 1)
SELECT strat, day, round(exp(sum(ln(1 + bp / 10000)) OVER (PARTITION BY strat ORDER BY day)), 6) AS growth FROM d WHERE bp IS NOT NULL""",
    "busiest": f"""
WITH {TAPE}, s AS (SELECT symbol, trade_date, sum(volume)::BIGINT AS volume, avg(price) AS price FROM tape WHERE actiontype = 2 AND symbol[1] IN ('0', '3', '6') GROUP BY ALL)
SELECT symbol, trade_date, volume, round(price, 6) AS price, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, symbol)::INTEGER AS place FROM s
WHERE price BETWEEN 5 AND 200 QUALIFY place <= 5""",
    "next_session": """
WITH d AS (SELECT DISTINCT coalesce(try_strptime(date, '%Y%m%d'), try_strptime(date, '%Y-%m-%d'))::DATE AS day FROM daily_s1), s AS (SELECT DISTINCT session_date::DATE AS session FROM sessions)
SELECT day, session FROM d ASOF LEFT JOIN s ON d.day <= s.session WHERE day IS NOT NULL""",
    "order_distance": f"""
SELECT rec_id, round(price - bdp1, 6) AS to_bid, round(akp1 - price, 6) AS to_ask, round((price - bdp1) / ((bdp1 + akp1) / 2), 6) AS to_bid_ratio, round((akp1 - price) / ((bdp1 + akp1) / 2), 6) AS to_ask_ratio
FROM lob_records WHERE {_GOOD} AND bdp1 > 0 AND akp1 > bdp1""",
    "position_statistics": f"""
WITH o AS (
  SELECT symbol, trade_date, CAST((floor(timeseconds / 300) + 1) * 300 AS BIGINT) AS slot, direction, CASE direction WHEN 'B' THEN bidposition ELSE askposition END AS place, count(*) AS n, sum(volume) AS v
  FROM lob_records WHERE {_GOOD} AND direction IS NOT NULL GROUP BY ALL)
SELECT symbol, trade_date, slot, direction, sum(n)::BIGINT AS n, round(coalesce(sum(n) FILTER (place = 0), 0) / sum(n), 6) AS active_share, round(coalesce(sum(v) FILTER (place = 0), 0) / sum(v), 6) AS active_volume,
  round(sum(place * n) / sum(n) FILTER (place <> 0), 6) AS mean_place, arg_min(place, -v * 1000 + place) FILTER (place <> 0) AS most_used
FROM o WHERE place IS NOT NULL GROUP BY symbol, trade_date, slot, direction""",
}
