"""Queries of the numbered problems that belong to the core, each over its whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.stats import round_all
from tapeline.operators import changefeed, compare, grid, rolling, spikes
from tapeline.sources.tables import table


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every minute of every session of a ticker, filled, with uncertainty and missing flag."""
    return grid.minute_grid(table(spark, d, "minute_bars"), table(spark, d, "sessions")).select(
        "ticker", "session_date", F.col("grid_at").alias("window_start"), F.col("reading").alias("close"), "missing", "filled", "filled_sd"
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).where("missing").select("ticker", "window_start")


def p2_flagged(spark: SparkSession, d: str) -> DataFrame:
    """The implausible readings with their series and value."""
    lob, bars = table(spark, d, "lob_records"), table(spark, d, "minute_bars")
    return spikes.spikes(spikes.table_readings(lob, bars, table(spark, d, "sessions")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flagged(spark, d).select("src", "row_id", "field")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The live orders, from the state that this publishes for the folder ``d`` (a job, run when called)."""
    feed = table(spark, d, "event_feed")
    return changefeed.live_orders(feed, feed.count(), f"order-state-{hashlib.md5(d.encode()).hexdigest()[:12]}")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    """Every order ever live with what is left of it, tombstones included."""
    feed = table(spark, d, "event_feed")
    return changefeed.upsert(changefeed.order_changes(feed), 2 * feed.count())


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "daily_s1")
    return rolling.rolling(rolling.daily_net(daily), "strat", "day", "net", (7, 30), daily.select("strat").distinct().count())


def p5_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of each strategy's net over 7 and 30 days."""
    return round_all(_strategies(spark, d), 4)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _strategies(spark, d).where("active = 0").select("strat", F.date_format("asof", "yyyyMMdd").alias("asof"), "span")


def p5_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of each ticker's volume over 7 and 30 days."""
    bars = table(spark, d, "minute_bars")
    return round_all(rolling.rolling(rolling.daily_volume(bars), "ticker", "day", "volume", (7, 30), bars.select("ticker").distinct().count()), 4)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return compare.build_differences(table(spark, d, "order_rows"), table(spark, d, "trade_rows"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_grid, p2_found, p2_flagged, p3_found, p3_state, p5_found, p5_strategies, p5_tickers, p6_found)
}

_NS = "CASE profile WHEN 'flatfiles' THEN window_start WHEN 'rest_split_adjusted' THEN window_start * 1000000 END"
_ID = "CASE WHEN {0} > 1000000000000 THEN {0} % 1000000000000 ELSE {0} END"
_DAYS = """
days AS (
  SELECT strat, coalesce(try_strptime(date, '%Y%m%d'), try_strptime(date, '%Y-%m-%d'))::DATE AS day,
         arg_max({{'net': net}}, loaded_at).net AS net
  FROM daily_s1 GROUP BY ALL),
active AS (SELECT strat, day, net FROM days WHERE net IS NOT NULL),
spine AS (
  SELECT strat, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS asof_day FROM active GROUP BY strat),
spans AS (SELECT unnest([7, 30])::BIGINT AS span),
rolled AS (
  SELECT p.strat, p.asof_day, s.span, coalesce(sum(a.net), 0) AS total, count(a.net) AS active
  FROM spine p CROSS JOIN spans s LEFT JOIN active a
    ON a.strat = p.strat AND a.day <= p.asof_day AND a.day > p.asof_day - s.span::INTEGER
  GROUP BY ALL)
""".replace("{{", "{").replace("}}", "}")
_CHANGES = f"""
raw AS (
  SELECT DISTINCT symbol, trade_date, seqno, actiontype, volume, {_ID.format('sysid')} AS s, {_ID.format('buyid')} AS b, {_ID.format('sellid')} AS l
  FROM event_feed),
changes AS (
  SELECT symbol, trade_date, seqno, actiontype, volume, s AS sysid FROM raw WHERE actiontype IN (0, 1)
  UNION SELECT symbol, trade_date, seqno, actiontype, volume, b FROM raw WHERE actiontype = 2
  UNION SELECT symbol, trade_date, seqno, actiontype, volume, l FROM raw WHERE actiontype = 2),
born AS (
  SELECT symbol, trade_date, sysid, max(seqno) AS seqno, arg_max(volume, seqno) AS volume
  FROM changes WHERE actiontype = 0 GROUP BY ALL),
state AS (
  SELECT o.symbol, o.trade_date, o.sysid, greatest(o.seqno, coalesce(max(c.seqno), o.seqno)) AS seqno, o.volume,
         greatest(o.volume - coalesce(sum(c.volume), 0), 0)::BIGINT AS left_over,
         o.volume <= coalesce(sum(c.volume), 0) AS deleted
  FROM born o LEFT JOIN changes c
    ON c.symbol = o.symbol AND c.trade_date = o.trade_date AND c.sysid = o.sysid AND c.actiontype > 0 AND c.seqno >= o.seqno
  GROUP BY o.symbol, o.trade_date, o.sysid, o.seqno, o.volume)
"""


def _first(name: str, where: str, fields: str) -> str:
    return f"""
    SELECT feed, lpad(regexp_extract(symbol, '([0-9]+)', 1), 6, '0') AS symbol, trade_date, {_ID.format('sysid')} AS sysid, {fields}
    FROM {name} {where}
    QUALIFY row_number() OVER (PARTITION BY feed, regexp_extract(symbol, '([0-9]+)', 1), trade_date, {_ID.format('sysid')} ORDER BY row_no) = 1"""


def _diffs(name: str, where: str, fields: str, tests: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{field}' END" for field, test in tests)
    return f"""
    SELECT '{name}' AS tbl, symbol, trade_date, sysid, unnest(diffs) AS diff FROM (
      SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.trade_date, b.trade_date) AS trade_date, coalesce(a.sysid, b.sysid) AS sysid,
        CASE WHEN b.feed IS NULL THEN ['a_only'] WHEN a.feed IS NULL THEN ['b_only']
             ELSE list_filter([{cases}], lambda x: x IS NOT NULL) END AS diffs
      FROM (SELECT * FROM ({_first(name, where, fields)}) WHERE feed = 'A') a
      FULL JOIN (SELECT * FROM ({_first(name, where, fields)}) WHERE feed = 'B') b
        ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND a.sysid = b.sysid)"""


SQL = {
    "p1_found": f"""
WITH usable AS (
  SELECT b.ticker, s.session_date, s.open_ns, s.close_ns, (b.ns - s.open_ns) // 60000000000 AS i
  FROM (SELECT ticker, close, {_NS} AS ns FROM minute_bars) b
  JOIN sessions s ON b.ns >= s.open_ns AND b.ns < s.close_ns
  WHERE b.close > 0 AND isfinite(b.close)),
grid AS (
  SELECT ticker, open_ns, unnest(generate_series(0, (close_ns - open_ns) // 60000000000 - 1)) AS i
  FROM (SELECT DISTINCT ticker, open_ns, close_ns FROM usable))
SELECT g.ticker, g.open_ns + g.i * 60000000000 AS window_start
FROM grid g ANTI JOIN usable u ON u.ticker = g.ticker AND u.open_ns = g.open_ns AND u.i = g.i""",
    "p3_found": f"WITH {_CHANGES} SELECT symbol, trade_date, sysid, seqno FROM state WHERE NOT deleted",
    "p3_state": f"WITH {_CHANGES} SELECT * FROM state",
    "p5_strategies": f"""WITH {_DAYS} SELECT strat, asof_day AS "asof", span, round(total, 4) AS total, round(total / span, 4) AS average, active FROM rolled""",
    "p5_tickers": f"""
WITH stamps AS (
  SELECT ticker, ns, volume FROM (SELECT *, {_NS} AS ns FROM minute_bars) WHERE ticker IS NOT NULL AND ns IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ticker, ns ORDER BY loaded_at DESC, bar_id DESC) = 1),
active AS (
  SELECT ticker, make_timestamp(ns // 1000)::DATE AS day, sum(volume) AS net FROM stamps WHERE isfinite(volume) AND volume >= 0 GROUP BY ALL),
spine AS (SELECT ticker, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS asof_day FROM active GROUP BY ticker),
spans AS (SELECT unnest([7, 30])::BIGINT AS span)
SELECT p.ticker, p.asof_day AS "asof", s.span, round(coalesce(sum(a.net), 0), 4) AS total, round(coalesce(sum(a.net), 0) / s.span, 4) AS average, count(a.net) AS active
FROM spine p CROSS JOIN spans s LEFT JOIN active a ON a.ticker = p.ticker AND a.day <= p.asof_day AND a.day > p.asof_day - s.span::INTEGER
GROUP BY p.ticker, p.asof_day, s.span""",
    "p5_found": f"WITH {_DAYS} SELECT strat, strftime(asof_day, '%Y%m%d') AS \"asof\", span FROM rolled WHERE active = 0",
    "p6_found": _diffs(
        "order_rows",
        "WHERE ordertype = 'wt'",
        "upper(trim(direction)) AS direction, price, volume, cls",
        [
            ("direction", "a.direction IS DISTINCT FROM b.direction"),
            ("price", "coalesce(abs(a.price - b.price) > 0.005, a.price IS DISTINCT FROM b.price)"),
            ("volume", "a.volume IS DISTINCT FROM b.volume"),
            ("cls", "coalesce(a.cls <> b.cls AND a.cls <> 0 AND b.cls <> 0, a.cls IS DISTINCT FROM b.cls)"),
        ],
    )
    + "\n    UNION ALL"
    + _diffs(
        "trade_rows",
        "",
        "trans_vlm, vwap",
        [
            ("trans_vlm", "a.trans_vlm IS DISTINCT FROM b.trans_vlm"),
            ("vwap", "coalesce(abs(a.vwap - b.vwap) > 0.005, a.vwap IS DISTINCT FROM b.vwap)"),
        ],
    ),
}
