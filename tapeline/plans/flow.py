"""Queries over the event tape, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.functions.stats import round_all
from tapeline.operators import flow
from tapeline.operators import tape as tapes
from tapeline.sources.tables import table

_ID = "CASE WHEN {0} > 1000000000000 THEN {0} % 1000000000000 ELSE {0} END"
#: The clean tape and what is derived of it, for every SQL text here.
TAPE = f"""
tape AS (
  SELECT symbol, trade_date, seqno, actiontype, market, direction, {_ID.format('sysid')} AS sysid, {_ID.format('buyid')} AS buyid,
         {_ID.format('sellid')} AS sellid, price, volume, tradedirection,
         CAST(round(coalesce(timeseconds, split_part(hms, ':', 1)::DOUBLE * 3600 + split_part(hms, ':', 2)::DOUBLE * 60
              + split_part(hms, ':', 3)::DOUBLE) * 1000) AS BIGINT) AS ms
  FROM event_feed QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, seqno, actiontype ORDER BY feed_id) = 1),
timed AS (
  SELECT *, ms // 60000 AS bkt,
         CASE WHEN ms BETWEEN 34200000 AND 41399999 THEN 0 WHEN ms BETWEEN 46800000 AND 53819999 THEN 1 END AS sess,
         CAST(floor((price + 1e-6) * 100) AS BIGINT) AS cents
  FROM tape),
sessed AS (SELECT * FROM timed WHERE sess IS NOT NULL),
trades AS (
  SELECT *, CASE WHEN CASE tradedirection WHEN 1 THEN true WHEN 2 THEN false ELSE buyid > sellid END THEN 'B' ELSE 'S' END AS side
  FROM timed WHERE actiontype = 2),
sided AS (SELECT *, CASE side WHEN 'B' THEN buyid ELSE sellid END AS active_id, CASE side WHEN 'B' THEN sellid ELSE buyid END AS passive_id FROM trades),
ours AS (
  SELECT *, buyid > sellid AS by_buyer, CASE WHEN buyid > sellid THEN buyid ELSE sellid END AS late_id FROM sessed WHERE actiontype = 2 AND buyid > 0 AND sellid > 0),
orders_in AS (
  SELECT symbol, trade_date, sysid, seqno AS order_seq, coalesce(direction = 'B', false) AS is_buy, volume AS order_volume, cents AS order_cents
  FROM sessed WHERE actiontype = 0 QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, sysid ORDER BY seqno) = 1),
orders_first AS (
  SELECT symbol, trade_date, sysid, seqno AS order_seq, ms AS order_ms, direction AS order_side, volume AS order_volume, cents AS order_cents, bkt, sess
  FROM timed WHERE actiontype = 0 QUALIFY row_number() OVER (PARTITION BY symbol, trade_date, sysid ORDER BY seqno) = 1)
"""
_B = "symbol, trade_date, sess, bkt"


def _imb(a: str, b: str) -> str:
    return f"({a} - {b})::DOUBLE / nullif({a} + {b}, 0)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _on_tape(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """Registers ``build`` over the clean tape under ``name``."""
    QUERIES[name] = lambda spark, d: round_all(build(tapes.tape(table(spark, d, "event_feed"))))
    SQL[name] = f"WITH {TAPE}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


_on_tape(
    "tape_counts",
    lambda t: t.groupBy("trade_date", "market", "actiontype").agg(
        F.count("*").alias("n"),
        F.count_distinct("symbol").alias("symbols"),
        F.sum("volume").alias("volume"),
        F.min("ms").alias("first_ms"),
        F.max("ms").alias("last_ms"),
    ),
    """SELECT trade_date, market, actiontype, count(*) AS n, count(DISTINCT symbol) AS symbols, sum(volume)::BIGINT AS volume,
       min(ms) AS first_ms, max(ms) AS last_ms FROM tape GROUP BY ALL""",
)
_on_tape(
    "minute_flow",
    flow.minute_flow,
    f"""
, cut AS (SELECT symbol, trade_date, quantile_cont(volume, 0.9) AS large_at FROM sessed WHERE actiontype = 0 GROUP BY ALL),
flows AS (
  SELECT {_B}, actiontype, direction, volume FROM sessed WHERE actiontype <> 2
  UNION ALL SELECT {_B}, actiontype, CASE WHEN by_buyer THEN 'B' ELSE 'S' END, volume FROM ours),
sums AS (
  SELECT {_B}, count(*) FILTER (actiontype = 0) AS n_ord, count(*) FILTER (actiontype = 1) AS n_cxl,
    count(*) FILTER (actiontype = 0 AND direction = 'B') AS nb, count(*) FILTER (actiontype = 0 AND direction = 'S') AS ns,
    coalesce(sum(volume) FILTER (actiontype = 0 AND direction = 'B'), 0) AS vb, coalesce(sum(volume) FILTER (actiontype = 0 AND direction = 'S'), 0) AS vs,
    coalesce(sum(volume) FILTER (actiontype = 2 AND direction = 'B'), 0) AS tb, coalesce(sum(volume) FILTER (actiontype = 2 AND direction = 'S'), 0) AS ts,
    coalesce(sum(volume) FILTER (actiontype = 0 AND volume >= large_at), 0) AS vl, coalesce(sum(volume) FILTER (actiontype = 0), 0) AS vo
  FROM flows LEFT JOIN cut USING (symbol, trade_date) GROUP BY ALL)
SELECT {_B}, n_ord, n_cxl, {_r('vo::DOUBLE / nullif(n_ord, 0)', 'mean_size')}, {_r(_imb('nb', 'ns'), 'ord_imb_cnt')}, {_r(_imb('vb', 'vs'), 'ord_imb_vol')},
  {_r(_imb('tb', 'ts'), 'trd_imb')}, {_r('n_cxl::DOUBLE / nullif(n_ord, 0)', 'cxl_ratio')}, {_r('vl::DOUBLE / nullif(vo, 0)', 'large_share')}
FROM sums""",
)
_SUM = "coalesce(sum({0}) FILTER ({1}), 0)"


def _sums(value: str, a: str, b: str) -> str:
    return _imb(_SUM.format(value, a), _SUM.format(value, b))


_on_tape(
    "cancel_life",
    flow.cancel_life,
    f"""
, lived AS (
  SELECT c.symbol, c.trade_date, c.sess, c.bkt, c.seqno - o.order_seq AS life, c.volume, coalesce(c.direction = 'B', false) AS buy
  FROM sessed c JOIN orders_in o USING (symbol, trade_date, sysid) WHERE c.actiontype = 1 AND c.seqno > o.order_seq),
cut AS (SELECT symbol, trade_date, quantile_cont(life, 0.1) AS q FROM lived GROUP BY ALL)
SELECT {_B}, count(*) AS n, {_r('median(ln(1 + life))', 'life_med')}, {_r('sum(CASE WHEN life <= q THEN volume ELSE 0 END)::DOUBLE / nullif(sum(volume), 0)', 'flash_ratio')},
  {_r(_sums('volume', 'life <= q AND buy', 'life <= q AND NOT buy'), 'flash_imb')}
FROM lived JOIN cut USING (symbol, trade_date) GROUP BY ALL""",
)
_on_tape(
    "eaten_age",
    flow.eaten_age,
    f"""
, aged AS (SELECT *, ln(1 + abs(buyid - sellid)) AS age FROM ours),
day AS (SELECT symbol, trade_date, median(age) AS m FROM aged GROUP BY ALL),
sums AS (
  SELECT {_B}, sum(volume * age) FILTER (by_buyer) / sum(volume) FILTER (by_buyer) AS b, sum(volume * age) FILTER (NOT by_buyer) / sum(volume) FILTER (NOT by_buyer) AS s,
    median(age) AS m, {_sums('volume', 'age >= day.m AND by_buyer', 'age >= day.m AND NOT by_buyer')} AS old
  FROM aged JOIN day USING (symbol, trade_date) GROUP BY ALL)
SELECT {_B}, {_r(_imb('b', 's'), 'age_imb')}, {_r('m', 'age_med')}, {_r('old', 'old_imb')} FROM sums""",
)
_on_tape(
    "aggressor_moves",
    flow.aggressor_moves,
    """
, merged AS (
  SELECT symbol, trade_date, active_id, side, min(ms) AS ms, sum(volume) AS volume, count(*) AS trades FROM sided GROUP BY ALL)
SELECT symbol, trade_date, ms, sum(CASE side WHEN 'B' THEN volume ELSE -volume END)::BIGINT AS net, count(*) AS aggressors, sum(trades)::BIGINT AS trades
FROM merged GROUP BY ALL""",
)
_on_tape(
    "aggressor_hhi",
    flow.aggressor_hhi,
    f"""
, ids AS (SELECT {_B}, by_buyer, late_id, sum(volume)::DOUBLE AS v FROM ours GROUP BY ALL),
shares AS (SELECT {_B}, by_buyer, v / sum(v) OVER (PARTITION BY {_B}, by_buyer) AS share FROM ids),
pairs AS (SELECT {_B}, sum(share * share) FILTER (by_buyer) AS b, sum(share * share) FILTER (NOT by_buyer) AS s FROM shares GROUP BY ALL)
SELECT {_B}, {_r('b', 'hhi_buy')}, {_r('s', 'hhi_sell')}, {_r('(b + s) / 2', 'hhi_mean')}, {_r('b - s', 'hhi_imb')} FROM pairs""",
)
_on_tape(
    "order_chains",
    flow.order_chains,
    f"""
, before AS (
  SELECT *, coalesce(direction = 'B', false) AS buy, lag(coalesce(direction = 'B', false)) OVER w AS s, lag(sysid) OVER w AS q, lag(volume) OVER w AS v
  FROM sessed WHERE actiontype = 0 WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY sysid, seqno)),
chained AS (
  SELECT *, sum((q IS NULL OR buy <> s OR sysid - q > 64 OR greatest(volume, v)::DOUBLE / greatest(1, least(volume, v)) > 2)::INT)
    OVER (PARTITION BY symbol, trade_date ORDER BY sysid, seqno) AS chain FROM before),
long AS (SELECT *, count(*) OVER (PARTITION BY symbol, trade_date, chain) >= 3 AS inside FROM chained)
SELECT {_B}, {_r("coalesce(sum(volume) FILTER (inside), 0)::DOUBLE / nullif(sum(volume), 0)", 'chain_share')}, {_r(_sums('volume', 'inside AND buy', 'inside AND NOT buy'), 'chain_imb')}
FROM long GROUP BY ALL""",
)
_on_tape(
    "kept_residual",
    flow.kept_residual,
    f"""
, fills AS (SELECT symbol, trade_date, sysid, sum(volume) AS filled FROM (SELECT symbol, trade_date, unnest([buyid, sellid]) AS sysid, volume FROM ours) GROUP BY ALL),
lasts AS (SELECT symbol, trade_date, late_id AS sysid, max(seqno) AS last_seq, arg_max(sess, seqno) AS sess, arg_max(bkt, seqno) AS bkt FROM ours GROUP BY ALL),
cancels AS (SELECT symbol, trade_date, sysid, min(seqno) AS cancel_seq FROM sessed WHERE actiontype = 1 GROUP BY ALL),
rest AS (
  SELECT l.*, is_buy, greatest(order_volume - filled, 0) AS rem, cancel_seq
  FROM lasts l JOIN orders_in USING (symbol, trade_date, sysid) JOIN fills USING (symbol, trade_date, sysid) LEFT JOIN cancels USING (symbol, trade_date, sysid))
SELECT {_B}, count(*) AS n, {_r(_sums('rem', 'is_buy', 'NOT is_buy'), 'kept_imb')}
FROM rest WHERE rem > 0 AND (cancel_seq IS NULL OR cancel_seq - last_seq > 5000) GROUP BY ALL""",
)
_on_tape(
    "chases",
    flow.chases,
    f"""
, o AS (SELECT symbol, trade_date, direction, seqno, volume, cents, sess, bkt FROM sessed WHERE actiontype = 0 AND direction IS NOT NULL),
c AS (SELECT c.*, order_cents FROM sessed c JOIN orders_in USING (symbol, trade_date, sysid) WHERE actiontype = 1 AND direction IS NOT NULL),
found AS (
  SELECT o.symbol, o.trade_date, o.sess, o.bkt, c.direction = 'B' AS buy, o.seqno - c.seqno AS gap, o.volume, o.volume::DOUBLE / c.volume AS size, o.cents, c.order_cents
  FROM c ASOF JOIN o ON o.symbol = c.symbol AND o.trade_date = c.trade_date AND o.direction = c.direction AND c.seqno <= o.seqno)
SELECT {_B}, count(*) AS n, {_r(_sums('volume', 'buy', 'NOT buy'), 'chase_imb')}
FROM found WHERE gap <= 256 AND size BETWEEN 0.7 AND 1.4 AND CASE WHEN buy THEN cents > order_cents ELSE cents < order_cents END GROUP BY ALL""",
)
_on_tape(
    "book_age",
    flow.book_age,
    f"""
, ids AS (SELECT symbol, trade_date, seqno, volume, unnest([buyid, sellid]) AS sysid FROM ours),
running AS (SELECT symbol, trade_date, sysid, seqno, sum(volume) OVER (PARTITION BY symbol, trade_date, sysid ORDER BY seqno) AS filled FROM ids),
full_ AS (
  SELECT symbol, trade_date, sysid, min(seqno) AS full_seq FROM running JOIN orders_in USING (symbol, trade_date, sysid)
  WHERE filled >= order_volume GROUP BY ALL),
cancels AS (SELECT symbol, trade_date, sysid, min(seqno) AS cancel_seq FROM sessed WHERE actiontype = 1 GROUP BY ALL),
lives AS (SELECT o.*, coalesce(least(full_seq, cancel_seq), 9223372036854775807) AS death FROM orders_in o LEFT JOIN full_ USING (symbol, trade_date, sysid) LEFT JOIN cancels USING (symbol, trade_date, sysid)),
ends AS (SELECT {_B}, max(seqno) AS bound FROM sessed GROUP BY ALL),
alive AS (
  SELECT e.symbol, e.trade_date, e.sess, e.bkt, e.bound, is_buy, (order_seq <= bound)::INT - (death <= bound)::INT AS sign, order_volume, order_seq
  FROM ends e LEFT JOIN lives l ON l.symbol = e.symbol AND l.trade_date = e.trade_date),
summed AS (
  SELECT {_B}, bound, {_SUM.format('sign * order_volume', 'is_buy')} AS vb, {_SUM.format('sign * order_volume', 'NOT is_buy')} AS vs,
    {_SUM.format('sign * order_volume * (bound - order_seq)', 'is_buy')} AS ab, {_SUM.format('sign * order_volume * (bound - order_seq)', 'NOT is_buy')} AS as_
  FROM alive GROUP BY ALL),
ages AS (
  SELECT *, CASE WHEN vb > 0 THEN ln(1 + greatest(ab::DOUBLE / vb, 0)) END AS b, CASE WHEN vs > 0 THEN ln(1 + greatest(as_::DOUBLE / vs, 0)) END AS s FROM summed)
SELECT {_B}, vb::BIGINT AS alive_buy, vs::BIGINT AS alive_sell, {_r('b', 'age_buy')}, {_r('s', 'age_sell')}, {_r('b - s', 'age_imb')}, {_r('(b + s) / 2', 'age_mean')} FROM ages""",
)
_on_tape(
    "refill",
    flow.refill,
    f"""
, eaten AS (SELECT {_B}, cents, NOT by_buyer AS buy, sum(volume) AS eaten FROM ours GROUP BY ALL),
back AS (SELECT {_B}, cents, coalesce(direction = 'B', false) AS buy, sum(volume) AS back FROM sessed WHERE actiontype = 0 GROUP BY ALL),
sides AS (SELECT {_B}, buy, least(sum(back)::DOUBLE / greatest(sum(eaten), 1), 5.0) AS r FROM eaten JOIN back USING ({_B}, cents, buy) GROUP BY ALL),
pairs AS (SELECT {_B}, max(r) FILTER (buy) AS b, max(r) FILTER (NOT buy) AS s FROM sides GROUP BY ALL)
SELECT {_B}, {_r('b', 'refill_bid')}, {_r('s', 'refill_ask')}, {_r('b - s', 'refill_imb')} FROM pairs""",
)
_on_tape(
    "sweep_budget",
    flow.sweep_budget,
    """
, ids AS (SELECT symbol, trade_date, seqno, volume, unnest([buyid, sellid]) AS sysid FROM timed WHERE actiontype = 2)
SELECT symbol, trade_date, sysid,
  coalesce(max(order_volume) + coalesce(sum(volume) FILTER (seqno < order_seq), 0), sum(volume))::BIGINT AS budget,
  sum(volume)::BIGINT AS traded, max((order_seq IS NOT NULL)::INT)::BOOLEAN AS has_order
FROM ids LEFT JOIN orders_first USING (symbol, trade_date, sysid) GROUP BY ALL""",
)
_on_tape(
    "bursts",
    flow.bursts,
    f"""
, counted AS (
  SELECT *, count(*) OVER (PARTITION BY symbol, trade_date, sess ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS n1,
    count(*) OVER (PARTITION BY symbol, trade_date, sess ORDER BY ms RANGE BETWEEN 599999 PRECEDING AND CURRENT ROW) AS n10
  FROM sessed WHERE actiontype = 2),
lasts AS (SELECT {_B}, arg_max(n1 * 10.0::DOUBLE / n10, ms) AS burst FROM counted GROUP BY ALL)
SELECT {_B}, {_r('burst', 'burst')}, burst > 2 AND NOT coalesce(lag(burst > 2) OVER (PARTITION BY symbol, trade_date, sess ORDER BY bkt), false) AS rises
FROM lasts""",
)


def tape_quality(spark: SparkSession, d: str) -> DataFrame:
    """Per day: rows, those delivered behind a later change of their symbol, missing clock fields, changes, cancels and trades of unknown orders."""
    feed = table(spark, d, "event_feed")
    clean = tapes.tape(feed)
    raw = feed.groupBy("trade_date").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("hms").isNull()).alias("no_hms"), F.count_if(F.col("timeseconds").isNull()).alias("no_seconds")
    )
    before = F.max("seqno").over(Window.partitionBy(*tapes.DAY).orderBy("feed_id").rowsBetween(Window.unboundedPreceding, -1))
    late = feed.select(*tapes.DAY, "seqno", (F.col("seqno") < before).alias("_late")).groupBy("trade_date").agg(F.count_if("_late").alias("late"))
    known = clean.where("actiontype = 0").select(*tapes.DAY, "sysid").distinct()
    cancels = clean.where("actiontype = 1").select(*tapes.DAY, "sysid")
    sides = clean.where("actiontype = 2").select(*tapes.DAY, F.explode(F.array("buyid", "sellid")).alias("sysid"))
    lost = lambda df, name: df.join(known, [*tapes.DAY, "sysid"], "left_anti").groupBy("trade_date").agg(F.count("*").alias(name))
    return (
        raw.join(clean.groupBy("trade_date").agg(F.count("*").alias("changes")), "trade_date", "left")
        .join(late, "trade_date", "left")
        .join(lost(cancels, "orphan_cancels"), "trade_date", "left")
        .join(lost(sides, "orphan_sides"), "trade_date", "left")
        .na.fill(0, ["orphan_cancels", "orphan_sides"])
    )


QUERIES["tape_quality"] = tape_quality
SQL["tape_quality"] = f"""
WITH {TAPE},
known AS (SELECT DISTINCT symbol, trade_date, sysid FROM tape WHERE actiontype = 0),
raw AS (SELECT trade_date, count(*) AS n_rows, count(*) FILTER (hms IS NULL) AS no_hms, count(*) FILTER (timeseconds IS NULL) AS no_seconds FROM event_feed GROUP BY ALL),
ch AS (SELECT trade_date, count(*) AS changes FROM tape GROUP BY ALL),
behind AS (SELECT trade_date, seqno < max(seqno) OVER (PARTITION BY symbol, trade_date ORDER BY feed_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM event_feed),
lt AS (SELECT trade_date, count(*) FILTER (late) AS late FROM behind GROUP BY ALL),
oc AS (SELECT trade_date, count(*) AS n FROM tape t ANTI JOIN known k USING (symbol, trade_date, sysid) WHERE actiontype = 1 GROUP BY ALL),
ids AS (SELECT symbol, trade_date, unnest([buyid, sellid]) AS sysid FROM tape WHERE actiontype = 2),
os AS (SELECT trade_date, count(*) AS n FROM ids ANTI JOIN known USING (symbol, trade_date, sysid) GROUP BY ALL)
SELECT raw.trade_date, n_rows, no_hms, no_seconds, changes, late, coalesce(oc.n, 0) AS orphan_cancels, coalesce(os.n, 0) AS orphan_sides
FROM raw LEFT JOIN ch USING (trade_date) LEFT JOIN lt USING (trade_date) LEFT JOIN oc USING (trade_date) LEFT JOIN os USING (trade_date)"""
