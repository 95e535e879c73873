"""Queries over minute bars, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.stats import round_all, zscore
from tapeline.operators import bars, evaluate
from tapeline.sources.tables import table

_NS = "CASE profile WHEN 'flatfiles' THEN window_start WHEN 'rest_split_adjusted' THEN window_start * 1000000 END"
_FINE = "isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND isfinite(volume)"
_SANE = f"coalesce({_FINE} AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= greatest(open, close) AND low <= least(open, close), false)"
MINUTES = f"""
stamped AS (SELECT *, {_NS} AS ns, {_SANE} AS ok FROM minute_bars WHERE ticker IS NOT NULL),
minutes AS (
  SELECT ticker, session_date, CAST((ns - open_ns) // 60000000000 AS INTEGER) AS minute, CAST((close_ns - open_ns) // 60000000000 AS INTEGER) AS length,
         open, high, low, close, volume, n_trans
  FROM stamped JOIN sessions ON ns >= open_ns AND ns < close_ns WHERE ok
  QUALIFY row_number() OVER (PARTITION BY ticker, session_date, (ns - open_ns) // 60000000000 ORDER BY ns DESC, loaded_at DESC, bar_id DESC) = 1),
spine AS (SELECT ticker, session_date, unnest(generate_series(0, length - 1))::INTEGER AS minute FROM (SELECT DISTINCT ticker, session_date, length FROM minutes)),
bars_grid AS (SELECT s.ticker, s.session_date, s.minute, close IS NOT NULL AS observed FROM spine s LEFT JOIN minutes m USING (ticker, session_date, minute)),
grid AS (
  SELECT s.ticker, s.session_date, s.minute, open, high, low, close, volume, n_trans, close IS NOT NULL AS observed
  FROM spine s LEFT JOIN (SELECT * FROM minutes WHERE volume > 0) m USING (ticker, session_date, minute)),
stepped AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker, session_date ORDER BY minute)) AS one FROM grid),
panel AS (
  SELECT *,
    CASE WHEN count(close) OVER b5 = 6 THEN close / lag(close, 5) OVER w - 1 END AS ret_5,
    CASE WHEN count(close) OVER b15 = 16 THEN close / lag(close, 15) OVER w - 1 END AS ret_15,
    CASE WHEN count(one) OVER l30 = 30 THEN sqrt(sum(one * one) OVER l30) END AS rv_30,
    CASE WHEN count(volume) OVER p30 = 30 THEN volume / nullif(avg(volume) OVER p30, 0) END AS volume_ratio_30,
    (high - low) / close AS range_pct,
    CASE WHEN observed AND count(close) OVER f5 = 6 THEN lead(open, 7) OVER w / lead(open, 2) OVER w - 1 END AS label_5,
    CASE WHEN observed AND count(close) OVER f15 = 16 THEN lead(open, 17) OVER w / lead(open, 2) OVER w - 1 END AS label_15
  FROM stepped
  WINDOW w AS (PARTITION BY ticker, session_date ORDER BY minute),
    b5 AS (PARTITION BY ticker, session_date ORDER BY minute ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
    b15 AS (PARTITION BY ticker, session_date ORDER BY minute ROWS BETWEEN 15 PRECEDING AND CURRENT ROW),
    l30 AS (PARTITION BY ticker, session_date ORDER BY minute ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
    p30 AS (PARTITION BY ticker, session_date ORDER BY minute ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
    f5 AS (PARTITION BY ticker, session_date ORDER BY minute ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING),
    f15 AS (PARTITION BY ticker, session_date ORDER BY minute ROWS BETWEEN 2 FOLLOWING AND 17 FOLLOWING))
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TIME = ["session_date", "minute"]
LEAST = 5


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Features and labels on the grid; both share one partitioning and order, so one sort serves all windows."""
    grid = bars.on_grid(bars.minutes(table(spark, d, "minute_bars"), table(spark, d, "sessions")))
    return bars.labels(bars.features(bars.priced(grid)))


def _on_panel(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: round_all(build(panel(spark, d)))
    SQL[name] = f"WITH {MINUTES}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def ranks(x: str, y: str, by: str, source: str = "panel", z: str | None = None) -> str:
    """SQL of average ranks of complete rows."""
    columns = [("rx", x), ("ry", y)] + ([("rz", z)] if z else [])
    parts = ", ".join(
        f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE AS {r}" for r, c in columns
    )
    return f"SELECT {by}, {x}, {y}, {parts} FROM {source} WHERE " + " AND ".join(f"{c} IS NOT NULL" for _, c in columns)


def corr(a: str, b: str) -> str:
    """SQL of the guarded correlation."""
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"CASE WHEN var_pop({a}) {both} > 0 AND var_pop({b}) {both} > 0 THEN corr({a}, {b}) {both} END"


def _ic(x: str, y: str, by: str, least: int, source: str = "panel", distinct: int = 2) -> str:
    return (
        f"SELECT {by}, count(*) AS n, round({corr('rx', 'ry')}, 12) AS ic FROM ({ranks(x, y, by, source)}) GROUP BY ALL "
        f"HAVING count(*) >= {least} AND count(DISTINCT {x}) >= {distinct} AND count(DISTINCT {y}) >= 2"
    )


_SUMMARY = """count(*) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std,
  round(avg({0}) / nullif(stddev_samp({0}), 0) * sqrt(count(*)), 6) AS t, round(avg(({0} > 0)::INT), 6) AS positive,
  round(CASE WHEN avg({0}) >= 0 THEN avg(({0} > 0)::INT) ELSE avg(({0} < 0)::INT) END, 6) AS same_sign"""
_T = "session_date, minute"

_on_panel(
    "bars_panel",
    lambda p: p.select("ticker", *TIME, "observed", "ret_5", "ret_15", "rv_30", "volume_ratio_30", "range_pct", "label_5", "label_15"),
    """SELECT ticker, session_date, minute, observed, round(ret_5, 6) AS ret_5, round(ret_15, 6) AS ret_15, round(rv_30, 6) AS rv_30,
    round(volume_ratio_30, 6) AS volume_ratio_30, round(range_pct, 6) AS range_pct, round(label_5, 6) AS label_5, round(label_15, 6) AS label_15 FROM panel""",
)
_on_panel(
    "rank_ic",
    lambda p: evaluate.ic_by_time(p, "ret_5", "label_5", TIME, LEAST, 3),
    f"SELECT * REPLACE (round(ic, 6) AS ic) FROM ({_ic('ret_5', 'label_5', _T, LEAST, distinct=3)})",
)
_on_panel(
    "rank_ic_summary",
    lambda p: evaluate.summary(
        evaluate.ic_by_time(p, "ret_5", "label_5", TIME, LEAST).groupBy("session_date").agg(F.avg("ic").alias("ic")).withColumn("feature", F.lit("ret_5")),
        ["feature"],
        "ic",
    ),
    f""", daily AS (SELECT session_date, avg(ic) AS ic FROM ({_ic('ret_5', 'label_5', _T, LEAST)}) GROUP BY ALL)
SELECT feature, {_SUMMARY.format('ic')} FROM (SELECT *, 'ret_5' AS feature FROM daily) WHERE ic IS NOT NULL GROUP BY feature""",
)
_on_panel(
    "rank_ic_phases",
    lambda p: evaluate.summary(
        evaluate.ic_by_time(p.where("pmod(minute + 1, 5) = 0"), "ret_5", "label_5", TIME, LEAST), ["session_date"], "ic"
    ),
    f"SELECT session_date, {_SUMMARY.format('ic')} FROM ({_ic('ret_5', 'label_5', _T, LEAST, '(SELECT * FROM panel WHERE (minute + 1) % 5 = 0)')}) WHERE ic IS NOT NULL GROUP BY ALL",
)
_on_panel(
    "series_ic",
    lambda p: evaluate.ic_by_series(p, "volume_ratio_30", "label_15", ["ticker", "session_date"], 30),
    f"SELECT * REPLACE (round(ic, 6) AS ic) FROM ({_ic('volume_ratio_30', 'label_15', 'ticker, session_date', 30)})",
)
_on_panel(
    "ic_decay",
    lambda p: evaluate.summary(evaluate.ic_by_horizon(p, "ret_15", {5: "label_5", 15: "label_15"}, TIME, LEAST), ["horizon"], "ic"),
    f""", both_ AS (SELECT 5 AS horizon, ic FROM ({_ic('ret_15', 'label_5', _T, LEAST)}) UNION ALL SELECT 15, ic FROM ({_ic('ret_15', 'label_15', _T, LEAST)}))
SELECT horizon, {_SUMMARY.format('ic')} FROM both_ WHERE ic IS NOT NULL GROUP BY ALL""",
)
_on_panel(
    "partial_ic",
    lambda p: evaluate.partial_ic(p, "ret_5", "label_5", "range_pct", TIME, LEAST),
    f""", pairs AS (SELECT {_T}, count(*) AS n, {corr('rx', 'ry')} AS xy, {corr('rx', 'rz')} AS xz, {corr('ry', 'rz')} AS yz
  FROM ({ranks('ret_5', 'label_5', _T, z='range_pct')}) GROUP BY ALL HAVING count(*) >= {LEAST})
SELECT {_T}, n, round(CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-9 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) AS ic FROM pairs""",
)
_on_panel(
    "tails",
    lambda p: evaluate.tails(p, "ret_5", "label_5", TIME, 3, LEAST),
    f""", ranked AS (SELECT {_T}, label_5, rx / count(*) OVER (PARTITION BY {_T}) AS p FROM ({ranks('ret_5', 'label_5', _T)})),
means AS (SELECT {_T}, count(*) AS n, avg(label_5) FILTER (p > 1 - 1 / 3) AS top, avg(label_5) FILTER (p <= 1 / 3) AS bottom FROM ranked GROUP BY ALL HAVING count(*) >= {LEAST})
SELECT {_T}, n, round(top, 6) AS top, round(bottom, 6) AS bottom, round(top - bottom, 6) AS spread FROM means""",
)
_on_panel(
    "quantile_groups",
    lambda p: evaluate.quantile_groups(p, "rv_30", "label_15", ["session_date"], 5),
    """, full_ AS (SELECT session_date, rv_30, label_15 FROM panel WHERE rv_30 IS NOT NULL AND label_15 IS NOT NULL),
edges AS (SELECT session_date, quantile_cont(rv_30, 0.2) AS a, quantile_cont(rv_30, 0.4) AS b, quantile_cont(rv_30, 0.6) AS c, quantile_cont(rv_30, 0.8) AS d FROM full_ GROUP BY ALL)
SELECT session_date, 1 + (rv_30 > a)::INT + (rv_30 > b)::INT + (rv_30 > c)::INT + (rv_30 > d)::INT AS grp, count(*) AS n, round(avg(label_15), 6) AS mean_label
FROM full_ JOIN edges USING (session_date) GROUP BY ALL""",
)
_on_panel(
    "extremes",
    lambda p: evaluate.extremes(p, "ret_15", TIME, "ticker", 1),
    f""", ranked AS (SELECT {_T}, ticker, ret_15, row_number() OVER (PARTITION BY {_T} ORDER BY ret_15, ticker) AS l,
  row_number() OVER (PARTITION BY {_T} ORDER BY ret_15 DESC, ticker) AS h FROM panel WHERE ret_15 IS NOT NULL)
SELECT {_T}, ticker, round(ret_15, 6) AS ret_15, CASE WHEN h <= 1 THEN 1 ELSE 0 END AS is_top FROM ranked WHERE l <= 1 OR h <= 1""",
)
_on_panel(
    "feature_correlations",
    lambda p: evaluate.correlations(p, ["ret_5", "ret_15", "rv_30", "range_pct"], TIME, LEAST),
    ", wide AS (SELECT {t}, {c} FROM panel GROUP BY ALL HAVING count(*) >= {n}) SELECT * FROM ({u})".format(
        t=_T,
        n=LEAST,
        c=", ".join(
            f"{corr(a, b)} AS c{i}"
            for i, (a, b) in enumerate(
                [("ret_5", "ret_15"), ("ret_5", "rv_30"), ("ret_5", "range_pct"), ("ret_15", "rv_30"), ("ret_15", "range_pct"), ("rv_30", "range_pct")]
            )
        ),
        u=" UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(avg(c{i}), 6) AS corr FROM wide"
            for i, (a, b) in enumerate(
                [("ret_5", "ret_15"), ("ret_5", "rv_30"), ("ret_5", "range_pct"), ("ret_15", "rv_30"), ("ret_15", "range_pct"), ("rv_30", "range_pct")]
            )
        ),
    ),
)
_on_panel(
    "zscores",
    lambda p: p.where("ret_5 IS NOT NULL").select("ticker", *TIME, zscore(F.col("ret_5"), TIME).alias("z")),
    f"""SELECT ticker, {_T}, round((ret_5 - avg(ret_5) OVER (PARTITION BY {_T})) / CASE WHEN stddev_samp(ret_5) OVER (PARTITION BY {_T}) = 0 THEN 1 ELSE stddev_samp(ret_5) OVER (PARTITION BY {_T}) END, 6) AS z
FROM panel WHERE ret_5 IS NOT NULL""",
)
_on_panel(
    "long_short",
    lambda p: evaluate.long_short(
        p.where("pmod(minute, 15) = 0 AND ret_15 IS NOT NULL"), "ret_15", "label_15", TIME, "ticker", 2, 0.0002, [F.col("session_date"), F.col("minute")]
    ),
    f""", sampled AS (SELECT * FROM panel WHERE minute % 15 = 0 AND ret_15 IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_T} ORDER BY ret_15, ticker) AS l, row_number() OVER (PARTITION BY {_T} ORDER BY ret_15 DESC, ticker) AS h FROM sampled),
held AS (SELECT *, CASE WHEN h <= 2 THEN 0.5::DOUBLE WHEN l <= 2 THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS w FROM ranked),
moved AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY ticker ORDER BY session_date, minute), 0)) AS dw FROM held)
SELECT {_T}, round(sum(w * coalesce(label_15, 0)), 6) AS gross, round(sum(dw), 6) AS turnover, round(sum(w * coalesce(label_15, 0)) - sum(dw) * 0.0002, 6) AS net
FROM moved GROUP BY ALL""",
)
_on_panel(
    "placebo_ic",
    lambda p: evaluate.ic_by_time(evaluate.shuffled(p.select("ticker", *TIME, "ret_5", "label_5"), "label_5", TIME, "ticker", "7"), "ret_5", "label_5", TIME, LEAST),
    f""", full_ AS (SELECT ticker, {_T}, ret_5, label_5 FROM panel WHERE label_5 IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY {_T} ORDER BY ticker) AS i FROM full_),
b AS (SELECT {_T}, label_5, row_number() OVER (PARTITION BY {_T} ORDER BY md5(ticker || '|7'), ticker) AS i FROM full_),
mixed AS (SELECT a.ticker, a.session_date, a.minute, a.ret_5, b.label_5 FROM a JOIN b USING ({_T}, i))
SELECT * REPLACE (round(ic, 6) AS ic) FROM ({_ic('ret_5', 'label_5', _T, LEAST, 'mixed')})""",
)
_RETURNS = ", ".join(f"close / lag(close, {n}) OVER w - 1 AS ret_{n}" for n in (1, 5, 15, 60, 240))
_SPANS = ", ".join(f"r{n} AS (PARTITION BY ticker, session_date ORDER BY minute ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (60, 240))
_on_panel(
    "placebo_names",
    lambda p: evaluate.ic_by_time(evaluate.renamed(p.select("ticker", *TIME, "ret_5", "label_5"), "label_5", TIME, "ticker", "7"), "ret_5", "label_5", TIME, LEAST),
    f""", names AS (SELECT DISTINCT ticker FROM panel),
mapped AS (
  SELECT a.ticker, b.other FROM (SELECT ticker, row_number() OVER (ORDER BY ticker) AS i FROM names) a
  JOIN (SELECT ticker AS other, row_number() OVER (ORDER BY md5(ticker || '|7'), ticker) AS i FROM names) b USING (i)),
mixed AS (SELECT p.ticker, p.session_date, p.minute, p.ret_5, o.label_5 FROM panel p JOIN mapped USING (ticker) JOIN panel o ON o.ticker = other AND o.session_date = p.session_date AND o.minute = p.minute)
SELECT * REPLACE (round(ic, 6) AS ic) FROM ({_ic('ret_5', 'label_5', _T, LEAST, 'mixed')})""",
)
_on_panel(
    "ic_lags",
    lambda p: evaluate.summary(
        evaluate.ic_by_time(evaluate.lagged(p, "ret_5", ["ticker", "session_date"], "minute", (0, 1, 5)), "ret_5", "label_5", [*TIME, "lag"], LEAST), ["lag"], "ic"
    ),
    ", shifted AS ("
    + " UNION ALL ".join(
        f"SELECT session_date, minute, {k} AS lag, lag(ret_5, {k}) OVER (PARTITION BY ticker, session_date ORDER BY minute) AS ret_5, label_5 FROM panel" for k in (0, 1, 5)
    )
    + f") SELECT lag, {_SUMMARY.format('ic')} FROM ({_ic('ret_5', 'label_5', _T + ', lag', LEAST, 'shifted')}) WHERE ic IS NOT NULL GROUP BY ALL",
)
_GROUPS = """full_ AS (SELECT session_date, rv_30, label_15 FROM panel WHERE rv_30 IS NOT NULL AND label_15 IS NOT NULL),
edges AS (SELECT session_date, quantile_cont(rv_30, 0.2) AS a, quantile_cont(rv_30, 0.4) AS b, quantile_cont(rv_30, 0.6) AS c, quantile_cont(rv_30, 0.8) AS d FROM full_ GROUP BY ALL),
grouped AS (
  SELECT session_date, 1 + (rv_30 > a)::INT + (rv_30 > b)::INT + (rv_30 > c)::INT + (rv_30 > d)::INT AS grp, avg(label_15) AS m FROM full_ JOIN edges USING (session_date) GROUP BY ALL)"""
_on_panel(
    "quantile_curves",
    lambda p: evaluate.curves(evaluate.quantile_groups(p, "rv_30", "label_15", ["session_date"], 5), "session_date"),
    f""", {_GROUPS},
every AS (SELECT * FROM grouped UNION ALL SELECT session_date, 0, arg_max(m, grp) - arg_min(m, grp) FROM grouped GROUP BY session_date)
SELECT session_date, grp, round(exp(sum(ln(1 + m)) OVER (PARTITION BY grp ORDER BY session_date)), 6) AS growth,
  round(avg(m) OVER (PARTITION BY grp) / nullif(stddev_samp(m) OVER (PARTITION BY grp), 0) * sqrt(240), 6) AS yearly FROM every""",
)
_on_panel(
    "long_short_sessions",
    lambda p: evaluate.break_even(
        evaluate.long_short(
            p.where("pmod(minute, 15) = 0 AND ret_15 IS NOT NULL"), "ret_15", "label_15", TIME, "ticker", 2, 0.0002, [F.col("session_date"), F.col("minute")]
        ),
        ["session_date"],
    ),
    f""", sampled AS (SELECT * FROM panel WHERE minute % 15 = 0 AND ret_15 IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_T} ORDER BY ret_15, ticker) AS l, row_number() OVER (PARTITION BY {_T} ORDER BY ret_15 DESC, ticker) AS h FROM sampled),
held AS (SELECT *, CASE WHEN h <= 2 THEN 0.5::DOUBLE WHEN l <= 2 THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS w FROM ranked),
moved AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY ticker ORDER BY session_date, minute), 0)) AS dw FROM held)
SELECT session_date, count(DISTINCT minute) AS moments, round(sum(w * coalesce(label_15, 0)), 6) AS gross, round(sum(dw), 6) AS turnover,
  round(sum(w * coalesce(label_15, 0)) - sum(dw) * 0.0002, 6) AS net, round(sum(w * coalesce(label_15, 0)) / nullif(sum(dw), 0), 6) AS break_even FROM moved GROUP BY ALL""",
)
_on_panel(
    "rolling_factors",
    bars.rolling_factors,
    f""", staged AS (SELECT *, {_RETURNS} FROM grid WINDOW w AS (PARTITION BY ticker, session_date ORDER BY minute))
SELECT ticker, session_date, minute, {', '.join(f'round(ret_{n}, 6) AS ret_{n}' for n in (1, 5, 15, 60, 240))},
  round(CASE WHEN count(ret_1) OVER r60 = 60 THEN stddev_samp(ret_1) OVER r60 * sqrt(60) END, 6) AS rv_hour, round(CASE WHEN count(ret_1) OVER r240 = 240 THEN stddev_samp(ret_1) OVER r240 * sqrt(240) END, 6) AS rv_long,
  round((high - low) / close, 6) AS range_pct, round(pow(ln(high / low), 2) / 2.772588722239781, 6) AS parkinson,
  round(volume / nullif(avg(volume) OVER r60, 0), 6) AS volume_ratio_hour, round(volume / nullif(avg(volume) OVER r240, 0), 6) AS volume_ratio_long, round(volume / nullif(n_trans, 0), 6) AS trade_size,
  round((close - min(low) OVER r240) / nullif(max(high) OVER r240 - min(low) OVER r240, 0), 6) AS place,
  round((sum(volume) OVER r60 / 60) / nullif(sum(volume) OVER r240 / 240, 0), 6) AS volume_acc, round(abs(ret_1) / nullif(volume, 0) * 1e9, 6) AS amihud
FROM staged WINDOW {_SPANS}""",
)

_PAIRS = [("ret_5", "ret_5"), ("ret_5", "ret_15"), ("ret_5", "label_5"), ("ret_15", "ret_15"), ("ret_15", "label_5"), ("label_5", "label_5")]
_on_panel(
    "gram",
    lambda p: evaluate.gram(p, ["ret_5", "ret_15", "label_5"], ["session_date"]),
    ", full_ AS (SELECT * FROM panel WHERE ret_5 IS NOT NULL AND ret_15 IS NOT NULL AND label_5 IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT session_date, count(*) AS n, '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 6) AS product FROM full_ GROUP BY session_date" for a, b in _PAIRS
    ),
)


_on_panel(
    "walk_forward",
    lambda p: evaluate.walk_forward(p, ["ret_5", "ret_15"], "label_5", "session_date", 1e-3, 100),
    ", full_ AS (SELECT session_date, ret_5 AS x, ret_15 AS z, label_5 AS y FROM panel WHERE ret_5 IS NOT NULL AND ret_15 IS NOT NULL AND label_5 IS NOT NULL), "
    "sums AS (SELECT session_date, count(*) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM full_ GROUP BY ALL), "
    "past AS (SELECT session_date, sum(n) OVER w AS n, sum(xx) OVER w + sum(n) OVER w * 1e-3 AS a, sum(xz) OVER w AS b, sum(zz) OVER w + sum(n) OVER w * 1e-3 AS d, sum(xy) OVER w AS e, sum(zy) OVER w AS f "
    "FROM sums WINDOW w AS (ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)) "
    "SELECT session_date, 'ret_5' AS feature, round((e * d - b * f) / (a * d - b * b), 6) AS weight FROM past WHERE n >= 100 "
    "UNION ALL SELECT session_date, 'ret_15', round((a * f - b * e) / (a * d - b * b), 6) FROM past WHERE n >= 100",
)


def bars_quality(spark: SparkSession, d: str) -> DataFrame:
    return bars.quality(table(spark, d, "minute_bars"), table(spark, d, "sessions"))


QUERIES["bars_quality"] = bars_quality
SQL["bars_quality"] = f"""
WITH {MINUTES},
own AS (SELECT ticker, count(*) AS n_rows, count(*) FILTER (NOT ok) AS faulty, count(*) FILTER (volume = 0) AS no_volume,
  count(*) FILTER (ns % 60000000000 <> 0) AS off_minute, count(*) - count(DISTINCT ns) AS repeated FROM stamped GROUP BY ALL),
inside AS (SELECT ticker, count(*) AS n FROM stamped JOIN sessions ON ns >= open_ns AND ns < close_ns GROUP BY ALL),
gaps AS (SELECT ticker, count(*) FILTER (NOT observed) AS missing FROM bars_grid GROUP BY ALL)
SELECT own.ticker, n_rows, n_rows - coalesce(inside.n, 0) AS outside, faulty, no_volume, off_minute, repeated, coalesce(missing, 0) AS missing
FROM own LEFT JOIN inside USING (ticker) LEFT JOIN gaps USING (ticker)"""
