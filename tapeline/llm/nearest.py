"""Records of two tables paired by nearest time: DuckDB ASOF joins inside hash-partitioned Arrow groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.clean import clock_ticks, plain_id, second_ticks, six_digits
from tapeline.session import buckets, scratch

#: Ticks a second: the finest time of either table is a tenth of a millisecond. Whole ticks make equal distances equal.
TICKS = 10_000
#: Ticks of a slice. A symbol's day is cut into slices, so that a hot symbol spreads over many groups.
SLICE = 600 * TICKS
PER_GROUP = 60_000

_OUT = "name string, sysid long, seqno long, apart long"

_MATCH = """
WITH points AS (
  SELECT symbol, trade_date, slice, ticks, min(seqno) AS seqno, arg_min(sysid, seqno) AS sysid
  FROM candidates GROUP BY ALL),
pairs AS (
  SELECT l.name, r.sysid, r.seqno, l.ticks - r.ticks AS apart
  FROM wanted l ASOF JOIN points r
    ON l.symbol = r.symbol AND l.trade_date = r.trade_date AND l.slice = r.slice AND l.ticks >= r.ticks
  UNION ALL
  SELECT l.name, r.sysid, r.seqno, r.ticks - l.ticks
  FROM wanted l ASOF JOIN points r
    ON l.symbol = r.symbol AND l.trade_date = r.trade_date AND l.slice = r.slice AND l.ticks <= r.ticks)
SELECT name, sysid, seqno, apart FROM pairs WHERE apart <= {tolerance}
QUALIFY row_number() OVER (PARTITION BY name ORDER BY apart, seqno) = 1
"""


def first_of_tick(candidates: DataFrame) -> DataFrame:
    """Of the candidates of a symbol, day and tick the one with the smallest ``seqno``, null last; combined where they are read."""
    first = F.min(F.struct(F.col("seqno").isNull().alias("none"), "seqno", "sysid"))
    return candidates.groupBy("symbol", "trade_date", "ticks").agg(first.alias("_first")).select(
        "symbol", "trade_date", "ticks", "_first.seqno", "_first.sysid"
    )


def nearest(wanted: DataFrame, candidates: DataFrame, tolerance: int, rows: int) -> DataFrame:
    """For each of ``wanted`` (name, symbol, trade_date, ticks) the candidate (symbol, trade_date, ticks, seqno, sysid)
    nearest in time, at most ``tolerance`` ticks away on either side; at equal distance the smaller ``seqno``.

    ``name`` is unique. Rows with a null symbol, date or time match nothing; what matches nothing has no row. Candidates
    within the tolerance of a slice's end are sent to the next slice as well, so a pair never spans two groups. Of the
    candidates of one tick only the one with the smallest ``seqno`` is sent; a slice has no more of them than ticks.
    ``rows`` sizes the groups. Columns: name, sysid, seqno, apart (ticks).
    """
    if tolerance >= SLICE:
        raise ValueError("a tolerance must be shorter than a slice")
    known = "symbol IS NOT NULL AND trade_date IS NOT NULL AND ticks IS NOT NULL"
    piece = lambda c: F.floor(c / SLICE).cast("long")
    many = F.lit(buckets(rows, PER_GROUP, 12))
    group = F.pmod(F.xxhash64("symbol", "trade_date", "slice"), many).cast("int").alias("grp")
    left = wanted.where(known).select("name", "symbol", "trade_date", piece(F.col("ticks")).alias("slice"), "ticks")
    right = first_of_tick(candidates.where(known)).select(
        "symbol",
        "trade_date",
        F.explode(F.array_distinct(F.array(*[piece(F.col("ticks") + d) for d in (-tolerance, 0, tolerance)]))).alias("slice"),
        "ticks",
        "seqno",
        "sysid",
    )

    def match(wanted: pa.Table, candidates: pa.Table) -> pa.Table:
        import duckdb

        if not wanted.num_rows or not candidates.num_rows:
            return _SCHEMA.empty_table()
        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": scratch()}) as db:
            db.register("wanted", wanted)
            db.register("candidates", candidates)
            return db.sql(_MATCH.format(tolerance=tolerance)).to_arrow_table().cast(_SCHEMA)

    return (
        left.select("*", group).groupBy("grp").cogroup(right.select("*", group).groupBy("grp")).applyInArrow(match, _OUT)
    )


_SCHEMA = pa.schema([("name", pa.string()), ("sysid", pa.int64()), ("seqno", pa.int64()), ("apart", pa.int64())])


def order_matches(order_specs: DataFrame, event_feed: DataFrame, rows: int, seconds: float = 2.0) -> DataFrame:
    """The order row of the feed nearest to each dispid's ``t0``: dispid, sysid, seqno, apart.

    Of repeated rows of a dispid the one loaded last counts. Market and side spellings don't matter; symbols are
    brought to six digits. A null time is read from the clock string beside it.
    """
    wanted = (
        order_specs.where("dispid IS NOT NULL")
        .groupBy("dispid")
        .agg(
            F.max(
                F.struct(
                    "loaded_at",
                    six_digits(F.col("symbol")).alias("symbol"),
                    F.trim("trade_date").alias("trade_date"),
                    F.coalesce(second_ticks(F.col("t0")), clock_ticks(F.col("t0s"))).alias("ticks"),
                )
            ).alias("s")
        )
        .select(F.col("dispid").alias("name"), "s.symbol", "s.trade_date", "s.ticks")
    )
    orders = event_feed.where("actiontype = 0").select(
        six_digits(F.col("symbol")).alias("symbol"),
        "trade_date",
        F.coalesce(second_ticks(F.col("timeseconds")), clock_ticks(F.col("hms"))).alias("ticks"),
        "seqno",
        plain_id(F.col("sysid")).alias("sysid"),
    )
    return nearest(wanted, orders, round(seconds * TICKS), rows).withColumnRenamed("name", "dispid")
