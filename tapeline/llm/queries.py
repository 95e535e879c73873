"""Queries of the problems of this package, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import corpus, nearest, packing, sentences
from tapeline.sources.tables import table


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each dispid's nearest order with the distance in seconds."""
    feed = table(spark, d, "event_feed")
    pairs = nearest.order_matches(table(spark, d, "order_specs"), feed, feed.count())
    return pairs.withColumn("apart", F.col("apart") / nearest.TICKS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("dispid", "sysid")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_ids(table(spark, d, "documents"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each specification."""
    documents = table(spark, d, "documents")
    return packing.pack(documents, table(spark, d, "pack_specs"), documents.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused share of each specification."""
    bins = p8_packed(spark, d).groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("held"))
    used = bins.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"))
    specs = table(spark, d, "pack_specs").select("spec_id", "capacity")
    return used.join(F.broadcast(specs), "spec_id").select(
        "spec_id", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused")
    )


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of the packing by specification: documents in it, rows of documents that are missing or broken, containers overfull,
    documents split though they fit."""
    return packing.totals(p8_packed(spark, d), table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.end_rows(table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves with their places."""
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_matches, p7_ids, p8_packed, p8_fill, p8_totals, p9_found, p9_sentences)}

_TIME = "CAST(round(coalesce({0}, CASE WHEN {1} LIKE '%:%' THEN split_part({1}, ':', 1)::DOUBLE * 3600 + split_part({1}, ':', 2)::DOUBLE * 60 + split_part({1}, ':', 3)::DOUBLE ELSE TRY_CAST({1} AS DOUBLE) / 1000 END) * 10000) AS BIGINT)"
_P4 = f"""
WITH wanted AS (
  SELECT dispid, lpad(regexp_extract(symbol, '([0-9]+)', 1), 6, '0') AS symbol, trade_date, {_TIME.format('t0', 't0s')} AS ticks
  FROM order_specs QUALIFY row_number() OVER (PARTITION BY dispid ORDER BY loaded_at DESC) = 1),
orders AS (
  SELECT symbol, trade_date, seqno, CASE WHEN sysid > 1000000000000 THEN sysid % 1000000000000 ELSE sysid END AS sysid,
         {_TIME.format('timeseconds', 'hms')} AS ticks
  FROM event_feed WHERE actiontype = 0)
SELECT w.dispid, o.sysid, o.seqno, abs(o.ticks - w.ticks) / 10000 AS apart
FROM wanted w JOIN orders o ON o.symbol = w.symbol AND o.trade_date = w.trade_date AND o.ticks BETWEEN w.ticks - 20000 AND w.ticks + 20000
QUALIFY row_number() OVER (PARTITION BY w.dispid ORDER BY abs(o.ticks - w.ticks), o.seqno) = 1
"""

SQL = {
    "p4_matches": _P4,
    "p4_found": f"SELECT dispid, sysid FROM ({_P4})",
    "p8_totals": "SELECT spec_id, count(DISTINCT doc_id) AS documents, 0::BIGINT AS missing, 0::BIGINT AS broken, 0::BIGINT AS overfull, 0::BIGINT AS split_though_fitting"
    " FROM pack_specs CROSS JOIN documents GROUP BY ALL",
}
