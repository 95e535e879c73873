"""A feed of inserts, updates and deletes applied in order: per-bucket DuckDB upserts, published as one.

Each bucket is a group of whole keys, so any order of delivery within it is
harmless: the embedded table stores for each key the sequence of the insert that holds,
and an insert replaces it only if its own is greater; deductions are kept with their
sequence, each once, and count if they come after the insert that holds. Keys whose
rest is zero stay as tombstones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.clean import plain_id
from tapeline.session import buckets, scratch, shared_dir

#: Changes of a bucket. A bucket's table takes about 100 bytes a change.
PER_BUCKET = 150_000

STATE = "symbol string, trade_date string, sysid long, seqno long, volume long, left_over long, deleted boolean"

_UPSERT = """
CREATE TABLE state (symbol VARCHAR, trade_date VARCHAR, sysid BIGINT, seqno BIGINT, volume BIGINT,
                    PRIMARY KEY (symbol, trade_date, sysid));
CREATE TABLE taken (symbol VARCHAR, trade_date VARCHAR, sysid BIGINT, seqno BIGINT, actiontype INTEGER, volume BIGINT,
                    PRIMARY KEY (symbol, trade_date, sysid, seqno, actiontype));
"""
_INSERTS = """
INSERT INTO state
SELECT symbol, trade_date, sysid, max(seqno), arg_max(volume, seqno)
FROM batch WHERE actiontype = 0 GROUP BY ALL
ON CONFLICT (symbol, trade_date, sysid) DO UPDATE SET seqno = excluded.seqno, volume = excluded.volume
WHERE excluded.seqno > state.seqno
"""
_DEDUCTIONS = """
INSERT INTO taken
SELECT symbol, trade_date, sysid, seqno, actiontype, max(volume)
FROM batch WHERE actiontype <> 0 GROUP BY ALL
ON CONFLICT DO NOTHING
"""
_EXPORT = """
SELECT s.symbol, s.trade_date, s.sysid, greatest(s.seqno, coalesce(max(t.seqno), s.seqno)) AS seqno, s.volume,
       greatest(s.volume - coalesce(sum(t.volume), 0), 0)::BIGINT AS left_over,
       s.volume - coalesce(sum(t.volume), 0) <= 0 AS deleted
FROM state s LEFT JOIN taken t
  ON t.symbol = s.symbol AND t.trade_date = s.trade_date AND t.sysid = s.sysid AND t.seqno >= s.seqno
GROUP BY s.symbol, s.trade_date, s.sysid, s.seqno, s.volume
"""


def order_changes(feed: DataFrame) -> DataFrame:
    """The feed as changes of single orders: symbol, trade_date, sysid, seqno, actiontype, volume.

    A trade is a change of both its orders; ids lose their channel prefix. Rows without symbol, date, seqno,
    actiontype or id name no change and are left out; a null volume changes nothing by zero.
    """
    ids = F.when(F.col("actiontype") == 2, F.array_distinct(F.array(plain_id(F.col("buyid")), plain_id(F.col("sellid"))))).otherwise(
        F.array(plain_id(F.col("sysid")))
    )
    return (
        feed.where("symbol IS NOT NULL AND trade_date IS NOT NULL AND seqno IS NOT NULL AND actiontype IN (0, 1, 2)")
        .select(
            "symbol",
            "trade_date",
            F.explode(ids).alias("sysid"),
            "seqno",
            "actiontype",
            F.greatest(F.coalesce("volume", F.lit(0).cast("long")), F.lit(0)).alias("volume"),
        )
        .where("sysid IS NOT NULL")
    )


def distinct_changes(changes: DataFrame) -> DataFrame:
    """Each change once, with the greatest volume of its copies."""
    return changes.groupBy("symbol", "trade_date", "sysid", "seqno", "actiontype").agg(F.max("volume").alias("volume"))


def upsert(changes: DataFrame, rows: int) -> DataFrame:
    """The state of each key after all its ``changes``, tombstones included; ``rows`` sizes the buckets.

    Repeated changes (same key, seqno and actiontype) apply once; should copies differ in volume the greatest
    counts. Deductions of keys without an insert before them do nothing. ``seqno`` is that of the last change that
    touched the key if it lives; ``left_over`` is what is left of ``volume``.

    Buckets hash the whole key, so the rows of one hot symbol or day spread over all of them. Copies of a change
    become one before, combined where they are read; the different changes of one key stay in one bucket.
    """
    grouped = distinct_changes(changes).withColumn(
        "bucket", F.pmod(F.xxhash64("symbol", "trade_date", "sysid"), F.lit(buckets(rows, PER_BUCKET, 12))).cast("int")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": scratch()}) as db:
            db.execute(_UPSERT)
            for got in batches:
                batch = pa.Table.from_batches([got])
                db.register("batch", batch)
                db.execute(_INSERTS)
                db.execute(_DEDUCTIONS)
                db.unregister("batch")
            yield from db.sql(_EXPORT).to_arrow_table().cast(_ARROW).to_batches()

    return grouped.groupBy("bucket").applyInArrow(apply, STATE)


_ARROW = pa.schema(
    [
        ("symbol", pa.string()),
        ("trade_date", pa.string()),
        ("sysid", pa.int64()),
        ("seqno", pa.int64()),
        ("volume", pa.int64()),
        ("left_over", pa.int64()),
        ("deleted", pa.bool_()),
    ]
)


def publish(state: DataFrame, path: str) -> DataFrame:
    """Writes ``state`` as a new version below ``path`` and then names it the current one; returns that version.

    Runs the job. What makes a version current is one empty file with its number, created when all bucket results
    are there: no rename, no overwriting, so readers see all of a version or none on any file system, and a job that dies before
    leaves the current version as it was. The version before stays for those who still read it; older ones are dropped.
    """
    spark = state.sparkSession
    files, jpath = _files(spark, path)
    before = _versions(spark, path)
    version = f"{int(before[-1].split('-')[0]) + 1 if before else 0:012d}-{uuid.uuid4().hex}"
    state.write.parquet(f"{path}/{version}")
    if not files.createNewFile(jpath(f"{path}/{_CURRENT}{version}")):
        raise OSError(f"{version} could not be published in {path}")
    for old in before[:-1]:
        files.delete(jpath(f"{path}/{_CURRENT}{old}"), False)
        files.delete(jpath(f"{path}/{old}"), True)
    return spark.read.parquet(f"{path}/{version}")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the state published at ``path``."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{versions[-1]}")


_CURRENT = "_current-"


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and what makes its paths."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    return jpath(path).getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The versions published at ``path``, the current one last."""
    files, jpath = _files(spark, path)
    found = files.globStatus(jpath(f"{path}/{_CURRENT}*")) or []
    return sorted(f.getPath().getName()[len(_CURRENT) :] for f in found)


def live_orders(feed: DataFrame, rows: int, name: str) -> DataFrame:
    """The orders live after the last change of each symbol and day, with the seqno of the change that touched them last.

    Runs the job: the state is published in the shared folder under ``name``, where :func:`published` finds it, and read from there.
    """
    state = upsert(order_changes(feed), 2 * rows)
    out = publish(state, f"{shared_dir(feed.sparkSession).rstrip('/')}/{name}")
    return out.where(~F.col("deleted")).select("symbol", "trade_date", "sysid", "seqno")
