"""Partitioned panels, ordered exports and run folders."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_panel(df: DataFrame, path: str, day: str, order: list[str], parts: int = 1) -> None:
    """Parquet (zstd) with a folder for each ``day``, rows in ``order`` within each file; ``parts`` files a day, cut by the first of ``order``.

    A day's rows go to its files' tasks by one shuffle; the sort spills. Days written again are replaced, others stay.
    """
    spread = F.pmod(F.xxhash64(order[0]), F.lit(parts)) if parts > 1 else F.lit(0)
    (
        df.withColumn("_part", spread)
        .repartition(F.col(day), F.col("_part"))
        .sortWithinPartitions(day, *order)
        .drop("_part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(day)
        .parquet(path)
    )


def write_ordered_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV whose files, in the order of their names, hold all rows in ``order``: cut by ranges, each sorted, none in one task."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("header", True).csv(path)


def write_run(tables: dict[str, DataFrame], path: str, about: dict | None = None) -> dict:
    """A run's tables below a fresh folder, with ``manifest.json`` beside them; an existing folder is refused.

    The manifest says ``running`` until all tables are there, then ``complete`` with each one's columns and rows, or ``failed`` with the error.
    """
    spark = next(iter(tables.values())).sparkSession
    files, folder = _folder(spark, path)
    if files.exists(folder):
        raise FileExistsError(path)
    files.mkdirs(folder)
    manifest = {"status": "running", "begun": _now(), "about": about or {}, "tables": {}}
    _write(spark, path, manifest)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}")
            manifest["tables"][name] = {"columns": dict(df.dtypes), "rows": spark.read.parquet(f"{path}/{name}").count()}
        manifest |= {"status": "complete", "ended": _now()}
    except Exception as e:
        manifest |= {"status": "failed", "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}
        raise
    finally:
        _write(spark, path, manifest)
    return manifest


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _write(spark: SparkSession, path: str, manifest: dict) -> None:
    files, _ = _folder(spark, path)
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json"), True)
    try:
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
    finally:
        out.close()
