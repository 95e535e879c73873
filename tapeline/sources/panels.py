"""Panels kept as a file a day, the day in the file's name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources.csv_files import read_csv

#: The first date in a file's name, with or without dashes.
DATE = r"(\d{4}-\d{2}-\d{2}|\d{8})"


def day_files(spark: SparkSession, folder: str, schema: str, first: str = "00000000", last: str = "99999999", pattern: str = "*.csv*") -> DataFrame:
    """All files below ``folder`` as one table with ``day`` (``YYYYMMDD``, from the file's name); those of other days are not opened.

    ``schema`` gives the columns by name, nulls where the files lack one. All files have one header.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    dated = found.select("path", F.regexp_replace(F.regexp_extract(F.element_at(F.split("path", "/"), -1), DATE, 1), "-", "").alias("day"))
    paths = [r.path for r in dated.where((F.col("day") != "") & F.col("day").between(first, last)).collect()]  # names of files only
    empty = spark.createDataFrame([], schema)
    if not paths:
        return empty.withColumn("day", F.lit(None).cast("string"))
    raw = read_csv(spark, paths)
    day = F.regexp_replace(F.regexp_extract("_metadata.file_name", DATE, 1), "-", "").alias("day")
    field = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
    return raw.select(*[field(f).alias(f.name) for f in empty.schema], day)


def merged(panels: list[DataFrame], key: list[str]) -> DataFrame:
    """Panels joined by their key, rows that all of them have; columns of the same name stay from the first."""
    out = panels[0]
    for p in panels[1:]:
        out = out.join(p.select(*key, *[c for c in p.columns if c not in out.columns]), key)
    return out
