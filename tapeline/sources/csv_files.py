"""CSV files with a header as tables of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All files at ``path`` with the columns of the first one's header; a file with another header fails the job that reads it,
    since Spark would take its fields by their places."""
    first = path if isinstance(path, str) else path[0]
    names = spark.read.option("header", True).csv(first).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
