"""Assignment of stamps to trading sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.clean import DAY_NS


def in_session(df: DataFrame, sessions: DataFrame, ns: str = "ns") -> DataFrame:
    """Rows of ``df`` whose stamp ``ns`` lies in a session ``[open_ns, close_ns)``, with that session's columns.

    The calendar has a few thousand rows whatever the data's size, so it is
    broadcast; a session that spans midnight UTC is listed under both days.
    Rows with a null stamp are in no session.
    """
    calendar = sessions.select(
        "session_date",
        "open_ns",
        "close_ns",
        F.explode(F.sequence(_div(F.col("open_ns")), _div(F.col("close_ns") - 1))).alias("_day"),
    )
    keyed = df.withColumn("_day", _div(F.col(ns)))
    return (
        keyed.join(F.broadcast(calendar), "_day")
        .where((F.col(ns) >= F.col("open_ns")) & (F.col(ns) < F.col("close_ns")))
        .drop("_day")
    )


def _div(c):
    """Days since epoch, in whole numbers: a double can't hold nanoseconds."""
    return F.round((c - F.pmod(c, F.lit(DAY_NS))) / F.lit(DAY_NS)).cast("long")
