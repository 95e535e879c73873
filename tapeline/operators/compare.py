"""Differences of two copies of a table, row by row and field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.clean import plain_id, six_digits


@dataclass(frozen=True)
class Field:
    """A field compared. ``tolerance``: numbers no farther apart are equal. ``unknown``: a value equal to any, to null too."""

    name: str
    tolerance: float | None = None
    unknown: int | None = None

    def normal(self) -> Column:
        """Equal for two values only if they don't differ: with a tolerance, the number of the cell of that width."""
        c = F.col(self.name)
        return c if self.tolerance is None else F.round(c / self.tolerance)

    def differs(self) -> Column:
        a, b = F.col(f"a.{self.name}"), F.col(f"b.{self.name}")
        if self.tolerance is not None:
            far = F.abs(a - b) > self.tolerance
            far = F.when(F.isnan(a) | F.isnan(b), ~(F.isnan(a) & F.isnan(b))).otherwise(far)
        else:
            far = a != b
        if self.unknown is not None:
            far = far & (a != self.unknown) & (b != self.unknown)
        return F.coalesce(far, a.isNull() != b.isNull())


def differences(a: DataFrame, b: DataFrame, key: list[str], fields: list[Field]) -> DataFrame:
    """``key`` and ``diff``: ``a_only``, ``b_only`` or the name of a field that differs, one row each.

    Both sides have at most one row a key. EXCEPT ALL in both directions is one aggregation: each normalised row is
    counted by side, and where the counts differ the side with more keeps it, with the values as they were. The two
    residues, also of one row a key, are joined in full by grouping them by key; values that merely fell into
    neighbouring cells are compared exactly there. Null keys equal each other; a null differs from a value.
    """
    names = [f.name for f in fields]

    def side(df: DataFrame, is_a: bool) -> DataFrame:
        return df.select(*key, *[f.normal().alias(f"_n_{f.name}") for f in fields], F.struct(*names).alias("_raw"), F.lit(is_a).alias("_a"))

    raw = lambda a: F.max(F.when(F.col("_a") if a else ~F.col("_a"), F.col("_raw")))
    counted = (
        side(a, True)
        .unionByName(side(b, False))
        .groupBy(*key, *[f"_n_{n}" for n in names])
        .agg(F.sum(F.when(F.col("_a"), 1).otherwise(-1)).alias("_more"), raw(True).alias("a"), raw(False).alias("b"))
        .where("_more <> 0")
    )
    both = counted.groupBy(*key).agg(
        F.max(F.when(F.col("_more") > 0, F.col("a"))).alias("a"), F.max(F.when(F.col("_more") < 0, F.col("b"))).alias("b")
    )
    diffs = (
        F.when(F.col("b").isNull(), F.array(F.lit("a_only")))
        .when(F.col("a").isNull(), F.array(F.lit("b_only")))
        .otherwise(F.array_compact(F.array(*[F.when(f.differs(), F.lit(f.name)) for f in fields])))
    )
    return both.select(*key, F.explode_outer(diffs).alias("diff")).where("diff IS NOT NULL")


def first_rows(rows: DataFrame, key: list[str], order: str, keep: list[str]) -> DataFrame:
    """Of several rows of a feed and key the one with the smallest ``order``."""
    return rows.groupBy("feed", *key).agg(F.min(F.struct(order, *keep)).alias("_r")).select("feed", *key, *[f"_r.{c}" for c in keep])


KEY = ["symbol", "trade_date", "sysid"]
ORDER_FIELDS = [Field("direction"), Field("price", tolerance=0.005), Field("volume"), Field("cls", unknown=0)]
TRADE_FIELDS = [Field("trans_vlm"), Field("vwap", tolerance=0.005)]


def build_differences(order_rows: DataFrame, trade_rows: DataFrame) -> DataFrame:
    """Differences of feeds A and B of both tables, after the spelling of symbols, ids and directions is made one.

    Of order_rows only the rows of ordertype ``wt`` count. Columns: tbl, symbol, trade_date, sysid, diff.
    """
    plain = [six_digits(F.col("symbol")).alias("symbol"), "trade_date", plain_id(F.col("sysid")).alias("sysid")]
    orders = order_rows.where("ordertype = 'wt'").select(
        "feed", *plain, "row_no", F.upper(F.trim("direction")).alias("direction"), "price", "volume", "cls"
    )
    trades = trade_rows.select("feed", *plain, "row_no", "trans_vlm", "vwap")
    out = []
    for name, rows, fields in (("order_rows", orders, ORDER_FIELDS), ("trade_rows", trades, TRADE_FIELDS)):
        first = first_rows(rows, KEY, "row_no", [f.name for f in fields])
        a, b = (first.where(F.col("feed") == x).drop("feed") for x in "AB")
        out.append(differences(a, b, KEY, fields).select(F.lit(name).alias("tbl"), *KEY, "diff"))
    return out[0].unionByName(out[1])
