"""CSV feeds as tapes: the unified export, two exchanges' own files, minute bars.

Columns are taken by their names in the header and brought to one shape; Spark splits the files and reads only the fields used.
A reader of tapes gives ``TAPE``; rows that can't be one (no clock, another type) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.clean import MINUTE_NS, clock_ticks, finite, plain_id
from tapeline.operators.tape import CANCEL, ORDER, TRADE, cents
from tapeline.sources.csv_files import read_csv

TAPE = [
    "symbol", "market", "trade_date", "seqno", "hms", "timeseconds", "actiontype", "direction", "sysid", "buyid", "sellid",
    "price", "intprice", "volume", "turnover", "pricetype", "tradedirection",
]


def _get(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A field of the header as ``kind``; null where the file lacks it or it can't be read."""
    return F.col(f"`{name}`").try_cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _tape(df: DataFrame, **fields: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    ticks = clock_ticks(fields["hms"], 1000)
    given = {"sysid": zero, "buyid": zero, "sellid": zero, "pricetype": F.lit("2"), "tradedirection": F.lit(0)} | fields
    given |= {"timeseconds": ticks / 1000, "intprice": cents(fields["price"])}
    given["turnover"] = F.coalesce(given.get("turnover", F.lit(None).cast("double")), F.lit(0.0))
    return df.select(*[given[c].alias(c) for c in TAPE]).where("timeseconds IS NOT NULL AND actiontype IS NOT NULL")


def unified(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The unified feed of both markets: ids with channel prefix, sides as 0 and 1, one sequence ``appSeq``; a file or a folder of slices."""
    df = read_csv(spark, path)
    action = _get(df, "actionType", "int")
    bid, ask = F.coalesce(_get(df, "bidId", "long"), F.lit(0)), F.coalesce(_get(df, "askId", "long"), F.lit(0))
    code = F.split(F.col("instrumentID"), r"\.")
    zero = F.lit(0).cast("long")
    trade = action == TRADE
    return _tape(
        df.where(F.lower(F.get(code, F.lit(1))).isin("sh", "sz")),
        symbol=F.get(code, F.lit(0)),
        market=F.lower(F.get(code, F.lit(1))),
        trade_date=F.regexp_replace(F.split("exchangeTime", " ")[0], "-", ""),
        seqno=F.coalesce(_get(df, "appSeq", "long"), zero),
        hms=F.element_at(F.split("exchangeTime", " "), -1),
        actiontype=action,
        direction=F.when(_get(df, "dir", "int") == 0, "B").otherwise("S"),
        sysid=F.when(trade, zero).otherwise(plain_id(F.when(bid > 0, bid).otherwise(ask))),
        buyid=F.when(trade, plain_id(bid)).otherwise(zero),
        sellid=F.when(trade, plain_id(ask)).otherwise(zero),
        price=_get(df, "price", "double"),
        volume=_get(df, "volume", "long"),
        turnover=_get(df, "turnover", "double"),
        pricetype=F.coalesce(_get(df, "priceType"), F.lit("2")),
        tradedirection=F.coalesce(_get(df, "tradeDirection", "int"), F.lit(0)),
    )


def shanghai(spark: SparkSession, path: str | list[str], trade_date: str) -> DataFrame:
    """One file of orders (A), cancels (D) and trades (T), others left out; the flag B, S or N says who was active."""
    df = read_csv(spark, path)
    buy, sell = F.coalesce(_get(df, "BuyOrderNO", "long"), F.lit(0)), F.coalesce(_get(df, "SellOrderNO", "long"), F.lit(0))
    kind, flag, zero = _get(df, "Type"), _get(df, "TickBSFlag"), F.lit(0).cast("long")
    action = F.when(kind == "A", ORDER).when(kind == "D", CANCEL).when(kind == "T", TRADE)
    return _tape(
        df,
        symbol=_get(df, "SecurityID"),
        market=F.lit("sh"),
        trade_date=F.lit(trade_date),
        seqno=F.coalesce(_get(df, "BizIndex", "long"), zero),
        hms=_get(df, "TickTime"),
        actiontype=action,
        direction=F.when(kind == "D", F.when((buy > 0) & (sell == 0), "B").otherwise("S")).otherwise(flag),
        sysid=F.when(kind == "A", F.when(flag == "B", buy).otherwise(sell)).when(kind == "D", F.when(buy > 0, buy).otherwise(sell)).otherwise(zero),
        buyid=F.when(kind == "T", buy).otherwise(zero),
        sellid=F.when(kind == "T", sell).otherwise(zero),
        price=_get(df, "Price", "double"),
        volume=_get(df, "Qty", "long"),
        turnover=_get(df, "TradeMoney", "double"),
        tradedirection=F.when((kind == "T") & (flag == "B"), 1).when((kind == "T") & (flag == "S"), 2).otherwise(0),
    )


def shenzhen(spark: SparkSession, orders: str | list[str], trades: str | list[str], trade_date: str) -> DataFrame:
    """A file of orders (side 49 buys; type 49 market, 85 own best) and one of cancels (52) and trades (70)."""
    o, t = read_csv(spark, orders), read_csv(spark, trades)
    symbol = lambda df: F.lpad(_get(df, "SecurityID"), 6, "0")
    common = lambda df: {"symbol": symbol(df), "market": F.lit("sz"), "trade_date": F.lit(trade_date), "seqno": _get(df, "ApplSeqNum", "long"), "hms": _get(df, "TransactTime")}
    kind = _get(o, "OrdType", "int")
    ordered = _tape(
        o,
        **common(o),
        actiontype=F.lit(ORDER),
        direction=F.when(_get(o, "Side", "int") == 49, "B").otherwise("S"),
        sysid=_get(o, "ApplSeqNum", "long"),
        price=_get(o, "Price", "double"),
        volume=_get(o, "OrderQty", "long"),
        pricetype=F.when(kind == 49, "1").when(kind == 85, "U").otherwise("2"),
    )
    bid, ask, did = (F.coalesce(_get(t, c, k), F.lit(0)) for c, k in (("BidApplSeqNum", "long"), ("OfferApplSeqNum", "long"), ("ExecType", "int")))
    price, volume, zero = _get(t, "LastPx", "double"), _get(t, "LastQty", "long"), F.lit(0).cast("long")
    traded = _tape(
        t,
        **common(t),
        actiontype=F.when(did == 52, CANCEL).when(did == 70, TRADE),
        direction=F.when(did == 52, F.when(bid > 0, "B").otherwise("S")),
        sysid=F.when(did == 52, F.when(bid > 0, bid).otherwise(ask)).otherwise(zero),
        buyid=F.when(did == 70, bid).otherwise(zero),
        sellid=F.when(did == 70, ask).otherwise(zero),
        price=price,
        volume=volume,
        turnover=F.when(did == 70, price * volume),
    )
    return ordered.unionByName(traded)


#: Short field names of bars fetched by REST.
SHORT = {"t": "window_start", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}


def minute_bars(
    spark: SparkSession, folder: str, profile: str, first: str, last: str, tickers: list[str] | None = None, zone: str = "America/New_York"
) -> DataFrame:
    """Bars of all ``.csv`` and ``.csv.gz`` files below ``folder`` whose names begin with an ISO date from ``first`` to ``last``.

    Columns: ticker, profile, window_start, open, high, low, close, volume, ``file_date`` and ``fault``, the first rule a row
    breaks (null if none): ``ticker`` missing, ``number`` not finite, ``price`` not above zero or volume below, ``bounds`` of high and low,
    ``unit`` (the stamp, in nanoseconds for ``flatfiles`` and milliseconds for ``rest_split_adjusted``, is not on the file's date in ``zone``),
    ``minute`` (not a full one). Files outside the dates are not read; ``tickers`` are compared where the rows are read.
    """
    per_ns = {"flatfiles": 1, "rest_split_adjusted": 10**6}[profile]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    dated = found.select("path", F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})(?:_.*)?\.csv(?:\.gz)?$", 1).alias("date"))
    paths = [r.path for r in dated.where(F.col("date").between(first, last)).collect()]  # names of files only
    if not paths:
        raise FileNotFoundError(f"no bars from {first} to {last} below {folder}")
    raw = read_csv(spark, paths)
    raw = raw.withColumnsRenamed({k: v for k, v in SHORT.items() if "window_start" not in raw.columns and k in raw.columns})
    lacking = {"ticker", "window_start", "open", "high", "low", "close", "volume"} - set(raw.columns)
    if lacking:
        raise ValueError(f"bars lack {sorted(lacking)}")
    if tickers is not None:
        raw = raw.where(F.col("ticker").isin(tickers))
    date = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})", 1)
    numbers = ["open", "high", "low", "close", "volume"]
    rows = raw.select(
        "ticker", F.lit(profile).alias("profile"), _get(raw, "window_start", "long").alias("window_start"), *[_get(raw, c, "double").alias(c) for c in numbers], date.alias("file_date")
    )
    midnight = lambda d: F.unix_seconds(F.to_utc_timestamp(d.cast("timestamp_ntz"), zone).cast("timestamp"))
    day = F.to_date("file_date")
    second = F.floor(F.col("window_start") / (10**9 // per_ns))
    good = finite(F.col("open"))
    for c in numbers[1:]:
        good = good & finite(F.col(c))
    fault = (
        F.when(F.col("ticker").isNull() | (F.trim("ticker") == ""), "ticker")
        .when(~good, "number")
        .when((F.least(*numbers[:4]) <= 0) | (F.col("volume") < 0), "price")
        .when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), "bounds")
        .when(F.col("window_start").isNull() | (second < midnight(day)) | (second >= midnight(F.date_add(day, 1))), "unit")
        .when(F.pmod(F.col("window_start"), F.lit(MINUTE_NS // per_ns)) != 0, "minute")
    )
    return rows.withColumn("fault", fault)


def strict(bars: DataFrame) -> DataFrame:
    """``bars`` without ``fault``; a row that breaks a rule, or two rows of a ticker and stamp, fail the job that reads them."""
    counted = bars.groupBy(*[c for c in bars.columns if c != "fault"], "fault").agg(F.count("*").alias("_n"))
    stamps = counted.groupBy("ticker", "window_start").agg(F.sum("_n").alias("_m"), F.first(F.struct(*[c for c in bars.columns])).alias("_r"))
    checked = F.when(F.col("_r.fault").isNotNull(), F.raise_error(F.concat(F.lit("a bar breaks the rule "), F.col("_r.fault")))).when(
        F.col("_m") > 1, F.raise_error(F.lit("several bars of a ticker and stamp"))
    )
    return stamps.withColumn("_ok", checked.cast("string")).where("_ok IS NULL").select(*[F.col(f"_r.{c}").alias(c) for c in bars.columns if c != "fault"])
