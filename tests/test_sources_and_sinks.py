import gzip
import json

import pytest
from pyspark.sql import functions as F

from tapeline.sinks import folders
from tapeline.sources import feeds, panels


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_unified_feed(spark, tmp_path):
    path = write(
        tmp_path / "feed.csv",
        "instrumentID,exchangeTime,localTime,tradeExchange,trSalCond,fillType,actionType,dir,tradeDirection,priceType,bidId,askId,price,turnover,volume,appSeq",
        "600001.SH,2020-01-02 09:30:00.120000000,x,,,0,0,0,0,2,5000000000007,0,10.01,,300,1",
        "000002.SZ,2020-01-02 09:30:01.000000000,x,,,0,1,1,0,0,0,2000000000009,9.99,0,100,2",
        "600001.SH,2020-01-02 09:30:02.000000000,x,,,0,2,0,2,0,5000000000007,5000000000008,10.01,1001,100,3",
        "700.HK,2020-01-02 09:30:02.000000000,x,,,0,2,0,2,0,1,2,10.01,1001,100,4",
        "600001.SH,,x,,,0,2,0,2,0,1,2,10.01,1001,100,5",
    )
    rows = [tuple(r) for r in feeds.unified(spark, path).orderBy("seqno").collect()]
    assert rows == [
        ("600001", "sh", "20200102", 1, "09:30:00.120000000", 34200.12, 0, "B", 7, 0, 0, 10.01, 1001, 300, 0.0, "2", 0),
        ("000002", "sz", "20200102", 2, "09:30:01.000000000", 34201.0, 1, "S", 9, 0, 0, 9.99, 999, 100, 0.0, "0", 0),
        ("600001", "sh", "20200102", 3, "09:30:02.000000000", 34202.0, 2, "B", 0, 7, 8, 10.01, 1001, 100, 1001.0, "0", 2),
    ]


def test_two_exchanges(spark, tmp_path):
    sh = write(
        tmp_path / "sh.csv", "BizIndex,SecurityID,TickTime,Type,BuyOrderNO,SellOrderNO,Price,Qty,TradeMoney,TickBSFlag",
        "1,600001,09:30:00.000,A,5,0,10.0,100,,B", "2,600001,09:30:00.010,A,0,6,10.0,200,,S", "3,600001,09:30:00.020,T,5,6,10.0,100,1000,N",
        "4,600001,09:30:00.030,D,0,6,0,100,,", "5,600001,09:30:00.040,S,0,0,0,0,,",
    )
    got = feeds.shanghai(spark, sh, "20200102").orderBy("seqno").select("seqno", "actiontype", "direction", "sysid", "buyid", "sellid", "tradedirection").collect()
    assert [tuple(r) for r in got] == [(1, 0, "B", 5, 0, 0, 0), (2, 0, "S", 6, 0, 0, 0), (3, 2, "N", 0, 5, 6, 0), (4, 1, "S", 6, 0, 0, 0)]
    orders = write(tmp_path / "o.csv", "SecurityID,Price,OrderQty,Side,TransactTime,ApplSeqNum,OrdType", "1,10.0,100,49,09:30:00.000,1,50", "1,0,50,50,09:30:00.000,2,49")
    trades = write(
        tmp_path / "t.csv", "BidApplSeqNum,OfferApplSeqNum,SecurityID,LastPx,LastQty,ExecType,TransactTime,ApplSeqNum",
        "1,2,1,10.0,50,70,09:30:00.010,3", "1,0,1,0,50,52,09:30:00.020,4", "1,0,1,0,50,99,09:30:00.020,5",
    )
    got = feeds.shenzhen(spark, orders, trades, "20200102").orderBy("seqno").select("symbol", "actiontype", "direction", "sysid", "buyid", "sellid", "pricetype", "turnover").collect()
    assert [tuple(r) for r in got] == [
        ("000001", 0, "B", 1, 0, 0, "2", 0.0), ("000001", 0, "S", 2, 0, 0, "1", 0.0), ("000001", 2, None, 0, 1, 2, "2", 500.0), ("000001", 1, "B", 1, 0, 0, "2", 0.0),
    ]


NS = 1_741_617_000  # 2025-03-10 10:30 in New York


def bar_lines(*rows, head="ticker,window_start,open,high,low,close,volume,transactions"):
    return [head, *[",".join(map(str, r)) for r in rows]]


def test_minute_bars_are_found_by_date_and_faults_named(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    at = NS * 10**9
    good = ("A", at, 1, 2, 1, 1.5, 10, 3)
    write(tmp_path / "deep" / "2025-03-10_x.csv", *bar_lines(
        good, ("", at, 1, 2, 1, 1, 1, 1), ("B", at, "nan", 2, 1, 1, 1, 1), ("C", at, 1, 2, 0, 1, 1, 1), ("D", at, 1, 1, 1, 1.5, 1, 1),
        ("E", NS * 1000, 1, 2, 1, 1, 1, 1), ("F", at + 86_400 * 10**9, 1, 2, 1, 1, 1, 1), ("G", at + 1, 1, 2, 1, 1, 1, 1),
    ))
    with gzip.open(tmp_path / "2025-03-11.csv.gz", "wt") as f:
        f.write("\n".join(bar_lines(("A", at + 86_400 * 10**9, 1, 2, 1, 1.5, 10, 3))) + "\n")
    write(tmp_path / "2025-03-12.csv", *bar_lines(("A", at, 1, 2, 1, 1.5, 10, 3)))
    write(tmp_path / "notes.csv", "a,b")
    bars = feeds.minute_bars(spark, str(tmp_path), "flatfiles", "2025-03-10", "2025-03-11")
    got = {(r.ticker or "", r.file_date): r.fault for r in bars.collect()}
    assert got == {
        ("A", "2025-03-10"): None, ("", "2025-03-10"): "ticker", ("B", "2025-03-10"): "number", ("C", "2025-03-10"): "price", ("D", "2025-03-10"): "bounds",
        ("E", "2025-03-10"): "unit", ("F", "2025-03-10"): "unit", ("G", "2025-03-10"): "minute", ("A", "2025-03-11"): None,
    }
    assert feeds.strict(feeds.minute_bars(spark, str(tmp_path), "flatfiles", "2025-03-10", "2025-03-11", ["A"])).count() == 2
    for wrong in ("D", "G"):
        with pytest.raises(Exception, match="breaks the rule"):
            feeds.strict(feeds.minute_bars(spark, str(tmp_path), "flatfiles", "2025-03-10", "2025-03-11", ["A", wrong])).collect()
    with pytest.raises(FileNotFoundError):
        feeds.minute_bars(spark, str(tmp_path), "flatfiles", "2024-01-01", "2024-02-01")


def test_short_names_units_and_repeated_stamps(spark, tmp_path):
    rows = [("A", NS * 1000, 1, 2, 1, 1.5, 10)] * 2
    write(tmp_path / "2025-03-10.csv", *bar_lines(*rows, head="ticker,t,o,h,l,c,v"))
    bars = feeds.minute_bars(spark, str(tmp_path), "rest_split_adjusted", "2025-03-10", "2025-03-10")
    assert [r.fault for r in bars.collect()] == [None, None]
    with pytest.raises(Exception, match="several bars"):
        feeds.strict(bars).collect()
    write(tmp_path / "2025-03-11.csv", "ticker,open", "A,1")
    with pytest.raises(ValueError, match="lack"):
        feeds.minute_bars(spark, str(tmp_path), "rest_split_adjusted", "2025-03-11", "2025-03-11")


def test_panel_folders_are_sorted_and_replaced_by_day(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.range(100).select(F.concat(F.lit("d"), F.pmod("id", F.lit(3))).alias("day"), (100 - F.col("id")).alias("k"), F.lit(1).alias("v"))
    folders.write_panel(df, path, "day", ["k"])
    for day in ("d0", "d1", "d2"):
        ks = [r.k for r in spark.read.parquet(f"{path}/day={day}").collect()]
        assert ks == sorted(ks)
    folders.write_panel(df.where("day = 'd1'").withColumn("v", F.lit(2)), path, "day", ["k"], 4)
    assert {(r.day, r.v): r["count"] for r in spark.read.parquet(path).groupBy("day", "v").count().collect()} == {("d0", 1): 34, ("d1", 2): 33, ("d2", 1): 33}


def test_ordered_csv(spark, tmp_path):
    path = tmp_path / "tape"
    folders.write_ordered_csv(spark.range(1000).repartition(7).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("seq")), str(path), ["seq"])
    lines = [x for p in sorted(path.glob("*.csv")) for x in p.read_text().split()[1:]]
    assert lines == [str(i) for i in range(1000)]


def test_run_folder_is_fresh_and_says_how_it_ended(spark, tmp_path):
    path = tmp_path / "run"
    manifest = folders.write_run({"a": spark.range(3), "b": spark.range(0)}, str(path), {"by": "test"})
    assert json.loads((path / "manifest.json").read_text()) == manifest and manifest["status"] == "complete"
    assert [t["rows"] for t in manifest["tables"].values()] == [3, 0]
    with pytest.raises(FileExistsError):
        folders.write_run({"a": spark.range(3)}, str(path))
    with pytest.raises(Exception):
        folders.write_run({"a": spark.range(3).selectExpr("assert_true(id > 5)")}, str(tmp_path / "bad"))
    assert json.loads((tmp_path / "bad" / "manifest.json").read_text())["status"] == "failed"


def test_panels_of_a_file_a_day(spark, tmp_path):
    write(tmp_path / "panel_id_20200102.csv", "sym,x", "000001,1.5", "000002,")
    write(tmp_path / "panel_id_2020-01-03.csv", "sym,x", "000001,2.5")
    write(tmp_path / "panel_id_20200401.csv", "sym,x", "000001,7")
    write(tmp_path / "readme.csv", "sym,x", "000001,8")
    a = panels.day_files(spark, str(tmp_path), "sym string, x double, z int", "20200101", "20200131")
    assert sorted(map(tuple, a.collect()), key=str) == [("000001", 1.5, None, "20200102"), ("000001", 2.5, None, "20200103"), ("000002", None, None, "20200102")]
    write(tmp_path / "panel_id_20200104.csv", "x,sym", "2.5,000001")
    with pytest.raises(Exception, match="(?i)header"):
        panels.day_files(spark, str(tmp_path), "sym string, x double", "20200101", "20200131").collect()
    b = spark.createDataFrame([("000001", "20200102", 5, 0.0)], "sym string, day string, w int, x double")
    assert [r.asDict() for r in panels.merged([a, b], ["sym", "day"]).collect()] == [{"sym": "000001", "day": "20200102", "x": 1.5, "z": None, "w": 5}]
    assert panels.day_files(spark, str(tmp_path), "sym string", "21000101", "21000102").collect() == []
