from tapeline.streaming import bars

SCHEMA = "symbol string, trade_date string, seqno long, actiontype int, hms string, timeseconds double, volume long"


def rows():
    out = [("a", "20200102", i, 2, None, 36000.0 + i, 100) for i in range(130)]
    out += [("a", "20200102", 5, 2, "10:00:05.000", None, 100), ("a", "20200102", 500, 0, None, 36000.0, 900), ("a", "20200102", 501, 2, None, None, 7)]
    return out + [("z", "20200103", 1, 2, None, 36000.0, 1), ("z", "20200104", 2, 2, None, 36000.0, 1)]


def of_a(df):
    return [(r.n, r.volume) for r in df.where("symbol = 'a'").orderBy("minute").collect()]


def test_stream_and_table_give_the_same_bars(spark, tmp_path):
    path = str(tmp_path / "feed")
    df = spark.createDataFrame(rows(), SCHEMA).repartition(1)
    df.write.parquet(path)
    streamed, late = bars.run_to_end(spark, path, df.schema, "1 hour")
    assert of_a(streamed) == of_a(bars.minute_bars(df, "1 hour")) == [(60, 6000), (60, 6000), (10, 1000)]
    assert late == 0


def test_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "feed")
    df = spark.createDataFrame(rows(), SCHEMA).repartition(1)
    df.write.parquet(path)
    after = [("a", "20200102", 900 + i, 2, None, 36000.0 + i, 100) for i in range(7)]  # two days behind when they come
    # rows are late against the watermark of the batch before the last
    for more in ([("z", "20200104", 3, 2, None, 36060.0, 1)], after, [("z", "20200105", 4, 2, None, 36000.0, 1)]):
        spark.createDataFrame(more, SCHEMA).repartition(1).write.mode("append").parquet(path)
    streamed, late = bars.run_to_end(spark, path, df.schema, "1 hour", files=1)
    assert late == 7 and of_a(streamed) == [(60, 6000), (60, 6000), (10, 1000)]
