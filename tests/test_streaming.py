import datetime as dt

from barloom.streaming.state import live_series


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, dt.date(2021, 1, i + 1), x) for i, x in enumerate([1.0, -2.0, None, 3.0, 4.0])]
    src = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "symbol long, d date, x double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("symbol long, d date, x double").option("maxFilesPerTrigger", 1).parquet(src)
    q = live_series(stream, "x", 3).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.ema, r.run_length) for r in spark.sql("select * from live order by d").collect()]
    want, y, gap, run = [], None, 0, 0
    for _, _, x in rows:
        if x is None:
            gap, run = gap + 1, 0
        else:
            old = 0.5 ** (gap + 1)
            y, gap, run = (x if y is None else (old * y + 0.5 * x) / (old + 0.5)), 0, run + 1 if x > 0 else 0
        want.append((y, run))
    assert [(round(a, 9), b) for a, b in got] == [(round(a, 9), b) for a, b in want]
