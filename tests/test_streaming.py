from pyspark.sql import functions as F

from epochfold.streaming import windows as S

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = S.windowed(stream, "1 day", late="60 days", keys=["event_type"]).writeStream.format("memory").queryName("win").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("win").collect()}
    finally:
        q.stop()
    want = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in S.windowed(events, "1 day", keys=["event_type"]).collect()}
    assert got == want and len(got) > 10


def test_sliding_and_sessions(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 0, 1.0), ("2024-01-01 00:10:00", 0, 2.0), ("2024-01-01 02:00:00", 0, 3.0)], "t string, y int, value double").select(F.col("t").cast("timestamp").alias("ts"), "y", "value")
    assert S.windowed(df, "20 minutes", "10 minutes").where("n = 2").count() == 1
    assert sorted(r.n for r in S.label_changes(df).collect()) == [1, 2]
