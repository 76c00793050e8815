from banyan.streaming.incremental import append_stream, unseen_in_time


def test_append_twice_adds_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int").write.parquet(src)
    for run in ("one", "two"):  # a second stream over the same rows finds nothing new
        s = spark.readStream.schema("k string, v int").parquet(src)
        append_stream(s, str(tmp_path / "out"), ["k", "v"], str(tmp_path / run)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_dedup_in_time(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2025-01-01 00:00:00' ts, 'a' k union all select timestamp'2025-01-01 00:01:00', 'a'").write.parquet(src)
    s = unseen_in_time(spark.readStream.schema("ts timestamp, k string").parquet(src), ["k"], "ts", "1 hour")
    s.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("seen").count() == 1
