"""The row-wise operators on a stream."""

from pyspark.sql import functions as F

from listingloom.streaming import quality


def test_quality_and_dedupe_on_a_stream(spark, tmp_path):
    rows = [("1", "Core i7 Ryzen 5", "x", "d"), ("2", "plain x", "x", "d")]
    spark.createDataFrame(rows, "id string, title string, brand string, description string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, title string, brand string, description string").parquet(str(tmp_path / "in"))
    q = quality.report_stream(stream).writeStream.format("memory").queryName("quality_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["max_severity"] for r in spark.table("quality_out").collect()} == {"1": "high", "2": "none"}
    pairs = spark.createDataFrame([("a", "b", 0), ("B", "a", 1), ("c", "c", 2)], "x string, y string, n int").withColumn("ts", F.timestamp_seconds("n"))
    pairs.write.parquet(str(tmp_path / "pairs"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "pairs"))
    q = quality.dedupe_stream(stream, "x", "y", "ts").writeStream.format("memory").queryName("dedupe_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dedupe_out").count() == 1


def test_first_by_order_corrects_earlier_winners(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [
        [("x", "y", 5, at(0)), ("p", "q", 1, at(0)), ("same", "SAME ", 0, at(0))],
        [("Y", "x", 3, at(1)), ("q", "p", 2, at(1)), ("r", "s", None, at(1))],
        [("x", "Y ", 4, at(2)), ("y", "x", 1, at(2)), ("r", "s", 9, at(2)), ("s", "r", 8, at(2))],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "a string, b string, n int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    schema = "a string, b string, n int, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    changes = quality.first_by_order(stream, "a", "b", ["n"], "ts", "1 hour")
    run = changes.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    kept = quality.latest(out)
    assert kept.columns == ["a", "b", "n", "ts"]
    assert sorted((r.a, r.b, r.n) for r in kept.collect()) == [("p", "q", 1), ("s", "r", 8), ("y", "x", 1)]
    assert out.where("_a = 'x'").agg(F.max("version")).first()[0] >= 2  # corrected on the way, whatever file came first


def test_keys_of_a_bucket_share_a_call(spark, tmp_path):
    # 6,000 keys twice: a call for each took more than a minute of pandas
    path, calls = str(tmp_path / "in"), 7
    rows = spark.range(12_000).select(F.concat(F.lit("k"), (F.col("id") % 6000).cast("string")).alias("a"), F.lit("x").alias("b"), (-F.col("id")).alias("n"))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    for part in (rows.where("n > -6000"), rows.where("n <= -6000")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    changes = quality.first_by_order(stream, "a", "b", ["n"], "ts", buckets=calls)
    run = changes.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    kept = quality.latest(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted(r.n for r in kept) == list(range(-11_999, -5_999))
    states = [s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]]
    assert states and max(states) <= calls


def test_forgotten_keys_leave_their_bucket(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [[("x", "y", 5, 0)], [("p", "q", 7, 4 * 3600)], [("u", "v", 1, 4 * 3600 + 1)], [("x", "y", 9, 4 * 3600 + 2), ("p", "q", 8, 4 * 3600 + 2)]]
    schema = "a string, b string, n int, ts timestamp"
    out, state = str(tmp_path / "out"), str(tmp_path / "c")
    for rows in batches:
        made = spark.createDataFrame(rows, "a string, b string, n int, s long").select("a", "b", "n", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
        made.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        changes = quality.first_by_order(stream, "a", "b", ["n"], "ts", buckets=1)
        changes.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    # x, y was forgotten and begins anew; p, q is known and its later row is none
    assert sorted((r.a, r.n, r.version) for r in spark.read.parquet(out).collect()) == [("p", 7, 1), ("u", 1, 1), ("x", 5, 1), ("x", 9, 1)]
