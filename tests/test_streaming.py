import random

from pyspark.sql import functions as F

from attestra.streaming import state


def run(stream, place, **options):
    """A stream run to its end, one batch a file; its rows as a table."""
    rows = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").options(**options).trigger(availableNow=True).start()
    rows.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def files(spark, place, rows, schema, n=3):
    """Rows in the order of their time, dealt to n files that are read one after another."""
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(spark.read.parquet(f"{place}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")


def test_streamed_admission_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((i, rng.randrange(3), f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}") for i in range(240)), key=lambda r: (r[2], r[0]))
    stream = files(spark, tmp_path, rows, "id long, ip long, at string")
    got = run(state.admit_stream(stream.withWatermark("at", "0 seconds"), key="ip", time="at", row="id", most=3, window_s=60.0), tmp_path)
    whole = state.admit(spark.read.parquet(f"{tmp_path}/in"), key="ip", time="at", row="id", most=3, window_s=60.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_streamed_deduplication(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:00:30"), (3, 8, "2024-01-01 00:01:00"), (4, 7, "2024-01-01 00:01:10"), (5, 8, "2024-01-01 00:01:20"), (6, 9, "2024-01-01 00:02:00")]
    got = run(state.deduplicate_within(files(spark, tmp_path, rows, "id long, ip long, at string", 1), ["ip"], "at", "10 minutes"), tmp_path)
    assert sorted(r.ip for r in got.collect()) == [7, 8, 9]


def test_growing_index(spark, tmp_path):
    rows = [(i, i % 4, f"h{i % 6}", "2024-01-01 00:00:00") for i in range(30)]
    stream = files(spark, tmp_path, rows, "ord long, product_id long, image_hash string, at string")
    query = stream.writeStream.foreachBatch(lambda b, n: state.append_absent(b, f"{tmp_path}/index", ["product_id", "image_hash"], ["ord"])).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/index").select("product_id", "image_hash").collect()
    assert sorted(map(tuple, got)) == sorted({(r[1], r[2]) for r in rows})


def test_streamed_ttl_equals_the_lookup_and_lets_go(spark, tmp_path):
    from attestra.operators import relational

    rng = random.Random(7)
    days = sorted(rng.randrange(0, 60 * 24) for _ in range(300))  # hours
    rows = [(i, rng.randrange(8), rng.random() < 0.5, h) for i, h in enumerate(days)]
    schema = "id long, k long, asks boolean, h long"
    for i in range(4):
        part = spark.createDataFrame(rows[i * 75 : i * 75 + 75], schema).selectExpr("id", "k", "asks", "timestamp_seconds(1700000000 + h * 3600) AS at")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = spark.read.parquet(f"{tmp_path}/in")
    want = relational.ttl_lookup(whole.where("asks"), whole.where("NOT asks"), key="k", time="at", row="id", days=7)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.ROCKS)
    try:
        out = state.ttl_stream(stream, key="k", time="at", row="id", asks=F.col("asks"), days=7)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/rows")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
