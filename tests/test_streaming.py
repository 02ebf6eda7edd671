"""Streams give what the same functions, or plain code, give on batches."""

from strandlake.streaming import anomalies, windowed_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(spark, df, name, tmp_path, mode="append"):
    stream = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    return spark.table(name).collect()


def read(spark):
    return spark.readStream.schema(spark.read.parquet(EVENTS).schema).option("pathGlobFilter", "events.parquet").parquet(EVENTS.rsplit("/", 1)[0]).withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))


def test_windowed_counts(spark, tmp_path):
    batch = windowed_counts(spark.read.parquet(EVENTS).selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type", "value")).collect()
    got = drained(spark, windowed_counts(read(spark)), "counts", tmp_path, "complete")
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, got)) == sorted(map(key, batch))


def test_anomalies(spark, tmp_path):
    got = {(r["user_id"], r["event_id"]) for r in drained(spark, anomalies(read(spark), least=10, limit=2.0), "odd", tmp_path)}
    want, state = set(), {}
    for r in sorted(spark.read.parquet(EVENTS).collect(), key=lambda r: r["event_id"]):
        before = state.setdefault(r["user_id"], [])
        if len(before) >= 10:
            mean = sum(before) / len(before)
            sd = (sum((x - mean) ** 2 for x in before) / len(before)) ** 0.5
            if sd > 0 and abs(r["value"] - mean) / sd > 2.0:
                want.add((r["user_id"], r["event_id"]))
        before.append(r["value"])
    assert got == want and got
