from conftest import SMALL
from pyspark.sql import functions as F

from churnlens.streaming import responses


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert q.exception() is None and not q.isActive
    return spark.table(name)


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "ts", "user_id", "event_type", F.floor("value").cast("long").alias("tokens"))
    batch.write.parquet(f"{tmp_path}/in")
    stream = responses.timed(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"))
    got = {(r["start"], r["event_type"]): (r["responses"], r["tokens"]) for r in run(spark, responses.tallies(stream, "event_type", "tokens"), "tallies").collect()}
    want = {(r["start"], r["event_type"]): (r["responses"], r["tokens"]) for r in responses.tallies(batch.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "tokens").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 10


def test_first_response_only(spark, tmp_path):
    rows = spark.createDataFrame([(i % 50, i) for i in range(200)], "message long, pos long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pos")))
    rows.write.parquet(f"{tmp_path}/in")
    stream = responses.timed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    assert run(spark, responses.first_response(stream, "message"), "firsts").count() == 50
