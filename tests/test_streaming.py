from pyspark.sql import functions as F

from parlance.streaming.rules import decided, decision_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:30:00", ["you idiot", "the cat", "licensed work", ""][i % 4]) for i in range(40)]
    batch = spark.createDataFrame(rows, "id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    counts = decision_counts(decided(stream), "ts")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("decisions").start()
    q.processAllAvailable()
    q.stop()
    want = decided(batch).groupBy(F.date_trunc("hour", "ts").alias("start"), "decision").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("decisions").collect())) == sorted(map(tuple, want.collect()))
