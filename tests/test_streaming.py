from pyspark.sql import functions as F

from tracelore.operators import model
from tracelore.streaming import model as streaming


def test_state_agrees_with_the_batch_window(spark, tmp_path):
    rows = [(s, f"f{s % 3}") for s in range(1, 80)] + [(s, "all") for s in range(1, 80)]
    source = str(tmp_path / "in")
    for low in (0, 30, 60):
        part = [r for r in rows if low <= r[0] < low + 30]
        spark.createDataFrame(part, "seq long, feature string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("seq long, feature string").option("maxFilesPerTrigger", 1).parquet(source)
    out = streaming.sliding_frequency(stream, width=10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("seq", "feature", "df").collect()))
    want = model.sliding_frequency(spark.createDataFrame(rows, "seq long, feature string"), width=10)
    assert got == sorted(map(tuple, want.select("seq", "feature", "df").collect()))


def test_appending_and_learning(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).withColumn("action", F.lit("a")).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, action string").parquet(source)
    streaming.appending(stream(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    seen = []
    streaming.learning(stream(), lambda batch: seen.append(batch.count()), str(tmp_path / "c2")).awaitTermination(60)
    assert sum(seen) == 10
