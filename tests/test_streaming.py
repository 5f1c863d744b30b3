import os

from pyspark.sql import functions as F

from tidepool.streaming import replay


def test_stream_ends_at_the_batch_counts(spark, tmp_path):
    e = spark.range(2000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"), (F.col("id") % 3).cast("string").alias("code"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = replay.stream_of(spark, str(tmp_path / "in"), "ts timestamp, code string", files_per_trigger=10)
    replay.run_to_end(replay.windowed_counts(stream, "ts", "code", late="10 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.start, r.code): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.code): r.n for r in e.groupBy(F.window("ts", "1 day").alias("w"), "code").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "code", "n").collect()}
    assert got and all(want[k] == n for k, n in got.items())  # windows that the watermark has not passed are still open
    assert os.path.isdir(tmp_path / "ck")
