"""Streams over files against the same rows as a batch."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tilewright.operators import stats
from tilewright.streaming import state


def files_of(df, path, parts):
    for i, where in enumerate(parts):
        df.filter(where).coalesce(1).write.parquet(f"{path}/part{i}")


def test_partial_statistics_of_batches_merge_to_those_of_all(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.gauss(5, 2), rng.random() if i % 7 else None) for i in range(300)], "i int, a double, b double")
    files_of(df, tmp_path / "in", ["i < 100", "i between 100 and 149", "i >= 150"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sink = state.stats_sink(f"{tmp_path}/out", ["a", "b"])
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    sink(df.filter("i < 100").limit(0), 7)
    sink(df.filter("false"), 7)  # written again: it replaces itself
    got = {r.channel: r for r in stats.merge_stats(spark.read.parquet(f"{tmp_path}/out").drop("batch")).collect()}
    for c in ("a", "b"):
        want = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).first()
        assert got[c].n == want.n and math.isclose(got[c].mean, want.mean) and math.isclose(got[c]["std"], want["std"])


def test_first_seen_within_the_watermark(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:01:00", 2), ("a", "2024-01-01 00:02:00", 3), ("c", "2024-01-01 00:03:00", 4), ("b", "2024-01-01 00:04:00", 5)]
    df = spark.createDataFrame(rows, "k string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    files_of(df, tmp_path / "in", ["n <= 2", "n > 2"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = state.first_seen(stream, "k", "ts", "1 hour").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select k, n from seen").collect()
    assert len(got) == 3 and {r.k for r in got} == {"a", "b", "c"}


def test_windows_of_a_stream_and_of_a_batch(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"2024-01-01 {h:02d}:{m:02d}:00", "xy"[m % 2], rng.random()) for h in range(4) for m in range(0, 60, 7)], "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = state.windowed_stats(stream, "ts", "30 minutes", "1 hour", "k").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r.start, r.k, r.n, round(r["mean"], 12)) for r in d.collect())
    assert key(spark.sql("select * from windows")) == key(state.windowed_stats(df, "ts", "30 minutes", "1 hour", "k"))
