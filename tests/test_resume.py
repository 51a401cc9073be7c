"""Early stopping over streams that are stopped and go on from a saved state, and over long runs."""

from __future__ import annotations

import pytest

from tilewright.streaming import state

SERIES = "run_id string, epoch int, value double"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, old)


def through(spark, tmp_path, name, batches, **more):
    """The rows of a stream that reads the batches one by one."""
    src = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema(SERIES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(src))
    q = state.resumable_stops(stream, 3, 0.1, 4, 2, **more).writeStream.format("parquet").option("path", f"{src}-out").option("checkpointLocation", f"{src}-at").start()
    q.processAllAvailable()
    q.stop()
    assert q.exception() is None
    return spark.read.parquet(f"{src}-out")


def key(df):
    return sorted((r.run_id, r.epoch, round(r.smoothed, 9), round(r.best, 9), r.counter, r.stopped) for r in df.collect())


def test_a_stopped_stream_goes_on_as_one_that_ran_through(spark, rocks, tmp_path):
    values = [0.1, 0.5, 0.55, 0.5, 0.9, 0.9, 0.95, 0.9, 0.8, 0.9, 1.2]
    series = [[(r, e, v * k) for k, r in ((1, "a"), (2, "b"))] for e, v in enumerate(values)]
    whole = key(through(spark, tmp_path, "whole", series))
    first = through(spark, tmp_path, "first", series[:6])
    saved = state.saved_state(first)
    assert {r.run_id for r in saved.collect()} == {"a", "b"}
    rest = through(spark, tmp_path, "rest", series[6:], initial=saved)
    assert sorted(key(first) + key(rest)) == whole
    batch = spark.createDataFrame([x for b in series for x in b], SERIES)
    assert key(state.early_stopping(batch, 3, 0.1, 4, 2)) == whole
    alone = through(spark, tmp_path, "alone", series[6:8])
    assert key(alone) != [x for x in whole if x[1] in (6, 7)]  # without its state it starts anew


def test_a_time_to_live_is_taken(spark, rocks, tmp_path):
    assert through(spark, tmp_path, "ttl", [[("a", 1, 0.5)], [("a", 2, 0.7)]], ttl_ms=3_600_000).count() == 2


def test_a_long_run_is_folded_in_one_pass(spark):
    n = 60_000
    df = spark.range(n).selectExpr("'long' AS run_id", "CAST(id AS INT) AS epoch", "CAST(id % 1000 AS DOUBLE) AS value")
    out = state.early_stopping(df, 5, 0.0, 0, 1)
    assert out.count() == n and out.filter("best = 999.0").count() == n - 999 and out.agg({"counter": "max"}).first()[0] == n - 1000
    with pytest.raises(Exception, match="metric is missing"):
        state.early_stopping(spark.createDataFrame([("a", 1, None)], SERIES), 2).collect()
    assert not state.early_stopping(df.limit(0), 2).count()
