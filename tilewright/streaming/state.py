"""Ordered state over metric series: smoothing, early stopping, best so far, moving weights, retention, resuming; and streams.

A series is (run_id, epoch, value). Folds run over one run's epochs, which are few; runs are the parallel dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from .. import schema
from ..operators.stats import partial_stats


def _run() -> Any:
    return W.partitionBy("run_id").orderBy("epoch")


def moving_average(df: DataFrame, k: int, value: str = "value") -> DataFrame:
    """smoothed: the mean of the last k values, of fewer at the start."""
    return df.withColumn("smoothed", F.avg(value).over(_run().rowsBetween(-(k - 1), 0)))


def early_stopping(df: DataFrame, patience: int, min_delta: float = 0.0, start_epoch: int = 0, k: int = 3) -> DataFrame:
    """Per epoch: smoothed, best, counter and stopped.

    A smoothed value above best + min_delta is the new best and resets the counter, others add one to it. It stops at a counter
    of patience from start_epoch on; best and counter move before that too. A missing value raises when read.
    """
    value = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.lit("the metric is missing")).cast("double"))
    s = moving_average(df.withColumn("value", value), k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a run's epochs come together and in order, as the window needs them so; one row is held, not the run
        now: Any = object()
        best, counter, stopped = None, 0, False
        for x in frames:
            out = []
            for run_id, epoch, smoothed in zip(x["run_id"], x["epoch"], x["smoothed"], strict=True):
                if run_id != now:
                    now, best, counter, stopped = run_id, None, 0, False
                best, counter = (smoothed, 0) if best is None or smoothed > best + min_delta else (best, counter + 1)
                stopped = stopped or (counter >= patience and epoch >= start_epoch)
                out.append((run_id, epoch, smoothed, best, counter, stopped))
            yield pd.DataFrame(out, columns=["run_id", "epoch", "smoothed", "best", "counter", "stopped"])

    ordered = s.select("run_id", F.col("epoch").cast("int").alias("epoch"), "smoothed").sortWithinPartitions("run_id", "epoch")
    return ordered.mapInPandas(run, f"run_id {df.schema['run_id'].dataType.simpleString()}, epoch int, smoothed double, best double, counter int, stopped boolean")


def best_so_far(df: DataFrame, value: str = "value") -> DataFrame:
    """improved: strictly above everything before."""
    before = F.max(value).over(_run().rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("best_before", before).withColumn("improved", F.col("best_before").isNull() | (F.col(value) > F.col("best_before")))


def moving_weights(df: DataFrame, decay: float, value: str = "value") -> DataFrame:
    """(run_id, ema): s = decay * s + (1 - decay) * x, from the first value on."""
    series = F.array_sort(F.collect_list(F.struct("epoch", F.col(value).alias("v"))))
    fold = lambda s: F.aggregate(s, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["v"]).otherwise(decay * a + (1 - decay) * x["v"]))
    return df.groupBy("run_id").agg(fold(series).alias("ema"))


def keep_last(df: DataFrame, n: int) -> DataFrame:
    """The n newest epochs of each run."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("epoch")))).filter(F.col("_n") <= n).drop("_n")


def resume_from(todo: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return todo.join(manifest.select(key), key, "left_anti")


# Streams: the same folds where the series arrives bit by bit.


def stop_stream(df: DataFrame, patience: int, min_delta: float = 0.0, start_epoch: int = 0, k: int = 3) -> DataFrame:
    """early_stopping over a stream of (run_id, epoch, value); the state of a run is its last k values, best and counter."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last, best, counter, stopped = state.get if state.exists else ([], None, 0, False)
        last, out = list(last), []
        for x in pd.concat(list(frames)).sort_values("epoch").itertuples():
            last = [*last, float(x.value)][-k:]
            smoothed = sum(last) / len(last)
            best, counter = (smoothed, 0) if best is None or smoothed > best + min_delta else (best, counter + 1)
            stopped = stopped or (counter >= patience and x.epoch >= start_epoch)
            out.append((key[0], int(x.epoch), smoothed, best, counter, stopped))
        state.update((last, best, counter, stopped))
        yield pd.DataFrame(out, columns=["run_id", "epoch", "smoothed", "best", "counter", "stopped"])

    return df.groupBy("run_id").applyInPandasWithState(fold, "run_id string, epoch int, smoothed double, best double, counter int, stopped boolean", "last array<double>, best double, counter int, stopped boolean", "append", "NoTimeout")


STOPPED = "run_id string, epoch int, smoothed double, best double, counter int, stopped boolean, last array<double>"


class _Stopping(StatefulProcessor):
    """early_stopping for one run; `held` is (last values, best, counter, stopped)."""

    def __init__(self, patience: int, min_delta: float, start_epoch: int, k: int, ttl_ms: int | None):
        self.rule, self.ttl_ms = (patience, min_delta, start_epoch, k), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "last array<double>, best double, counter int, stopped boolean", self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        x = initialState.iloc[0]
        self.held.update(([float(v) for v in x["last"]], float(x["best"]), int(x["counter"]), bool(x["stopped"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        patience, min_delta, start_epoch, k = self.rule
        last, best, counter, stopped = self.held.get() if self.held.exists() else ([], None, 0, False)
        out = []
        for x in pd.concat(list(rows)).sort_values("epoch").itertuples():
            last = [*last, float(x.value)][-k:]
            smoothed = sum(last) / len(last)
            best, counter = (smoothed, 0) if best is None or smoothed > best + min_delta else (best, counter + 1)
            stopped = bool(stopped or (counter >= patience and x.epoch >= start_epoch))
            out.append((key[0], int(x.epoch), smoothed, best, counter, stopped, last))
        self.held.update((list(last), float(best), int(counter), stopped))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STOPPED.split(", ")])

    def close(self) -> None:
        pass


def resumable_stops(df: DataFrame, patience: int, min_delta: float = 0.0, start_epoch: int = 0, k: int = 3, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """STOPPED: early_stopping over a stream of (run_id, epoch, value) that goes on from `initial`, as saved_state() gives it. With ttl_ms the state of
    a run that is silent for so long goes. The session has to use the state store of RocksDB.

    Without a time to live the same epochs in the same batches give the same rows, whether the stream ran through or was stopped and given its state back."""
    extra = {} if initial is None else {"initialState": initial.groupBy("run_id")}
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return df.groupBy("run_id").transformWithStateInPandas(_Stopping(patience, min_delta, start_epoch, k, ttl_ms), STOPPED, "Append", mode, **extra)


def saved_state(rows: DataFrame) -> DataFrame:
    """(run_id, last, best, counter, stopped): what a stream held after its last epoch of each run, from the rows that it wrote."""
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct("last", "best", "counter", "stopped"), "epoch").alias("s"))
    return newest.select("run_id", "s.*")


def stats_sink(path: str, channels: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the partial statistics of each batch, under its number, so that a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        partial_stats(batch, channels).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def first_seen(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Rows of a stream whose key wasn't seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_stats(df: DataFrame, ts: str, width: str, late: str, *by: str, value: str = "value") -> DataFrame:
    """Counts and means by event-time window, for batches and streams."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *by, "n", "mean")


# --- queries -------------------------------------------------------------------------------------------------------


def _series(s: SparkSession, d: str) -> DataFrame:
    """Daily means of each event type as runs, one epoch for each day."""
    e = schema.table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("value"))


R = lambda c: F.round(c, 6)
QUERIES = {
    "w01_moving_average": lambda s, d: moving_average(_series(s, d), 3).select("run_id", "epoch", F.round("smoothed", 5).alias("smoothed")),
    "w09_keep_last": lambda s, d: keep_last(_series(s, d), 4),
    "t01_early_stopping": lambda s, d: early_stopping(_series(s, d), 5, 0.5, 8).select("run_id", "epoch", F.round("smoothed", 5).alias("smoothed"), F.round("best", 5).alias("best"), "counter", "stopped"),
    "t02_best_so_far": lambda s, d: best_so_far(_series(s, d)).select("run_id", "epoch", "improved"),
    "t03_moving_weights": lambda s, d: moving_weights(_series(s, d), 0.9).select("run_id", R("ema").alias("ema")),
    "t06_seen_set": lambda s, d: schema.table(s, d, "events").dropDuplicates(["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("n")),
    "t07_manifest_resume": lambda s, d: resume_from(schema.table(s, d, "orders").select("o_orderkey"), schema.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"),
    "t08_exposure_counter": lambda s, d: schema.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("exposures")),
    "stream_windowed_stats": lambda s, d: windowed_stats(schema.table(s, d, "events"), "ts", "6 hours", "1 hour", "event_type").select("start", "event_type", "n", R("mean").alias("mean")),
}
S = "s AS (SELECT event_type AS run_id, day(ts)::INT AS epoch, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), m AS (SELECT *, avg(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS 2 PRECEDING) AS smoothed, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM s)"
SQL = {
    "w01_moving_average": f"WITH {S} SELECT run_id, epoch, round(smoothed, 5) AS smoothed FROM m",
    "w09_keep_last": f"WITH {S} SELECT run_id, epoch, value FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 4",
    "t01_early_stopping": f"""WITH RECURSIVE {S}, f AS (SELECT run_id, epoch, i, smoothed, smoothed AS best, 0 AS counter, false AS stopped FROM m WHERE i = 1
      UNION ALL SELECT m.run_id, m.epoch, m.i, m.smoothed, CASE WHEN m.smoothed > f.best + 0.5 THEN m.smoothed ELSE f.best END, CASE WHEN m.smoothed > f.best + 0.5 THEN 0 ELSE f.counter + 1 END, f.stopped OR (m.smoothed <= f.best + 0.5 AND f.counter + 1 >= 5 AND m.epoch >= 8) FROM f JOIN m ON m.run_id = f.run_id AND m.i = f.i + 1)
      SELECT run_id, epoch, round(smoothed, 5) AS smoothed, round(best, 5) AS best, counter::INT AS counter, stopped FROM f""",
    "t02_best_so_far": f"WITH {S} SELECT run_id, epoch, coalesce(value > max(value) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM s",
    "t03_moving_weights": f"WITH RECURSIVE {S}, f AS (SELECT run_id, i, value AS ema FROM m WHERE i = 1 UNION ALL SELECT m.run_id, m.i, 0.9 * f.ema + 0.1 * m.value FROM f JOIN m ON m.run_id = f.run_id AND m.i = f.i + 1) SELECT run_id, round(arg_max(ema, i), 6) AS ema FROM f GROUP BY 1",
    "t06_seen_set": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1",
    "t07_manifest_resume": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "t08_exposure_counter": "SELECT user_id, count(*) AS exposures FROM events GROUP BY 1",
    "stream_windowed_stats": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
}
