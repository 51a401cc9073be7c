"""Hand-computed values and edge cases of single operators."""

from __future__ import annotations

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import schema
from tilewright.functions import scalar
from tilewright.operators import catalog, metrics, raster, sampling, stats, vectors
from tilewright.plans import decisions
from tilewright.streaming import state


@pytest.fixture(scope="module")
def tiles(spark):
    """Four regions of three tiles, two positive and one negative each."""
    rows = [(f"{r}{t:03d}", 65.0 + r, -150.0 + t, "Positive" if t < 2 else "Negative", "ABCD"[r], f"uid_{r}{t:03d}" if t < 2 else "") for r in range(4) for t in range(3)]
    return spark.createDataFrame(rows, "Tile_id string, centroid_lat double, centroid_lon double, TrainClass string, RegionName string, UIDs string")


SPLITS = {"train": ["A", "B"], "val_balanced": ["C"], "val_realistic": ["C"], "test_realistic": ["D"]}


def test_catalog_spellings_and_members(spark, tiles):
    c = schema.canonical(tiles)
    assert c.columns == [f.name for f in schema.CATALOG]
    lower = schema.canonical(tiles.withColumn("TrainClass", F.lower("TrainClass")).withColumnRenamed("Tile_id", "Tile_ID"))
    assert sorted(lower.collect()) == sorted(c.collect())
    s = schema.split_map(spark, SPLITS)
    ids = [r.tile_id for r in catalog.tiles_of(c, s, "train").collect()]
    assert len(ids) == 6 and ids == sorted(ids)
    assert catalog.tiles_of(c, s, "train", "Positive").count() == 4
    with pytest.raises(ValueError):
        catalog.tiles_of(c, s, "nowhere")
    with pytest.raises(ValueError):
        schema.canonical(tiles.drop("UIDs"))


def test_leakage_and_summary(spark, tiles):
    s = schema.split_map(spark, SPLITS)
    assert [r.region for r in catalog.leakage(s, {}).collect()] == ["C"]
    assert catalog.leakage(s).count() == 0
    out = {r.split: (r.total, r.positive, r.negative) for r in catalog.split_summary(schema.canonical(tiles), schema.split_map(spark, SPLITS | {"test_realistic": ["Z"]})).collect()}
    assert out["train"] == (6, 4, 2) and out["test_realistic"] == (0, 0, 0)


def test_split_map_errors():
    assert catalog.split_errors(SPLITS) == []
    assert catalog.split_errors({"train": "A"}) and catalog.split_errors(None)
    assert catalog.compare_columns(["b", "a", "x"], ["a", "b", "c"]) == {"missing": ["c"], "unexpected": ["x"], "ordered": False}


def test_geohash_and_uuid(spark):
    r = spark.range(1).select(scalar.geohash(F.lit(39.47), F.lit(-105.21)).alias("g"), scalar.uuid5(F.lit("tile")).alias("u")).first()
    assert r.g == "9xj0tck3mm3c" and r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "tile"))


@pytest.mark.parametrize("bs,ratio,pos,neg,expected", [(8, 1, 32, 32, (4, 4)), (12, 5, 32, 200, (2, 10))])
def test_balanced_batches(spark, bs, ratio, pos, neg, expected):
    df = spark.createDataFrame([(f"p{i:04d}", "Positive") for i in range(pos)] + [(f"n{i:04d}", "Negative") for i in range(neg)], "tile_id string, train_class string")
    gate = sampling.batch_gate(sampling.balanced_batches(df, bs, ratio), *expected).collect()
    assert gate and all(r.ok for r in gate)
    again = sampling.balanced_batches(df.repartition(3), bs, ratio)
    assert sorted(again.collect()) == sorted(sampling.balanced_batches(df, bs, ratio).collect())
    with pytest.raises(ValueError):
        sampling.balanced_batches(df.filter("train_class = 'Positive'"), bs, ratio)


def test_positive_subset(spark):
    df = spark.createDataFrame([(i, "Positive" if i < 20 else "Negative") for i in range(100)], "tile_id int, train_class string")
    out = sampling.positive_subset(df, "tile_id", "train_class", 25)
    assert out.filter("train_class = 'Positive'").count() == 5 and out.count() == 85


def test_curriculum():
    s = sampling.parse_schedule({"11-30": 5, "1-10": 1, "31-50": 10})
    assert s == [(1, 10, 1), (11, 30, 5), (31, 50, 10)]


def test_welford_matches_numpy(spark):
    x = np.random.default_rng(0).standard_normal(4000) * 37 + 10
    df = spark.createDataFrame([(i % 8, float(v)) for i, v in enumerate(x)], "part int, v double")
    r = stats.merge_stats(stats.partial_stats(df, ["v"], "part").drop("part")).first()
    assert math.isclose(r.mean, x.mean(), rel_tol=1e-9) and math.isclose(r.std, x.std(), rel_tol=1e-9)
    one = stats.channel_stats(spark.createDataFrame([(3.0, float("nan"))], "a double, b double"), ["a", "b"]).collect()
    assert [(r.n, r.mean, r.std) for r in one] == [(1, 3.0, 0.0), (0, 0.0, 0.0)]


def test_constant_channel_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(5)], "a double, b double")
    assert stats.pearson_matrix(df, ["a", "b"]).first().r is None


def test_running_matches_cumsum(spark):
    df = spark.createDataFrame([(float(i * 7 % 101), i % 5) for i in range(101)], "k double, n int")
    got = {r.k: r.t for r in stats.running(df, "k", {"t": "n"}, part_rows=7).collect()}
    total = 0
    for r in sorted(df.collect()):
        total += r.n
        assert got[r.k] == total


def px(spark, grid):
    rows = [(t, r, c, float(s), int(y)) for t, (score, label) in grid.items() for r in range(score.shape[0]) for c, (s, y) in enumerate(zip(score[r], label[r], strict=True))]
    return spark.createDataFrame(rows, "tile_id string, row int, col int, score double, label int")


def test_perfect_and_ignored(spark):
    block = np.zeros((16, 16))
    block[4:12, 4:12] = 1
    r = metrics.pixel_counts(px(spark, {"t": (block, block)}), 0.5).first()
    assert r.iou == r.f1 == 1.0
    o = raster.object_counts(px(spark, {"t": (block, block)})).first()
    assert (o.tp, o.fp, o.fn) == (1, 0, 0)
    half = block.copy()
    junk = block.copy()
    half[:, 8:], junk[:, 8:] = 255, 1
    assert metrics.pixel_counts(px(spark, {"t": (junk, half)}), 0.5).first().iou == 1.0
    speck = np.zeros((16, 16))
    speck[7, 7] = 1
    o = raster.object_counts(px(spark, {"t": (speck, np.zeros((16, 16)))})).first()
    assert o.fp == 0


def test_average_precision_against_loop(spark):
    rng = random.Random(3)
    data = [(rng.randrange(20) / 20, int(rng.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(data, "score double, label int")
    p = sum(y for _, y in data)
    ap, before = 0.0, 0
    for s in sorted({s for s, _ in data}, reverse=True):
        tp, n = sum(y for t, y in data if t >= s), sum(t >= s for t, _ in data)
        ap, before = ap + (tp - before) / p * tp / n, tp
    assert math.isclose(metrics.average_precision(metrics.by_score(df)).first().ap, ap, rel_tol=1e-9)
    none = spark.createDataFrame([(0.5, 0)], "score double, label int")
    assert metrics.average_precision(metrics.by_score(none)).first().ap == 0.0


def test_losses(spark):
    df = spark.createDataFrame([("t", 0.0, 1), ("t", 5.0, 255)], "tile_id string, logit double, label int")
    assert math.isclose(metrics.focal_loss(df).first().focal, 0.0625 * math.log(2), rel_tol=1e-9)
    sure = spark.createDataFrame([("t", 30.0, 1)], "tile_id string, logit double, label int")
    assert metrics.focal_loss(sure).first().focal < 1e-10
    many = spark.createDataFrame([(f"t{i % 3}", (i % 11 - 5) / 2, i % 2) for i in range(60)], "tile_id string, logit double, label int")
    assert math.isclose(metrics.tversky_loss(many, 0.5, 0.5, 1.0).first().tversky, metrics.dice_loss(many, 2.0).first().dice, rel_tol=1e-12)
    with pytest.raises(ValueError):
        metrics.build_loss("none")


def test_components_and_matching():
    m = np.zeros((10, 10))
    m[1:4, 1:4] = 1
    m[8, 8] = 1
    assert raster.components(m > 0).max() == 2 and raster.drop_small(m > 0, 4).sum() == 9
    snake = np.array([[1, 1, 1, 1], [0, 0, 0, 1], [1, 1, 1, 1], [1, 0, 0, 0], [1, 1, 1, 1]])
    assert raster.components(snake > 0).max() == 1
    diagonal = np.eye(3)
    assert raster.components(diagonal > 0).max() == 3 and raster.components(diagonal > 0, True).max() == 1
    a = np.zeros((5, 5), int)
    a[0, :4] = 1
    b = a.copy()
    b[2, 0] = 2
    assert raster.match_objects(b, a, np.array([0.9, 0.7])) == (1, 1, 0)
    z = np.zeros((5, 5), int)
    assert raster.match_objects(z, b, np.array([])) == (0, 0, 2) and raster.match_objects(z, z, np.array([])) == (0, 0, 0)


def test_components_against_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(20):
        m = rng.random((9, 13)) < 0.55
        got, seen = raster.components(m), {}
        for r, c in np.argwhere(m):
            stack, own = [(r, c)], got[r, c]
            if own in seen:
                continue
            seen[own] = set()
            while stack:
                y, x = stack.pop()
                if (y, x) in seen[own] or not (0 <= y < 9 and 0 <= x < 13) or not m[y, x]:
                    continue
                seen[own].add((y, x))
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert all(set(map(tuple, np.argwhere(got == k))) == v for k, v in seen.items())


def test_boundary_ignore():
    a = np.zeros((32, 32), int)
    a[10:20, 10:20] = 1
    out = raster.boundary_ignore(a, 2)
    assert (out == 255).any() and (out[14:16, 14:16] == 1).all()
    assert (raster.boundary_ignore(a, 0) == a).all()


def test_symmetries_undo_and_compat():
    a = np.arange(12.0).reshape(3, 4)
    for k, f in raster.FLIPS.items():
        assert (raster.FLIPS[raster.INVERSE[k]](f(a)) == a).all()
    predict = lambda x: x * (np.arange(x.shape[1]) + 1)
    assert np.allclose(raster.augmented_mean(predict, a, "full_compat"), raster.augmented_mean(predict, a, "standard"))


def series(spark, values, run="r"):
    return spark.createDataFrame([(run, i + 1, float(v)) for i, v in enumerate(values)], "run_id string, epoch int, value double")


@pytest.mark.parametrize("values,args,counters,stopped", [
    ([0.1, 0.2, 0.3, 0.4], dict(patience=3, k=3), [0, 0, 0, 0], False),
    ([0.5] * 5, dict(patience=2, start_epoch=1, k=1), [0, 1, 2, 3, 4], True),
    ([0.5, 0.505, 0.6], dict(patience=9, min_delta=0.01, k=1), [0, 1, 0], False),
])
def test_early_stopping(spark, values, args, counters, stopped):
    rows = state.early_stopping(series(spark, values), **args).orderBy("epoch").collect()
    assert [r.counter for r in rows] == counters and rows[-1].stopped == stopped


def test_stopping_waits_for_its_start(spark):
    rows = state.early_stopping(series(spark, [0.9, 0, 0, 0, 0]), patience=1, start_epoch=5, k=1).orderBy("epoch").collect()
    assert [r.stopped for r in rows] == [False] * 4 + [True]


def test_stop_stream_agrees_with_batch(spark, tmp_path):
    values = [0.1, 0.4, 0.3, 0.3, 0.2, 0.9]
    s = series(spark, values)
    for i in range(3):
        s.filter(f"epoch > {2 * i} and epoch <= {2 * i + 2}").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema(s.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = state.stop_stream(stream, patience=2, k=2).writeStream.outputMode("append").format("memory").queryName("stops").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.epoch: (round(r.best, 9), r.counter, r.stopped) for r in spark.sql("select * from stops").collect()}
    want = {r.epoch: (round(r.best, 9), r.counter, r.stopped) for r in state.early_stopping(s, patience=2, k=2).collect()}
    assert got == want


def test_best_weights_retention(spark):
    assert [r.improved for r in state.best_so_far(series(spark, [0.1, 0.2, 0.15])).orderBy("epoch").collect()] == [True, True, False]
    assert math.isclose(state.moving_weights(series(spark, [0.0] + [1.0] * 20), 0.5).first().ema, 1.0, abs_tol=1e-5)
    assert sorted(r.epoch for r in state.keep_last(series(spark, [1, 2, 3, 4]), 2).collect()) == [3, 4]


def test_schedules(spark):
    lr = {(r.epoch, r.grp): r.lr for r in decisions.learning_rates(spark.range(1, 51).select(F.col("id").cast("int").alias("epoch")), 50).collect()}
    near = lambda a, b: math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-15)
    assert all(near(lr[e, g], 1e-3) for e in (1, 5, 10) for g in ("backbone", "decoder"))
    assert near(lr[11, "decoder"], 1e-6) and near(lr[15, "decoder"], 1e-4) and near(lr[50, "decoder"], 1e-6)
    assert near(lr[11, "backbone"], 0) and near(lr[13, "backbone"], 1e-5) and near(lr[14, "backbone"], 1e-5)
    assert lr[33, "decoder"] < (1e-4 + 1e-6) / 2 < lr[32, "decoder"]
    steps = {r.step: r.lr for r in decisions.lr_range(spark.range(101).withColumnRenamed("id", "step"), 101).collect()}
    assert math.isclose(steps[0], 1e-7) and math.isclose(steps[100], 0.1) and math.isclose(steps[50], 1e-4)


def test_configurations():
    assert decisions.bias_prior(0.5) == 0 and math.isclose(decisions.bias_prior(0.01), -math.log(99))
    assert scalar.flatten({"a": {"b": {"c": 1}}, "d": [1, 2, 3], "e": "x" * 1000}) == {"a.b.c": "1", "d": "[1, 2, 3]", "e": "x" * 500}
    assert scalar.config_hash({"a": 1, "b": 2}) == scalar.config_hash({"b": 2, "a": 1})
    assert scalar.override({"a": {"b": 1}}, ["a.b=2.5", "c.d=true"]) == {"a": {"b": 2.5}, "c": {"d": True}}
    assert decisions.grid_fits(344, 512, 100)["fits"] and math.isclose(decisions.grid_fits(344, 512, 100)["multiplier"], 2.215, rel_tol=1e-3)
    gains = {frozenset(): 0.5, frozenset("a"): 0.6, frozenset("b"): 0.55, frozenset("ab"): 0.65}
    assert decisions.add_groups(gains, ["a", "b"], 0.01) == ["a", "b"]
    assert vectors.select_best_k({3: 0.2, 5: 0.4, 8: 0.4}) == 5


def test_linkage():
    r = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    merges = decisions.average_linkage(["a", "b", "c"], r)
    assert merges[0][:2] == ("a", "b") and math.isclose(merges[1][2], 0.85)


def test_calibration_guard(spark):
    df = spark.createDataFrame([(0.5, None)], "threshold double, temperature double")
    with pytest.raises(Exception, match="calibration"):
        decisions.calibration_guard(df).collect()


def test_nearest_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = vectors.nearest(df.repartition(5), df.filter("id < 2").select(F.col("id").alias("centroid"), F.col("v").alias("c")), 4, "id", "v").orderBy("centroid", "place").collect()
    want = [(c, int(i)) for c in range(2) for i in np.argsort(1 - x @ x[c], kind="stable")[:4]]
    assert [(r.centroid, r.id) for r in got] == want
