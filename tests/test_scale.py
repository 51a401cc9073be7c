"""Operators whose plan depends on size, at sizes that reach each of their ways, and models against numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import metrics, raster, sampling, spatial, stats, vectors
from tilewright.plans import decisions, suites


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 700, 4999, 5000, 6000])
def test_take_is_a_top_n(spark, n):
    df = spark.range(5000).select(F.col("id").alias("k"))
    h = sampling.hash_order(F.col("k"), 1)
    got = sorted(r.k for r in sampling.take(df, n, h, "k", gather=10).collect())
    assert got == sorted(r.k for r in df.orderBy(h, "k").limit(n).collect())


def test_take_gathers_no_sample(spark):
    df = spark.range(300_000).select(F.col("id").alias("k"))
    out = sampling.sample_fraction(df, "k", 0.5)
    assert out.count() == 150_000
    limits = [int(x.split("limit=")[1].split(",")[0]) for x in plan(out).splitlines() if "limit=" in x]
    assert limits and max(limits) <= 10_000


def test_take_keeps_ties_and_columns(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(60)], "_h int, k int").withColumnRenamed("_h", "v")
    got = sampling.take(df, 25, sampling.hash_order(F.col("v"), 1), "k", gather=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.orderBy(sampling.hash_order(F.col("v"), 1), "k").limit(25).collect()))


@pytest.mark.parametrize("part_rows", [1, 7, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_in_any_number_of_parts(spark, part_rows, descending):
    rng = random.Random(1)
    rows = [(float(x), rng.randrange(9)) for x in rng.sample(range(10_000), 900)]
    out = stats.running(spark.createDataFrame(rows, "x double, n int"), "x", {"s": "n"}, descending, part_rows=part_rows)
    want, total = {}, 0
    for x, n in sorted(rows, reverse=descending):
        total += n
        want[x] = total
    assert {r.x: r.s for r in out.collect()} == want


def points_of(spark, n, seed=2):
    rng = random.Random(seed)
    at = [(i, rng.gauss(0, 30) if i % 3 else rng.uniform(-400, 400), rng.gauss(5, 2)) for i in range(n)]
    return at, spark.createDataFrame(at, "id int, x double, y double")


def test_nearest_centroid_by_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HELD", 5)
    at, df = points_of(spark, 300)
    rng = random.Random(3)
    c = [(i, rng.gauss(0, 20), rng.gauss(0, 20)) for i in range(90)] + [(90, 500.0, 500.0), (91, at[7][1], at[7][2]), (92, at[7][1], at[7][2])]
    out = spatial.nearest_centroid(df, spark.createDataFrame(c, "name int, cx double, cy double"), "id", "name")
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    got = {r.id: (r.name, r.dist) for r in out.collect()}
    for i, x, y in at:
        d, name = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), k) for k, a, b in c)
        assert got[i][0] == name and math.isclose(got[i][1], d, abs_tol=1e-9)
    assert got[7][0] == 91


def test_nearest_feature_by_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HELD", 2)
    at, df = points_of(spark, 120)
    rng = random.Random(4)
    boxes = []
    for i in range(40):
        x, y, w, h = rng.gauss(0, 40), rng.gauss(0, 40), rng.uniform(0.1, 9), rng.uniform(0.1, 30)
        boxes.append((f"p{i:02d}", [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]))
    out = spatial.nearest_feature(df, spark.createDataFrame(boxes, "name string, rings array<array<array<double>>>"), "id", "name")
    got = {r.id: r.dist for r in out.collect()}
    for i, x, y in at:
        want = min(math.hypot(max(r[0][0][0] - x, 0, x - r[0][2][0]), max(r[0][0][1] - y, 0, y - r[0][2][1])) for _, r in boxes)
        assert math.isclose(got[i], want, abs_tol=1e-9)


def test_nearest_to_candidates_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HELD", 5)
    monkeypatch.setattr(spatial, "CROWDED", 8)
    rng = random.Random(8)
    at = [(i, rng.gauss(0, 1) if i % 2 else rng.uniform(-1e4, 1e4), rng.gauss(0, 1)) for i in range(80)]
    c = [(i, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(200)] + [(200, 1e4, 1e4), (201, -1e4, 0.0)] + [(300 + i, 0.5, 0.5) for i in range(30)]
    out = spatial.nearest_centroid(spark.createDataFrame(at, "id int, x double, y double"), spark.createDataFrame(c, "name int, cx double, cy double"), "id", "name")
    for r in out.collect():
        _, x, y = at[r.id]
        d, name = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), k) for k, a, b in c)
        assert r.name == name and math.isclose(r.dist, d, abs_tol=1e-9)


def test_nearest_without_candidates_or_extent(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HELD", 1)
    _, df = points_of(spark, 5)
    same = spark.createDataFrame([(k, 1.0, 1.0) for k in (3, 2, 4)], "name int, cx double, cy double")
    assert {r.name for r in spatial.nearest_centroid(df, same, "id", "name").collect()} == {2}
    assert spatial.nearest_centroid(df.filter("false"), same, "id", "name").count() == 0
    assert spatial.nearest_centroid(df, same.filter("false"), "id", "name").count() == 0


def test_batches_of_many_cycles_are_one_plan(spark):
    df = spark.createDataFrame([(f"t{i:03d}", "Positive" if i < 60 else "Negative") for i in range(73)], "tile_id string, train_class string")
    out = sampling.balanced_batches(df, 12, 5)
    assert plan(out).count("Union") <= 2
    rows = out.collect()
    neg = {}
    for r in rows:
        neg.setdefault(r.batch, []).append(r.train_class)
    assert len(neg) == 30 and all(sorted(v) == ["Negative"] * 10 + ["Positive"] * 2 for v in neg.values())
    assert len({(r.batch, r.tile_id) for r in rows}) == len(rows)


def test_small_blobs_by_eight_neighbours(spark):
    diagonal = [(1, i, i, 1) for i in range(4)] + [(1, 0, 3, 0)]
    df = spark.createDataFrame(diagonal, "tile_id int, row int, col int, mask int")
    assert raster.blobs(df, least=3, eight=True).count() == 4 and raster.blobs(df, least=3).count() == 0


def test_silhouette_kmeans_and_pca_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, (40, 4)) for m in ([3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 3, 1])])
    df = spark.createDataFrame([(i, i // 40, v.tolist()) for i, v in enumerate(x)], "id int, c int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    c, scores = np.arange(120) // 40, []
    for i in range(120):
        a = d[i, c == c[i]].sum() / 39
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        scores.append((b - a) / max(a, b))
    assert math.isclose(vectors.silhouette(df, "v", "c", "id").first().silhouette, np.mean(scores), rel_tol=1e-9)
    labelled, centres = vectors.kmeans(df, "v", 3)
    groups = {tuple(sorted(r.id for r in labelled.filter(F.col("cluster") == k).collect())) for k in range(3)}
    assert groups == {tuple(range(k * 40, k * 40 + 40)) for k in range(3)} and all(math.isclose(np.linalg.norm(v), 1) for v in centres)
    want = {tuple(np.round(m / np.linalg.norm(m), 6)) for m in (x[k * 40 : k * 40 + 40].mean(0) for k in range(3))}
    assert {tuple(np.round(v, 6)) for v in centres} == want
    out, shares = vectors.pca(df, "v", 3)
    u = x - x.mean(0)
    values, axes = np.linalg.eigh(u.T @ u)
    assert np.allclose(shares, values[::-1][:3] / values.sum())
    got = np.array([r.pc for r in out.orderBy("id").collect()])
    for j in range(3):
        a = axes[:, -1 - j]
        assert np.allclose(got[:, j], u @ (a * np.sign(a[np.abs(a).argmax()])), atol=1e-6)


def test_split_search_finds_what_it_promises(spark):
    rng = random.Random(6)
    rows = [(f"{r}-{i}", f"R{r:02d}", f"E{r % 5}", "Positive" if rng.random() < 0.4 else "Negative") for r in range(30) for i in range(rng.randrange(60, 120))]
    df = spark.createDataFrame(rows, "tile_id string, region string, ecoregion string, train_class string")
    splits, tries = decisions.find_splits(df)
    assert decisions.find_splits(df) == (splits, tries)
    count = lambda name, f=lambda r: True: sum(r[1] in splits[name] and f(r) for r in rows)
    for name, want in (("train", 0.7), ("val_realistic", 0.15), ("test_realistic", 0.15)):
        assert abs(count(name) / len(rows) - want) <= 0.1
    assert count("test_realistic", lambda r: r[3] == "Positive") >= 100 and len({r[2] for r in rows if r[1] in splits["val_realistic"]}) >= 2
    assert sorted(splits["train"] + splits["val_realistic"] + splits["test_realistic"]) == sorted({r[1] for r in rows}) and splits["val_balanced"] == splits["val_realistic"]
    with pytest.raises(ValueError):
        decisions.find_splits(df.limit(50), tries=5)


def test_epoch_is_the_sum_of_its_parts(spark):
    rng = random.Random(7)
    rows = [(t, r, c, rng.random(), 255 if rng.random() < 0.1 else int(rng.random() < 0.3)) for t in range(6) for r in range(8) for c in range(8)]
    px = spark.createDataFrame(rows, "tile_id int, row int, col int, score double, label int")
    tiles = px.groupBy("tile_id").agg((F.max("tile_id") < 2).alias("is_pos"))
    got = {r.metric: r.value for r in suites.validate_epoch(px, tiles, ratios=(1, 2)).collect()}
    ok = [(s >= 0.5, y == 1) for _, _, _, s, y in rows if y != 255]
    tp, fp, fn = sum(p and y for p, y in ok), sum(p and not y for p, y in ok), sum(y and not p for p, y in ok)
    assert math.isclose(got["iou"], tp / (tp + fp + fn)) and math.isclose(got["f1"], 2 * tp / (2 * tp + fp + fn))
    total = [0, 0, 0]
    for t in range(6):
        score, label = np.zeros((8, 8)), np.zeros((8, 8), int)
        for i, r, c, s, y in rows:
            if i == t:
                score[r, c], label[r, c] = s, y
        pred = raster.components(raster.drop_small((score >= 0.5) & (label != 255), 4))
        mean = np.array([score[pred == k].mean() for k in range(1, pred.max() + 1)])
        total = [a + b for a, b in zip(total, raster.match_objects(pred, raster.components(label == 1), mean), strict=True)]
    assert [got[f"object_{k}"] for k in ("tp", "fp", "fn")] == total
    ap = {r.ratio: r.ap for r in metrics.ap_at_ratios(px, tiles, (1, 2)).collect()}
    assert {got[f"ap_1_{k}"] for k in (1, 2)} == set(ap.values()) and math.isclose(got["ap_geomean"], math.sqrt(ap[1] * ap[2]), rel_tol=1e-9)
