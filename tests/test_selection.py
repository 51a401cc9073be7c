"""Percentiles and samples by selection, components by group, integrity findings."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import projection, sampling, selection, stats
from tilewright.operators.state_io import Kept
from tilewright.plans import integrity


@pytest.fixture
def kept(spark):
    return Kept(spark, "test")


@pytest.mark.parametrize(("held", "pivots"), [(1000, 63), (6, 4)])
def test_percentiles_equal_numpy(spark, kept, held, pivots):
    rng = random.Random(5)
    groups = {"a": [rng.choice([1.5, 2.0, -7.0]) for _ in range(50)], "b": [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(60)], "c": [4.0], None: [1.0, 2.0, 9.0], "d": [None, None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    ps = (0.0, 0.02, 0.5, 0.731, 1.0)
    got = {r.k: (r.n, r.q) for r in selection.percentiles(df, "v", ps, kept, "k", held=held, pivots=pivots).collect()}
    assert set(got) == set(groups) and got["d"] == (0, None)
    for k, vs in groups.items():
        if k != "d":
            assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.percentile(vs, [p * 100 for p in ps]).tolist(), rel=1e-12)
    one = selection.percentiles(df, "v", [0.5], kept, held=held, pivots=pivots).collect()
    assert len(one) == 1 and one[0].q[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    none = selection.percentiles(df.limit(0), "v", [0.5], kept).collect()
    assert [(r.n, r.q) for r in none] == [(0, None)] and not selection.percentiles(df.limit(0), "v", [0.5], kept, "k").count()


def test_no_percentile_buffer_is_left_in_the_plans(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    for out in (stats.clipped(df, "v", 0.02, 0.98, "k"), stats.median_composite(df, "k", value="v"), stats.stretch(df, "v"), stats.exposure(df, "k", Kept(spark, "t"))):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("held", [1000, 5])
def test_group_samples_equal_a_sort(spark, monkeypatch, held):
    monkeypatch.setattr(sampling, "HELD", held)
    monkeypatch.setattr(selection.group_sample, "__defaults__", (held,))
    rows = [(i, "big" if i % 3 else f"g{i % 5}") for i in range(900)] + [(5, "big")] * 3
    df = spark.createDataFrame(rows, "id int, g string").repartition(4)
    quota = F.when(F.col("g") == "big", 400).when(F.col("g") == "g1", 7).when(F.col("g") == "g2", 0).when(F.col("g") == "g3", 10_000).otherwise(F.lit(None))
    got = sampling.capped(df, "id", ["g"], quota).collect()
    want = {r.id: r.h for r in df.select("id", sampling.hash_order(F.col("id"), 42).alias("h")).collect()}
    for g, n in (("big", 400), ("g1", 7), ("g2", 0), ("g3", 10_000), ("g4", 0), ("g0", 0)):
        own = sorted((i for i, k in rows if k == g), key=lambda i: (want[i], i))
        assert sorted(r.id for r in got if r.g == g) == sorted(own[:n])
    assert not sampling.capped(df.limit(0), "id", ["g"], F.lit(2000)).count()


def test_a_large_cap_has_no_window_over_whole_groups(spark, kept):
    """Ranges that are wanted whole stay where they lie: what is sorted is one range of a group."""
    df = spark.range(60_000).select("id", F.lit(1).alias("g"))
    out = sampling.capped(df, "id", ["g"], 20_000)
    assert out.count() == 20_000
    first = df.select("id", sampling.hash_order(F.col("id"), 42).alias("h")).orderBy("h", "id").limit(20_000)
    assert not out.select("id").exceptAll(first.select("id")).count()


def test_components_of_each_group_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {k: rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) + k * 100 for k, n in ((1, 40), (2, 7), (3, 1))}
    rows = [(k, i, [float(v) for v in x]) for k, xs in data.items() for i, x in enumerate(xs)] + [(1, 99, None), (2, 99, [1.0, None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "k int, i int, v array<double>").repartition(4)
    for by, groups in ((("k",), data), ((), {0: np.concatenate(list(data.values()))})):
        got = projection.group_pca(df, "v", *by, k=3).collect()
        assert len(got) == len(rows) and all((r.pc is None) == (r.i == 99) for r in got)
        for k, x in groups.items():
            mean = x.mean(0)
            values, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
            top = vectors[:, ::-1][:, :3]
            top = top * np.sign(top[np.abs(top).argmax(0), np.arange(3)])
            own = [r for r in got if r.pc is not None and (not by or r.k == k)]
            if len(x) > 5:
                assert np.allclose([r.pc for r in own], [(np.array(r.v) - mean) @ top for r in own], atol=1e-8)
                assert own[0].share == pytest.approx((values[::-1][:3] / values.sum()).tolist())
            if len(x) == 1:
                assert own[0].share == [0, 0, 0] and np.allclose(own[0].pc, 0)
    assert not projection.group_pca(df.limit(0), "v", "k").count()


def test_integrity_of_a_whole_dataset_and_of_an_empty_one(spark):
    ids = [f"{i:03d}" for i in range(8)]
    listing = spark.createDataFrame([(f"{f}/{i}.tif",) for f in ("PLANET-RGB", "labels", "EXTRA") for i in ids] + [(f,) for f in ("metadata.csv", "splits.yaml", "version.json")], "path string")
    tiles = spark.createDataFrame([(i, "Positive" if k % 2 else "Negative", "AB"[k % 2], ["u"] if k % 2 else [], 1.0, 2.0) for k, i in enumerate(ids)], "tile_id string, train_class string, region string, uids array<string>, centroid_lat double, centroid_lon double")
    splits = spark.createDataFrame([("train", "A"), ("val_balanced", "B"), ("val_realistic", "B")], "split string, region string")
    records = spark.createDataFrame([(i, r, b, 512, 512, None, 3857, [3.0, 0.0, 0.0, 0.0, -3.0, 0.0], 0, k % 2, False) for k, i in enumerate(ids) for r, b in (("rgb", 3), ("extra", 4), ("label", 1))], integrity.RECORD)
    good = integrity.integrity(listing, list(integrity.COLUMNS), tiles, splits, records).collect()
    assert [r.check for r in good if not r.passed] == [] and len(good) == len(integrity.RULES)
    empty = {r.check: r.sample for r in integrity.integrity(listing.limit(0), [], tiles.limit(0), splits.limit(0), records.limit(0)).collect() if not r.passed}
    assert empty == {"layout.folders": "PLANET-RGB,labels", "layout.files": "metadata.csv,splits.yaml", "layout.optional": "EXTRA,version.json", "schema.missing": ",".join(sorted(integrity.COLUMNS)[:5])}
    shifted = records.withColumn("transform", F.when((F.col("role") == "label") & (F.col("tile_id") == "003"), F.array(*map(F.lit, (3.0, 0.0, 3.0, 0.0, -3.0, 0.0)))).otherwise(F.col("transform")))
    bad = {r.check: r.sample for r in integrity.findings(integrity.raster_values(shifted)).collect() if not r.passed}
    assert bad == {"geometry.transform": "003", "geometry.bounds": "003"}


def test_split_shape_of_rows(spark):
    from tilewright.operators.catalog import split_shape

    rows = [("train", '["a"]'), ("val_balanced", '"a"'), ("val_realistic", None), ("extra", "[1]"), ("test_realistic", '["a", null]')]
    got = sorted(r.error for r in split_shape(spark.createDataFrame(rows, "split string, value string")).collect())
    assert got == ["test_realistic isn't a list of names", "unknown split extra", "val_balanced isn't a list of names", "val_realistic isn't a list of names"]


def test_bias_of_a_share(spark):
    from tilewright.operators.fields import bias_of

    assert spark.range(1).select(bias_of(F.lit(0.2)).alias("b")).first().b == pytest.approx(-math.log(4))
    with pytest.raises(Exception, match="prior"):
        spark.range(1).select(bias_of(F.lit(1.0)).alias("b")).collect()
