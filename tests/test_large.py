"""Steps that failed, or grew too fast, on larger tables."""

from __future__ import annotations

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tilewright import registry, schema
from tilewright.operators import metrics, raster, spatial

from .conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """6,000 suppliers, and the other small tables."""
    at = str(tmp_path_factory.mktemp("many"))
    for t in os.listdir(SMALL):
        if t != "supplier.parquet":
            os.symlink(f"{SMALL}/{t}", f"{at}/{t}")
    s = schema.table(spark, SMALL, "supplier").limit(1)
    spark.range(6000).crossJoin(s.drop("s_suppkey")).select(F.col("id").alias("s_suppkey"), "*").drop("id").coalesce(1).write.parquet(f"{at}/supplier.parquet")
    return at


@pytest.mark.parametrize("name", ["r05_blob_records", "r21_vectors"])
def test_blob_records_join_nothing(spark, many, name):
    assert "Join" not in plan(registry.QUERIES[name](spark, many))


@pytest.mark.parametrize("name", ["r25_reclassify_in_domain", "j16_blob_overlap"])
def test_generated_pixels_are_not_broadcast(spark, many, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, many))


def test_blob_records_keep_null_and_nan(spark):
    rows = [(1, 0, c, 1, v) for c, v in enumerate((0.5, None, 0.25))] + [(2, 0, 0, 1, float("nan")), (2, 0, 1, None, 1.0)]
    out = {r.tile_id: r for r in raster.blob_records(spark.createDataFrame(rows, "tile_id int, row int, col int, mask int, score double")).collect()}
    assert (out[1].area, out[1].mean_score, out[1].max_score) == (3, 0.375, 0.5)
    assert out[2].area == 1 and math.isnan(out[2].mean_score)


def test_bootstrap_with_enough_rows(spark, many):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{many}/supplier.parquet/*.parquet'")
    want = con.execute(f"SELECT s_suppkey, draw, bootstrapped FROM ({registry.SQL['o11_bootstrap_negatives']})").fetchall()
    got = [tuple(r) for r in registry.QUERIES["o11_bootstrap_negatives"](spark, many).select("s_suppkey", "draw", "bootstrapped").collect()]
    assert sorted(got) == sorted(want) and len(got) == 5000


def test_tiles_are_dealt_before_they_are_filled(spark, many):
    g = raster._grid(spark, many)
    assert g.rdd.getNumPartitions() == 3 and g.count() == 6000 * raster.SIDE**2
    for name in ("r17_weighted_fusion", "r18_max_fusion", "r18_consensus_fusion", "r24_mosaic"):
        assert "REPARTITION_BY_NUM" in plan(registry.QUERIES[name](spark, many))


def test_points_are_dealt_before_they_meet_candidates(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_POINTS", 1000)
    for name in ("j07_nearest_centroid", "j08_nearest_feature", "j09_covering_cell"):
        p = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.1"))
        assert "REPARTITION_BY_NUM" in p and "NestedLoop" not in p


def test_held_polygons_with_holes(spark):
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d]]
    close = lambda r: r + r[:1]
    polygons = [("b", [close(box(0.0, 0.0, 10.0, 10.0)), box(2.0, 2.0, 8.0, 8.0)]), ("a", [box(12.0, 0.0, 14.0, 3.0)]), ("c", [box(12.0, 0.0, 14.0, 3.0)]), ("d", [[[None, 1.0]]])]
    rng = random.Random(5)
    at = [(i, rng.uniform(-3, 18), rng.uniform(-3, 13)) for i in range(500)] + [(500, None, 1.0), (501, float("nan"), 1.0), (502, 5.0, 5.0), (503, 13.0, 1.0)]
    df = spark.createDataFrame(at, "id int, x double, y double")
    p = spark.createDataFrame(polygons, "name string, rings array<array<array<double>>>")
    got = {r.id: (r.name, r.dist) for r in spatial.nearest_feature(df, p, "id", "name").collect()}
    edge = F.array_min(F.transform("rings", lambda r: spatial.segment_distance(F.col("x"), F.col("y"), r)))
    d = F.when(spatial.in_polygon(F.col("x"), F.col("y"), F.col("rings")), 0.0).otherwise(edge)
    both = df.filter("id < 500 or id > 501").crossJoin(p.filter("name < 'd'")).withColumn("d", d).groupBy("id").agg(F.min(F.struct("d", "name")).alias("b"))
    want = {r.id: (r.b.name, r.b.d) for r in both.collect()} | {500: (None, None), 501: (None, None)}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
    assert got[502] == ("b", 3.0) and got[503] == ("a", 0.0)
    assert spatial.nearest_feature(df, p.limit(0), "id", "name").count() == 0
    none = spatial.nearest_feature(df, p.filter("name = 'd'"), "id", "name")
    assert none.count() == 504 and none.filter("name is not null or dist is not null").count() == 0


def test_precision_at_ratios_reads_pixels_once(spark):
    px = metrics._scored(spark, SMALL)
    tiles = px.groupBy("tile_id").agg(F.max(F.col("label") == 1).alias("is_pos"))
    assert "lineitem" not in plan(metrics.ap_at_ratios(px, tiles, (1, 5, 20)))


def test_precision_at_ratios_drawn_and_bootstrapped(spark):
    tiles = spark.createDataFrame([(i, i < 4) for i in range(16)], "tile_id int, is_pos boolean")
    px = tiles.select("tile_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("tile_id", ((F.col("tile_id") * 7 + F.col("k")) % 5 / 4).alias("score"), F.when((F.col("tile_id") < 4) & (F.col("k") == 1), 1).otherwise(0).alias("label"))
    alone = {r: metrics.ap_at_ratios(px, tiles, (r,)).first() for r in (1, 3, 4, 9)}
    assert [tuple(r) for r in sorted(metrics.ap_at_ratios(px, tiles, (1, 3, 4, 9)).collect())] == [tuple(alone[r]) for r in (1, 3, 4, 9)]
    assert [alone[r].bootstrapped for r in (1, 3, 4, 9)] == [False, False, True, True]
