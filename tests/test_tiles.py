"""The tile data source and its sink, GeoParquet, shipping of the package, reports."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilewright.sources import files, geoparquet, tiff, tiles

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def folder(tmp_path):
    """Five tiles of three bands, in strips or tiles, one broken file, and files that are no tiles."""
    rng = np.random.default_rng(1)
    data = {f"t{k}": rng.normal(size=(3, 400, 300)).astype("f4") for k in range(5)}
    (tmp_path / "in" / "below").mkdir(parents=True)
    for k, (t, a) in enumerate(data.items()):
        r = tiff.Raster(a, (3.0, 0.0, 100.0 * k, 0.0, -3.0, 900.0), 3857, ["r", "g", "b"])
        (tmp_path / "in" / f"{t}.tif").write_bytes(tiff.write(r, rows=5) if k % 2 else tiff.write_tiled(r, 64))
    (tmp_path / "in" / "broken.tif").write_bytes(b"II*\0nothing")
    (tmp_path / "in" / "notes.txt").write_text("x")
    (tmp_path / "in" / "below" / "t9.tif").write_bytes(b"")
    return tmp_path, data


def test_source_reads_bands_windows_and_levels(spark, folder):
    path, data = folder
    tiles.register(spark)
    for at in (str(path / "in"), f"file://{path}/in"):
        rows = {r.tile_id: r for r in spark.read.format("tiles").option("bands", "2,0").option("window", "100,60,20,70").load(at).collect()}
        assert set(rows) == {*data, "broken"} and rows["broken"].data is None and rows["broken"].error
        for k, (t, a) in enumerate(data.items()):
            r = rows[t]
            assert (np.frombuffer(r.data, "<f4").reshape(2, 20, 70) == a[[2, 0], 100:120, 60:130]).all()
            assert (r.height, r.width, r.epsg, r.transform) == (20, 70, 3857, [3.0, 0.0, 100.0 * k + 180, 0.0, -3.0, 600.0])
    half = spark.read.format("tiles").option("level", "1").load(str(path / "in" / "t0.tif")).collect()
    assert len(half) == 1 and (half[0].height, half[0].width, half[0].transform[0]) == (200, 150, 6.0)
    assert "IndexError" in spark.read.format("tiles").option("level", "1").load(str(path / "in" / "t1.tif")).first().error
    assert spark.read.format("tiles").load(str(path / "in")).count() == 6


def test_a_window_reads_its_directory_and_blocks_only(folder):
    path, data = folder
    for t, most in (("t0", 2 * 64 * 64 * 4 * 6), ("t1", 6 * 300 * 4)):
        raw = tiles.Ranges(str(path / "in" / f"{t}.tif"))
        r = tiff.read(raw, [1], (200, 0, 5, 300))
        raw.close()
        assert (r.data[0] == data[t][1, 200:205]).all()
        assert raw.read_bytes <= tiles.HEADER + 2 * tiles.AHEAD + most < raw.size / 4


def test_partitions_follow_the_listing(folder, monkeypatch):
    path, _ = folder
    monkeypatch.setattr(tiles, "PARTITION_BYTES", 1)
    parts = tiles.TileReader({"path": str(path / "in")}).partitions()
    assert [p.paths[0].rsplit("/", 1)[1] for p in parts] == ["broken.tif", *(f"t{k}.tif" for k in range(5))]


def test_windows_by_name_deal_out_no_content(spark, folder):
    path, data = folder
    where = spark.createDataFrame([("t1", 3, 7), ("t2", 390, 0), ("t8", 0, 0), ("t3", None, 1)], "tile_id string, row int, col int")
    out = files.read_rasters(spark, f"file://{path}/in", [0], where, 12)
    assert "content" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.tile_id: r for r in out.collect()}
    assert set(rows) == {"t1", "t2"} and (np.frombuffer(rows["t1"].data, "<f4").reshape(12, 12) == data["t1"][0, 3:15, 7:19]).all()
    assert "leaves the raster" in rows["t2"].error


def test_sink_commits_whole_jobs(spark, folder):
    path, data = folder
    rows = files.read_rasters(spark, str(path / "in")).filter("error IS NULL")
    at = f"file://{path}/out"
    files.write_rasters(rows, at, overviews=2)
    files.write_rasters(rows.limit(1).withColumn("tile_id", F.lit("again")), at)
    assert sorted(os.listdir(path / "out")) == ["again.tif", *(f"t{k}.tif" for k in range(5))]
    for t, a in data.items():
        raw = (path / "out" / f"{t}.tif").read_bytes()
        r = tiff.read(raw)
        assert (r.data == a).all() and r.bands == ["r", "g", "b"] and r.epsg == 3857 and len(tiff.directories(raw)) == 3
        assert np.allclose(tiff.read(raw, level=1).data, (a[:, ::2, ::2] + a[:, 1::2, ::2] + a[:, ::2, 1::2] + a[:, 1::2, 1::2]) / 4, atol=1e-5)
    bad = rows.withColumn("height", F.when(F.col("tile_id") == "t4", 7).otherwise(F.col("height")))
    with pytest.raises(Exception):  # noqa: B017
        files.write_rasters(bad, f"file://{path}/failed")
    assert not [f for _, _, names in os.walk(path / "failed") for f in names]
    with pytest.raises(Exception, match="missing raster columns"):
        rows.drop("epsg").write.format("tiles").mode("append").save(at)


def test_labels_keep_their_values_in_overviews():
    a = np.random.default_rng(0).choice([0, 1, 255], (1, 70, 90)).astype("u1")
    raw = tiff.write_tiled(tiff.Raster(a, epsg=3857), 16, nearest=True)
    for k, d in enumerate(tiff.directories(raw)):
        assert (tiff.read(raw, level=k).data == a[:, :: 2**k, :: 2**k]).all() and d[1][tiff.COMPRESSION] == (8,)
    assert max(tiff.read(raw, level=len(tiff.directories(raw)) - 1).data.shape[1:]) <= 16


def square(x, y, s=1.0):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def test_geoparquet_round_trip_and_pruning(spark, tmp_path):
    rows = [(i, [square(float(i % 60), float(i // 60))] + [square(i % 60 + 0.2, i // 60 + 0.2, 0.5)] * (i % 2)) for i in range(3000)] + [(9000, None), (9001, [])]
    df = spark.createDataFrame(rows, "id int, rings array<array<array<double>>>").repartition(5)
    at = str(tmp_path / "geo")
    geoparquet.write_geoparquet(df, f"file://{at}", epsg=4326, row_group=100, part_rows=1000)
    back = {r.id: r.rings for r in geoparquet.read_geoparquet(spark, at).collect()}
    assert back == dict(rows)
    names = sorted(n for n in os.listdir(at) if not n.startswith((".", "_")))
    metas = [pq.ParquetFile(f"{at}/{n}") for n in names]
    geo = json.loads(metas[0].schema_arrow.metadata[b"geo"])
    assert geo["version"] == "1.1.0" and geo["columns"]["geometry"]["encoding"] == "WKB" and geo["columns"]["geometry"]["bbox"] == [0.0, 0.0, 60.0, 50.0]
    assert len(names) >= 3 and sum(m.num_row_groups for m in metas) >= 30
    some = geoparquet.read_geoparquet(spark, at, (10.5, 10.5, 13.5, 12.5))
    assert {r.id for r in some.collect()} == {i for i, r in rows if r and r[0][0][0] <= 13.5 and r[0][2][0] >= 10.5 and r[0][0][1] <= 12.5 and r[0][2][1] >= 10.5}
    assert "bbox.xmax" in some._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    hit = 0
    for m in metas:
        for g in range(m.num_row_groups):
            s = {m.metadata.row_group(g).column(c).path_in_schema: m.metadata.row_group(g).column(c).statistics for c in range(m.metadata.num_columns)}
            hit += s["bbox.xmin"].min <= 13.5 and s["bbox.xmax"].max >= 10.5 and s["bbox.ymin"].min <= 12.5 and s["bbox.ymax"].max >= 10.5
    assert hit <= 4


def test_well_known_binary_of_others():
    big = b"\0\0\0\0\6\0\0\0\1" + b"\0\0\0\0\3\0\0\0\1\0\0\0\4" + np.array(square(0.0, 0.0)[:3] + [[0.0, 0.0]], ">f8").tobytes()
    assert geoparquet.from_wkb(big) == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    assert geoparquet.from_wkb(geoparquet.to_wkb([square(0, 0)[:4]])) == [square(0.0, 0.0)] and geoparquet.to_wkb(None) is None
    with pytest.raises(ValueError, match="no polygon"):
        geoparquet.from_wkb(b"\1\1\0\0\0" + b"\0" * 16)


def test_curve_visits_neighbours():
    x, y = (a.ravel() for a in np.indices((16, 16)))
    place = geoparquet.hilbert(x, y, 4)
    assert sorted(place) == list(range(256))
    by = np.argsort(place)
    assert (np.abs(np.diff(x[by])) + np.abs(np.diff(y[by])) == 1).all()


def test_executors_get_the_package(tmp_path):
    """From another folder, without a path to the package in the environment."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["r02_dilate"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert "rows 10" in done.stdout, done.stderr[-2000:]


def test_feasibility_report(spark, tmp_path):
    gates = {"least_gain": 0.01, "most_drop": 0.005, "least_large_gain": 0.02, "most_fp_delta": 0.10}
    variants = {"none": {"pr_auc": 0.5, "precision": 0.8}, "minimal": {"pr_auc": 0.505, "precision": 0.8}, "standard": {"pr_auc": 0.52, "precision": 0.799}, "full": {"pr_auc": 0.6, "precision": 0.8}}
    report = files.feasibility({"baseline_pr_auc": 0.4, "multi_pr_auc": 0.43, "fp_rate_delta": 0.05}, variants, gates)
    assert report["recommended"] == "standard" and report["multi_scale"]["passed"] and report["multi_scale"]["scales"] == [1.0, 0.5]
    assert files.feasibility({"baseline_pr_auc": 0.4, "multi_pr_auc": 0.43, "fp_rate_delta": 0.2}, {"none": variants["none"]}, gates)["recommended"] == "none"
    files.write_feasibility(report, f"{tmp_path}/report")
    assert json.loads((tmp_path / "report.json").read_text())["recommended"] == "standard" and "| standard | 0.5200 | 0.7990 |" in (tmp_path / "report.md").read_text()


def test_small_files_are_dealt_to_several_tasks(tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.tif").write_bytes(b"x")
    parts = tiles.TileReader({"path": str(tmp_path)}).partitions()
    assert len(parts) > 2 and sorted(p.rsplit("/", 1)[1] for x in parts for p in x.paths) == sorted(f"{i}.tif" for i in range(300))


def test_a_small_tile_isnt_padded_to_a_large_block():
    data = np.random.default_rng(3).random((2, 12, 12)).astype("<f4")
    raw = tiff.write_tiled(tiff.Raster(data, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 3857, ["a", "b"]), 256, 0)
    assert (tiff.read(raw, None).data == data).all()
    assert len(raw) < 3000 and tiff.read(raw, [1], (2, 3, 5, 5)).data.tolist() == data[1:, 2:7, 3:8].tolist()
    assert b"\x42\x01\x04\x00\x01\x00\x00\x00\x10\x00\x00\x00" in raw  # TILE_WIDTH is 16
