from __future__ import annotations

import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from tilewright.operators import augment, raster
from tilewright.plans import decisions
from tilewright.sources import files, scenes, shapes, tiff


@pytest.mark.parametrize("dtype", ["uint8", "float32", "int16"])
def test_tiff_round_trip(dtype):
    a = (np.random.default_rng(0).random((3, 7, 5)) * 200).astype(dtype)
    r = tiff.read(tiff.write(tiff.Raster(a, (3.0, 0.0, 100.0, 0.0, -3.0, 900.0), 3857, ["r", "g", "b"])))
    assert (r.data == a).all() and r.transform == (3.0, 0.0, 100.0, 0.0, -3.0, 900.0) and r.epsg == 3857 and r.bands == ["r", "g", "b"]
    assert (tiff.read(tiff.write(tiff.Raster(a)), [2, 0]).data == a[[2, 0]]).all()
    with pytest.raises(ValueError):
        tiff.read(b"nonsense")


def lzw(data: bytes) -> bytes:
    """A plain encoder to test the decoder."""
    table, bits, width, out = {bytes([i]): i for i in range(256)}, "", 9, b""
    codes, n, w = [(256, 9)], 258, b""
    for b in data:
        wb = w + bytes([b])
        if wb in table:
            w = wb
            continue
        codes.append((table[w], width))
        table[wb], n = n, n + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        w = bytes([b])
    codes += [(table[w], width)] if w else []
    width = 9 if n + 1 < 512 else 10 if n + 1 < 1024 else 11
    codes.append((257, width))
    bits = "".join(f"{c:0{k}b}" for c, k in codes)
    bits += "0" * (-len(bits) % 8)
    out = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    return out


def test_unlzw():
    data = b"abcabcabcabcxyzxyzabc" * 20
    assert tiff.unlzw(lzw(data)) == data


def test_catalog_and_splits(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("Tile_ID,centroid_lat,centroid_lon,TrainClass,RegionName,UIDs\n0001,65.5,-150,positive,A,\"u1, u2\"\n0002,66,-151,Negative,B,9999\n")
    rows = files.read_catalog(spark, str(tmp_path / "metadata.csv")).orderBy("tile_id").collect()
    assert [(r.tile_id, r.train_class, r.uids) for r in rows] == [("0001", "Positive", ["u1", "u2"]), ("0002", "Negative", [])]
    (tmp_path / "bad.csv").write_text("Tile_ID,centroid_lat,centroid_lon,TrainClass,RegionName,UIDs\n0001,65.5,-150,maybe,A,\n")
    with pytest.raises(ValueError, match="Maybe"):
        files.read_catalog(spark, str(tmp_path / "bad.csv"))
    splits = {"train": ["A"], "val_balanced": ["B"], "val_realistic": ["B"], "test_realistic": ["C"]}
    files.write_splits(splits, str(tmp_path / "splits.yaml"))
    assert sorted(tuple(r) for r in files.read_splits(spark, str(tmp_path / "splits.yaml")).collect()) == sorted((k, r) for k, v in splits.items() for r in v)
    (tmp_path / "broken.yaml").write_text("train: A\n")
    with pytest.raises(ValueError):
        files.read_splits(spark, str(tmp_path / "broken.yaml"))


def test_stats_document(spark, tmp_path):
    doc = {"dataset_version": "v1", "computed_date": "2024-01-01", "n_tiles_used": 2, "rgb": {"channel_names": ["r", "g", "b"], "mean": [1, 2, 3], "std": [1, 1, 1]}, "extra": {"channel_names": ["x", "y"], "mean": [7, 8], "std": [2, 2]}}
    (tmp_path / "stats.json").write_text(json.dumps(doc))
    s = files.read_stats(spark, str(tmp_path / "stats.json"))
    assert files.stats_vectors(s, True).first().mean == [1, 2, 3, 7, 8] and files.stats_vectors(s, False).first().mean == [1, 2, 3]
    del doc["extra"]
    (tmp_path / "less.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="EXTRA"):
        files.stats_vectors(files.read_stats(spark, str(tmp_path / "less.json")), True).collect()


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"OBJECTID": 7}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {"OBJECTID": 8}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(doc))
    df = files.read_geojson(spark, str(tmp_path / "p.geojson"))
    assert sorted(r.properties["OBJECTID"] for r in df.collect()) == ["7", "8", "8"] and df.first().rings[0][1] == [4.0, 0.0]
    mapping = spark.createDataFrame([("7", "a.tif")], "OBJECTID string, ImageFileName string")
    assert files.assemble(df, mapping, "OBJECTID").count() == 1
    files.write_geojson(df.select(F.col("properties")["OBJECTID"].alias("OBJECTID"), "rings"), str(tmp_path / "out"))
    back = files.read_geojson(spark, str(tmp_path / "out"))
    key = lambda d: sorted((r.properties["OBJECTID"], r.rings) for r in d.collect())
    assert key(back) == key(df)
    (tmp_path / "pretty.geojson").write_text(json.dumps(doc, indent=2))
    assert key(files.read_geojson(spark, str(tmp_path / "pretty.geojson"))) == key(df)


def test_rasters_and_listing(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "t1.tif").write_bytes(tiff.write(tiff.Raster(a, epsg=3857)))
    (tmp_path / "t2.tif").write_bytes(b"broken")
    rows = {r.tile_id: r for r in files.read_rasters(spark, str(tmp_path), [1]).collect()}
    assert np.frombuffer(rows["t1"].data, "<f4").reshape(3, 4).tolist() == a[1].tolist() and rows["t2"].error
    assert sorted(r.tile_id for r in files.listing(spark, str(tmp_path)).collect()) == ["t1", "t2"]


def test_append_on_a_uri_keeps_old_rows(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    for i in range(3):
        files.append_csv(spark, spark.createDataFrame([(str(i),)], "id string"), path, ["id"])
    assert sorted(r.id for r in spark.read.csv(path, header=True).collect()) == ["0", "1", "2"]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["c"]
    files.write_metrics({"b": 1, "a": [2]}, f"file://{tmp_path}/m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": [2], "b": 1}


def test_window_reads_only_its_strips():
    a = np.arange(2 * 50 * 40, dtype=np.uint16).reshape(2, 50, 40)
    raw = tiff.write(tiff.Raster(a, (3.0, 0.0, 100.0, 0.0, -3.0, 900.0), 3857), rows=8)
    for at in ((0, 0, 50, 40), (7, 3, 9, 5), (8, 0, 8, 40), (49, 39, 1, 1), (15, 2, 20, 11)):
        r = tiff.read(raw, [1], at)
        row, col, h, w = at
        assert (r.data == a[1:, row : row + h, col : col + w]).all() and r.transform == (3.0, 0.0, 100.0 + 3 * col, 0.0, -3.0, 900.0 - 3 * row)
    with pytest.raises(ValueError):
        tiff.read(raw, None, (45, 0, 9, 5))
    # strips that the window doesn't touch may be broken
    broken = bytearray(raw)
    first = np.frombuffer(raw, np.uint8).size - sum(len(__import__("zlib").compress(a[b, i : i + 8].tobytes(), 6)) for b in (0, 1) for i in range(0, 50, 8))
    broken[first : first + 20] = b"x" * 20
    assert (tiff.read(bytes(broken), None, (8, 0, 8, 40)).data == a[:, 8:16]).all()


def test_raster_windows_sink_and_map(spark, tmp_path):
    rng = np.random.default_rng(3)
    tiles = {f"t{i}": rng.integers(0, 255, (3, 30, 30)).astype(np.float32) for i in range(4)}
    (tmp_path / "in").mkdir()
    for t, a in tiles.items():
        (tmp_path / "in" / f"{t}.tif").write_bytes(tiff.write(tiff.Raster(a, epsg=3857, bands=["r", "g", "b"]), rows=4))
    where = spark.createDataFrame([("t1", 5, 6), ("t3", 0, 0), ("t0", 28, 0), ("t2", None, 1)], "tile_id string, row int, col int")
    rows = {r.tile_id: r for r in files.read_rasters(spark, str(tmp_path / "in"), [2], where, 8).collect()}
    assert set(rows) == {"t0", "t1", "t3"} and rows["t0"].error and rows["t1"].height == 8
    assert (np.frombuffer(rows["t1"].data, "<f4").reshape(8, 8) == tiles["t1"][2, 5:13, 6:14]).all()
    whole = files.read_rasters(spark, str(tmp_path / "in"))
    files.write_rasters(whole, str(tmp_path / "out"))
    for t, a in tiles.items():
        r = tiff.read((tmp_path / "out" / f"{t}.tif").read_bytes())
        assert (r.data == a).all() and r.epsg == 3857 and r.bands == ["r", "g", "b"]
    out = {r.tile_id: np.frombuffer(r.data, "<f4").reshape(-1, r.height, r.width) for r in raster.map_rasters(whole, lambda x: x.max(0)).collect()}
    assert all((out[t][0] == a.max(0)).all() for t, a in tiles.items())


def test_entries_and_tile_lists(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.tif").write_bytes(b"123")
    assert sorted(tuple(r)[:2] for r in files.entries(spark, f"file://{tmp_path}/d").collect()) == [("a.tif", False), ("sub", True)]
    (tmp_path / "list.csv").write_text("x,Tile_id\n1,0007\n2, 0008 \n3,\n4,0007\n")
    assert sorted(r.tile_id for r in files.read_tile_list(spark, str(tmp_path / "list.csv")).collect()) == ["0007", "0008"]
    assert files.read_tile_list(spark, str(tmp_path / "list.csv"), "x").count() == 4
    with pytest.raises(ValueError):
        files.read_tile_list(spark, str(tmp_path / "list.csv"), "y")


def test_cache_and_lr_range(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    assert [files.cached(spark, str(tmp_path / "cache"), k, make).count() for k in ("a", "a", "b")] == [5, 5, 5] and len(made) == 2
    files.write_lr_range(spark.createDataFrame([(2, 0.2, 1.0), (1, 0.1, 2.0)], "global_step int, lr double, loss double"), str(tmp_path / "lr"))
    (part,) = (tmp_path / "lr").glob("part-*.csv")
    assert part.read_text().split() == ["global_step,lr,loss", "1,0.1,2.0", "2,0.2,1.0"]


def test_shapefile(spark, tmp_path):
    import struct

    rings = [[(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]
    points = [p for r in rings for p in r]
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, len(points), 0, 4) + b"".join(struct.pack("<2d", *p) for p in points)
    records = [polygon, struct.pack("<i", 0), struct.pack("<i2d", 1, 7.0, 8.0)]
    body = b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    head = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (tmp_path / "grid.shp").write_bytes(head + body)
    fields = b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in ((b"tile", 6), (b"note", 4)))
    table = struct.pack("<4BIHH", 3, 0, 0, 0, 3, 32 + len(fields) + 1, 11) + b"\0" * 20 + fields + b"\r" + b"".join(b" " + t.ljust(6) + n.ljust(4) for t, n in ((b"12_7", b"a"), (b"x_9", b""), (b"3", b"c")))
    (tmp_path / "grid.dbf").write_bytes(table)
    df = shapes.read_shapefiles(spark, str(tmp_path))
    rows = {r.record: r for r in df.collect()}
    assert rows[0].rings == [[list(p) for p in r] for r in rings] and rows[1].rings is None and rows[2].rings == [[[7.0, 8.0]]]
    assert rows[0].properties == {"tile": "12_7", "note": "a"} and rows[1].properties["note"] is None
    parts = shapes.numbered_parts(df.select("record", F.col("properties")["tile"].alias("t")), "t", ["row", "col"]).orderBy("record").collect()
    assert [(r.row, r.col) for r in parts] == [(12.0, 7.0), (None, 9.0), (3.0, None)]
    with pytest.raises(ValueError):
        list(shapes.shapes(b"nonsense"))


def test_scenes_and_pixels(spark, tmp_path):
    rows = [(i, f"2024-07-{i + 1:02d} 00:00:00", i * 1.0, 0.0, i + 0.5, 1.0, i * 10.0, "A" if i % 2 else "D", ["VV", "VH"] if i % 3 else ["VV"]) for i in range(9)]
    df = spark.createDataFrame(rows, "scene_id int, ts string, min_lon double, min_lat double, max_lon double, max_lat double, cloud double, orbit string, pols array<string>")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "scenes"))
    found = scenes.read_scenes(spark, str(tmp_path / "scenes"), (1.2, 0.5, 7.0, 2.0), ("2024-07-02", "2024-07-08"), {"orbit": "A"}, {"cloud": 60.0}, {"pols": "VH"})
    assert sorted(r.scene_id for r in found.collect()) == [1, 5]
    assert "LessThan(cloud,60.0)" in scenes.read_scenes(spark, str(tmp_path / "scenes"), below={"cloud": 60.0}).select("scene_id")._jdf.queryExecution().executedPlan().toString()
    grid = scenes.Grid(0.0, 6.0, 2.0, 3, 2)
    px = spark.createDataFrame([(1, "r", 0.5, 5.5, 1.0), (1, "r", 1.5, 4.5, 3.0), (1, "r", 5.9, 2.1, 7.0), (1, "r", 6.5, 5.0, 9.0), (1, "x", 0.5, 5.5, 9.0), (2, "r", 0.5, 5.5, 9.0)], "scene_id int, band string, x double, y double, value double")
    assert sorted(tuple(r) for r in scenes.fetch_pixels(px, found, grid, ["r"]).collect()) == [(1, "r", 0, 0, 2.0), (1, "r", 1, 2, 7.0)]
    assert scenes.band_groups(["a", "b", "c"], scenes.Grid(0, 0, 1, 10, 10), 4, 900) == [["a", "b"], ["c"]]


def test_augmentation(spark):
    rng = np.random.default_rng(5)
    rgb, extra, label = rng.integers(0, 256, (3, 64, 64), dtype=np.uint8), rng.standard_normal((4, 64, 64)).astype(np.float32), (rng.random((64, 64)) < 0.2).astype(np.uint8)
    none = dict(brightness_contrast=0.0, rot90=0.0, hflip=0.0, vflip=0.0, scale=0.0)
    draw = lambda: augment.generator("t", 1, 42)
    a, e, y = augment.augment(rgb, extra, label, draw(), augment.Chances(**none | {"hflip": 1.0}))
    assert (a == rgb[..., ::-1]).all() and (e == extra[..., ::-1]).all() and (y == label[:, ::-1]).all()
    a, e, y = augment.augment(rgb, extra, label, draw(), augment.Chances(**none | {"brightness_contrast": 1.0}))
    assert (a != rgb).any() and a.dtype == np.uint8 and (e == extra).all() and (y == label).all()
    a, e, y = augment.augment(rgb, None, label, draw(), augment.Chances(scale=1.0, scale_range=(0.5, 0.5)))
    assert a.shape == (3, 64, 64) and y.shape == (64, 64) and set(np.unique(y)) <= {0, 1} and (a[:, :16] == 0).all() and e is None
    rows = [(f"t{i}", 64, rgb.tobytes(), extra.tobytes() if i % 2 else None, label.tobytes()) for i in range(6)]
    df = spark.createDataFrame(rows, "tile_id string, size int, rgb binary, extra binary, label binary")
    one, two = (sorted(map(tuple, augment.augmented(d, 3).collect())) for d in (df, df.repartition(5)))
    assert one == two and one != sorted(map(tuple, augment.augmented(df, 4).collect())) and [r[3] is None for r in one] == [True, False] * 3


def test_split_report(spark, tmp_path):
    rows = [("A", "Positive")] * 6 + [("B", "Positive")] * 3 + [("C", "Positive")] + [("C", "Negative")] * 5
    df = spark.createDataFrame([(str(i), r, c) for i, (r, c) in enumerate(rows)], "tile_id string, region string, train_class string")
    splits = {"train": ["A"], "val_balanced": ["B"], "val_realistic": ["B"], "test_realistic": ["C"]}
    report = decisions.split_report(df, splits, 7)
    assert report["splits"]["test_realistic"] == {"n_regions": 1, "total": 6, "positive": 1, "positive_share": 0.1} and len(report["warnings"]) == 1
    assert not decisions.split_report(df, splits | {"train": ["A", "B"]}, 7)["warnings"]
    files.write_splits(splits, f"file://{tmp_path}/splits.yaml", report)
    assert json.loads((tmp_path / "splits.yaml.summary.json").read_text())["tries"] == 7


def test_sinks(spark, tmp_path):
    new = spark.createDataFrame([("1", "a")], "id string, x string")
    path = str(tmp_path / "c")
    files.append_csv(spark, new, path, ["id", "x"])
    files.append_csv(spark, spark.createDataFrame([("2",)], "id string"), path, ["id", "x"])
    assert sorted((r.id, r.x) for r in spark.read.csv(path, header=True).collect()) == [("1", "a"), ("2", None)]
    drift = spark.createDataFrame([("r", True), ("g", False)], "channel string, concerning boolean")
    assert files.drift_report(drift, str(tmp_path / "d")) == 2 and files.drift_report(drift.filter("not concerning"), str(tmp_path / "d")) == 0
    for e in range(1, 5):
        kept = files.save_checkpoint(spark.range(e), str(tmp_path / "cp"), e, 2)
    assert kept == [4, 3] and sorted(p.name for p in (tmp_path / "cp").iterdir()) == ["epoch=3", "epoch=4"]
    assert files.load_checkpoint(spark, str(tmp_path / "cp"), 4).count() == 4
    files.write_by_region(spark.createDataFrame([("A", 1)], "region string, n int"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().region == "A"
