"""Sources and sinks over the driver's tables: what a query returns was written by a sink and read back by its source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar
from ..operators import augment, catalog, raster, spatial, stats, vectors
from ..operators.raster import GRID, SIDE
from ..operators.state_io import scratch
from ..schema import CATALOG_SQL
from ..sources import files, geoparquet, scenes
from ..streaming import state

# Tables of text.


def _catalog_csv(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "catalog")
    c = schema.catalog(s, d)
    out = c.select(F.col("tile_id").cast("string").alias("Tile_ID"), (F.col("tile_id") % 170 - 85.0).alias("centroid_lat"), (F.col("tile_id") % 350 - 175.0).alias("centroid_lon"), F.lower("train_class").alias("TrainClass"), F.col("region").alias("RegionName"), F.concat(F.lit("u"), F.col("tile_id"), F.lit(", 9999, v")).alias("UIDs"))
    out.write.csv(at, header=True)
    return files.read_catalog(s, at).select("tile_id", "centroid_lat", "centroid_lon", "train_class", "region", F.concat_ws("|", "uids").alias("uids"))


def _split_map(s: SparkSession, d: str) -> DataFrame:
    """The nations as regions; a split map is configuration, as short as they are."""
    at, splits = scratch(s, "splits") + ".yaml", {name: [] for name in schema.SPLIT_NAMES}
    for r in schema.table(s, d, "nation").orderBy("n_nationkey").collect():
        for name in ("train",) if r.n_nationkey < 15 else ("val_balanced", "val_realistic") if r.n_nationkey < 19 else ("test_realistic",):
            splits[name].append(r.n_name)
    files.write_splits(splits, at)
    return files.read_splits(s, at)


def _stats_json(s: SparkSession, d: str) -> DataFrame:
    at, names = scratch(s, "stats"), stats.CHANNELS
    c = stats.channel_stats(schema.table(s, d, "lineitem"), names).withColumn("pos", F.array_position(F.array(*map(F.lit, names)), F.col("channel")))
    files.write_stats(stats.stats_document(c.filter("pos <= 3"), c.filter("pos > 3"), "v1", 1), at)
    v = files.stats_vectors(files.read_stats(s, at), True)
    return v.select(F.posexplode(F.arrays_zip("names", "mean", "std"))).select((F.col("pos") + 1).alias("pos"), F.col("col.names").alias("channel"), F.round("col.mean", 4).alias("mean"), F.round("col.std", 4).alias("std"))


def _geojson(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "regions")
    files.write_geojson(spatial._regions(s, d).select("region", "rings"), at)
    return files.read_geojson(s, at)


def _appended(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "append")
    files.append_csv(s, schema.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key")), at, ["name", "key"])
    files.append_csv(s, schema.table(s, d, "region").select(F.col("r_name").alias("name")), at, ["name", "key"])
    return s.read.schema("name string, key string").csv(at, header=True)


def _by_region(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    at = scratch(s, "regions")
    files.write_by_region(schema.catalog(s, d).select("tile_id", "train_class", "region"), at)
    return s.read.parquet(at), at


def _metrics(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "metrics")
    for k, m in enumerate(("loss", "f1")):
        files.log_metrics(schema.table(s, d, "nation").select(F.col("n_name").alias("run_id"), F.lit(k).alias("epoch"), F.lit(m).alias("metric"), (F.col("n_nationkey") * 0.5 + k).alias("value")), at)
    return s.read.parquet(at).select("run_id", "epoch", "metric", "value")


def _checkpoints(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "epochs")
    for e in range(1, 5):
        files.save_checkpoint(schema.table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * e).alias("weight")), at, e, 2)
    there = files.entries(s, at).filter(F.col("name").startswith("epoch=")).select(F.col("name").alias("kept"))
    return there.join(files.load_checkpoint(s, at, 4).agg(F.sum("weight").alias("weight")), how="cross")  # one row


def _cached(s: SparkSession, d: str) -> DataFrame:
    at, make = scratch(s, "cache"), lambda: schema.catalog(s, d).groupBy("region").agg(F.count("*").alias("n"))
    files.cached(s, at, "counts", make)
    return files.cached(s, at, "counts", lambda: s.createDataFrame([("made again", 0)], "region string, n long"))


def _tile_list(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "list")
    o = schema.table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    o.union(o.filter("k % 3 = 0")).select("k", F.when(F.col("k") % 10 == 0, "").otherwise(F.lpad(F.col("k").cast("string"), 9, "0")).alias("Tile_id")).write.csv(at, header=True)
    return files.read_tile_list(s, at)


def _lr_range(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "lr")
    files.write_lr_range(schema.table(s, d, "part").select(F.col("p_partkey").alias("global_step"), F.col("p_retailprice").alias("lr"), F.col("p_size").cast("double").alias("loss")), at)
    return s.read.schema("global_step long, lr double, loss double").csv(at, header=True)


def _drift(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "drift")
    rows = schema.table(s, d, "part").groupBy(F.col("p_brand").alias("channel")).agg((F.max("p_size") >= 50).alias("concerning"))
    code = files.drift_report(rows, at)
    return s.read.schema("channel string, concerning boolean").csv(at, header=True).withColumn("code", F.lit(code))


# Rasters.

PIXELS = 1 << 18  # of tiles that a task hands on at once


def _tiles(s: SparkSession, d: str) -> DataFrame:
    """The pixel tables' tiles as rasters of two bands: value, and mask."""

    def gather(x: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((2, SIDE, SIDE), "<f4")
        a[0, x["row"], x["col"]], a[1, x["row"], x["col"]] = x["v"], x["mask"]
        return pd.DataFrame({"tile_id": [str(x["tile_id"].iat[0])], "data": [a.tobytes()]})

    out = raster._grid(s, d).select("tile_id", "row", "col", "v", "mask").groupBy("tile_id").applyInPandas(gather, "tile_id string, data binary")
    return out.select("tile_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.array(*map(F.lit, (3.0, 0.0, 100.0, 0.0, -3.0, 900.0))).alias("transform"), F.lit(3857).alias("epsg"), F.array(F.lit("v"), F.lit("mask")).alias("names"), "data")


def _pixels(rasters: DataFrame) -> DataFrame:
    """(tile_id, band, row, col, value)."""

    names = ["tile_id", "band", "row", "col", "value"]
    frame = lambda parts: pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            parts, held = [], 0
            for t, h, w, raw in zip(x["tile_id"], x["height"], x["width"], x["data"], strict=True):
                a = np.frombuffer(raw, "<f4").reshape(-1, int(h), int(w))
                parts.append((np.full(a.size, int(t)), *(i.ravel() for i in np.indices(a.shape)), a.ravel().astype(float)))
                held += a.size
                if held >= PIXELS:
                    yield frame(parts)
                    parts, held = [], 0
            if parts:
                yield frame(parts)

    return rasters.select("tile_id", "height", "width", "data").mapInPandas(run, "tile_id long, band int, row int, col int, value double")


def _written(s: SparkSession, d: str) -> str:
    """A folder of the tiles as TIFF files. The sink writes where all executors see the shared folder under its path."""
    at = scratch(s, "tiles")
    files.write_rasters(_tiles(s, d), at)
    return at


def _read_bands(s: SparkSession, d: str) -> DataFrame:
    return _pixels(files.read_rasters(s, _written(s, d), [1, 0])).groupBy("tile_id", "band").agg(F.sum("value").alias("total"))


def _read_windows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    where = schema.table(s, d, "supplier").select(k.cast("string").alias("tile_id"), (k % 7).cast("int").alias("row"), (k % 5).cast("int").alias("col"))
    return _pixels(files.read_rasters(s, _written(s, d), [0], where, 5)).groupBy("tile_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def _listed(s: SparkSession, d: str) -> DataFrame:
    return files.listing(s, _written(s, d)).select(F.col("tile_id").cast("long").alias("tile_id"))


def _mapped(s: SparkSession, d: str) -> DataFrame:
    out = raster.map_rasters(files.read_rasters(s, _written(s, d), [1]), lambda a: raster.dilate(a[0] > 0))
    return _pixels(out).filter("value > 0").groupBy("tile_id").agg(F.count("*").alias("n"))


def _flipped(s: SparkSession, d: str) -> DataFrame:
    one = F.col("data")
    label = F.expr("unhex(repeat('00', 144))")
    t = _tiles(s, d).select("tile_id", F.lit(SIDE).alias("size"), F.expr(f"unhex(repeat('40', {3 * SIDE * SIDE}))").alias("rgb"), one.alias("extra"), label.alias("label"))
    flip = augment.Chances(0, 0, 0, 0, 0, 1, 0, 0)
    out = augment.augmented(t, 1, chances=flip).select("tile_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.col("extra").alias("data"))
    return _pixels(out).filter("band = 0").select("tile_id", "row", "col", F.col("value").alias("v"))


def _overviews(s: SparkSession, d: str) -> DataFrame:
    """Tiles written with overviews by the sink, of which the source reads the first."""
    at = scratch(s, "overviews")
    files.write_rasters(_tiles(s, d), at, overviews=1)
    return _pixels(s.read.format("tiles").option("level", "1").option("bands", "0").load(at)).select("tile_id", "row", "col", F.round("value", 4).alias("v"))


def _geoparquet(s: SparkSession, d: str) -> DataFrame:
    """The customers' unit squares, of which those that touch a window come back."""
    at = scratch(s, "geoparquet")
    x, y = F.col("x"), F.col("y")
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y + 1), F.array(x, y))
    geoparquet.write_geoparquet(spatial._pts(s, d).select("id", F.array(ring).alias("rings")), at, 4326)
    some = geoparquet.read_geoparquet(s, at, (10.25, 5.25, 20.75, 15.75))
    return some.select("id", F.round(F.col("rings")[0][0][0], 6).alias("x"), F.round(F.col("rings")[0][2][1], 6).alias("y1"), F.size(F.col("rings")[0]).alias("n_points"))


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """Early stopping by a stream that was stopped half-way, and one that goes on from the state it left."""
    at, store = scratch(s, "resumed"), "spark.sql.streaming.stateStore.providerClass"
    series = state._series(s, d).select("run_id", F.col("epoch").cast("int").alias("epoch"), "value")
    before = s.conf.get(store)
    s.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, where, after in (("first", "epoch <= 14", None), ("second", "epoch > 14", "first")):
            series.filter(where).write.parquet(f"{at}/{name}-in")
            stream = s.readStream.schema(series.schema).parquet(f"{at}/{name}-in")
            saved = state.saved_state(s.read.parquet(f"{at}/{after}")) if after else None
            q = state.resumable_stops(stream, 5, 0.5, 8, 3, saved).writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-at").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        s.conf.set(store, before)
    rows = s.read.parquet(f"{at}/first").unionByName(s.read.parquet(f"{at}/second"))
    return rows.select("run_id", "epoch", F.round("smoothed", 9).alias("smoothed"), F.round("best", 9).alias("best"), "counter", "stopped")


# Scenes.


def _scene_files(s: SparkSession, d: str) -> DataFrame:
    at, k = scratch(s, "scenes"), F.col("event_id")
    e = schema.table(s, d, "events").select(k.alias("scene_id"), "ts", ((k * 37) % 360 - 180.0).alias("min_lon"), ((k * 53) % 180 - 90.0).alias("min_lat"), F.col("value").alias("cloud"), F.col("event_type").alias("orbit"), F.array(F.lit("VV"), F.when(k % 3 > 0, "VH").otherwise("HH")).alias("pols"))
    e.withColumn("max_lon", F.col("min_lon") + 2).withColumn("max_lat", F.col("min_lat") + 1).write.parquet(at)
    return scenes.read_scenes(s, at, (-50.0, -40.0, 60.0, 45.0), ("2024-01-03", "2024-01-25"), {"orbit": "click"}, {"cloud": 60.0}, {"pols": "VH"}).select("scene_id")


def _pixel_grid(s: SparkSession, d: str) -> DataFrame:
    g = raster._grid(s, d)
    px = g.select(F.col("tile_id").alias("scene_id"), F.lit("v").alias("band"), (F.col("col") + 0.5).alias("x"), (F.lit(SIDE) - F.col("row") - 0.5).alias("y"), F.col("v").alias("value"))
    some = schema.table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("scene_id"))
    return scenes.fetch_pixels(px, some, scenes.Grid(2.0, SIDE - 2.0, 2.0, 4, 3), ["v"]).select("scene_id", "row", "col", F.round("value", 6).alias("value"))


# Rules on short tables.


def _best_k(s: SparkSession, d: str) -> DataFrame:
    scores = {r.k: r.score for r in schema.table(s, d, "part").groupBy(F.col("p_size").alias("k")).agg((F.count("*") % 7).alias("score")).collect()}  # 50 sizes
    return s.createDataFrame([(vectors.select_best_k(scores),)], "k int")


def _shape_errors(s: SparkSession, d: str) -> DataFrame:
    """Regions of the world as splits, every other one of them a name where a list has to be."""
    n = schema.table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("many"), F.to_json(F.struct(F.min("n_name").alias("name"))).alias("one"))
    name = F.element_at(F.array(*map(F.lit, ("train", "val_balanced", "extra", "val_realistic", "other"))), (F.col("n_regionkey") + 1).cast("int"))
    return catalog.split_shape(n.select(name.alias("split"), F.when(F.col("n_regionkey") % 2 == 0, F.col("many")).otherwise(F.col("one")).alias("value")))


def _config_hash(s: SparkSession, d: str) -> DataFrame:
    n = schema.table(s, d, "nation")
    entry = lambda a, b: F.create_map(F.lit(a[0]), a[1], F.lit(b[0]), b[1])
    a, b = ("key", F.col("n_nationkey").cast("string")), ("name", F.col("n_name"))
    return n.select("n_name", scalar.map_hash(entry(a, b)).alias("h"), (scalar.map_hash(entry(a, b)) == scalar.map_hash(entry(b, a))).alias("same"))


def _overrides(s: SparkSession, d: str) -> DataFrame:
    n = [r.n_nationkey for r in schema.table(s, d, "nation").orderBy("n_nationkey").collect()]  # 25
    cfg = scalar.override({"a": {"b": 1, "c": "x"}}, [*(f"n.k{i}={i / 2}" for i in n), "a.b=true", "a.d=07"])
    return s.createDataFrame(sorted(scalar.flatten(cfg).items()), "key string, value string")


def _free_riders(s: SparkSession, d: str) -> DataFrame:
    from .decisions import add_groups

    # a line's number, 1 to 7, is a set of the groups a, b and c by its bits
    sets = F.round(F.avg("l_extendedprice") / 100_000, 4) + F.bit_count("l_linenumber") * 0.03
    found = schema.table(s, d, "lineitem").groupBy("l_linenumber").agg(sets.alias("g")).collect()
    gains = {frozenset(): 0.0, **{frozenset(c for k, c in enumerate("abc") if r.l_linenumber >> k & 1): r.g for r in found}}
    return s.createDataFrame([(c,) for c in add_groups(gains, ["a", "b", "c"], 0.02)], "chosen string")


QUERIES = {
    "x11_overviews": _overviews,
    "x11_geoparquet": _geoparquet,
    "t04_resumed_stream": _resumed,
    "s01_catalog_csv": _catalog_csv,
    "s02_split_map_yaml": _split_map,
    "s03_stats_json": _stats_json,
    "s04_raster_bands": _read_bands,
    "s06_raster_windows": _read_windows,
    "s07_geojson": lambda s, d: _geojson(s, d).select(F.col("properties")["region"].alias("region"), "kind", F.round(F.col("rings")[0][2][0], 6).alias("x"), F.round(F.col("rings")[0][2][1], 6).alias("y")),
    "s08_assembled_features": lambda s, d: files.assemble(_geojson(s, d), schema.table(s, d, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("region"), F.concat("n_name", F.lit(".tif")).alias("image")), "region").select("region", "image"),
    "s09_top_level_entries": lambda s, d: files.entries(s, _by_region(s, d)[1]).filter("is_dir").select("name", "is_dir"),
    "s10_raster_listing": _listed,
    "s14_scene_files": _scene_files,
    "s15_pixel_grid": _pixel_grid,
    "s16_tile_list": _tile_list,
    "x01_append_csv": _appended,
    "x05_drift_code": _drift,
    "x08_kept_checkpoints": _checkpoints,
    "x09_keyed_cache": _cached,
    "x10_logged_metrics": _metrics,
    "x12_by_region": lambda s, d: _by_region(s, d)[0].groupBy("region", "train_class").agg(F.count("*").alias("n")),
    "x13_lr_range_csv": _lr_range,
    "r15_joint_flip": _flipped,
    "d01_mapped_rasters": _mapped,
    "o04_best_k": _best_k,
    "u10_split_shape": _shape_errors,
    "f25_config_hash": _config_hash,
    "f27_overrides": _overrides,
    "m16_free_rider": _free_riders,
}
W = f"WITH {GRID}"
SQL = {
    "x11_overviews": f"WITH {GRID} SELECT tile_id, (row // 2)::INT AS row, (col // 2)::INT AS col, round(avg(v), 4) AS v FROM grid GROUP BY 1, 2, 3",
    "x11_geoparquet": "WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 3600 / 100.0::DOUBLE AS x, (c_custkey * 104729) % 2500 / 100.0::DOUBLE AS y FROM customer) SELECT id, round(x, 6) AS x, round(y + 1, 6) AS y1, 5 AS n_points FROM p WHERE x <= 20.75 AND x + 1 >= 10.25 AND y <= 15.75 AND y + 1 >= 5.25",
    "t04_resumed_stream": state.SQL["t01_early_stopping"].replace("round(smoothed, 5)", "round(smoothed, 9)").replace("round(best, 5)", "round(best, 9)"),
    "s01_catalog_csv": f"WITH {CATALOG_SQL} SELECT tile_id::VARCHAR AS tile_id, tile_id % 170 - 85.0::DOUBLE AS centroid_lat, tile_id % 350 - 175.0::DOUBLE AS centroid_lon, train_class, region, 'u' || tile_id || '|v' AS uids FROM cat",
    "s02_split_map_yaml": "SELECT unnest(CASE WHEN n_nationkey < 15 THEN ['train'] WHEN n_nationkey < 19 THEN ['val_balanced', 'val_realistic'] ELSE ['test_realistic'] END) AS split, n_name AS region FROM nation",
    "s03_stats_json": " UNION ALL ".join(f"SELECT {i + 1} AS pos, '{c}' AS channel, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem" for i, c in enumerate(stats.CHANNELS)),
    "s04_raster_bands": f"{W} SELECT tile_id, 0 AS band, sum(mask)::DOUBLE AS total FROM grid GROUP BY 1 UNION ALL SELECT tile_id, 1, sum(v) FROM grid GROUP BY 1",
    "s06_raster_windows": f"{W} SELECT tile_id, sum(v) AS total, count(*) AS n FROM grid WHERE row >= tile_id % 7 AND row < tile_id % 7 + 5 AND col >= tile_id % 5 AND col < tile_id % 5 + 5 GROUP BY 1",
    "s07_geojson": f"WITH {spatial.PTS} SELECT region, 'Polygon' AS kind, round(x0 + 6, 6) AS x, round(y0 + 4, 6) AS y FROM reg",
    "s08_assembled_features": "SELECT n_name AS region, n_name || '.tif' AS image FROM nation WHERE n_regionkey < 3",
    "s09_top_level_entries": f"WITH {CATALOG_SQL} SELECT DISTINCT 'region=' || region AS name, true AS is_dir FROM cat",
    "s10_raster_listing": "SELECT s_suppkey AS tile_id FROM supplier",
    "s14_scene_files": "WITH e AS (SELECT event_id, ts, (event_id * 37) % 360 - 180 AS x, (event_id * 53) % 180 - 90 AS y, value, event_type FROM events) SELECT event_id AS scene_id FROM e WHERE x <= 60 AND x + 2 >= -50 AND y <= 45 AND y + 1 >= -40 AND ts >= '2024-01-03' AND ts < '2024-01-25' AND event_type = 'click' AND value < 60 AND event_id % 3 > 0",
    "s15_pixel_grid": f"{W} SELECT tile_id AS scene_id, ((row - 2) // 2)::INT AS row, ((col - 2) // 2)::INT AS col, round(avg(v), 6) AS value FROM grid JOIN supplier ON s_suppkey = tile_id WHERE s_acctbal > 0 AND row >= 2 AND row < 8 AND col >= 2 AND col < 10 GROUP BY 1, 2, 3",
    "s16_tile_list": "SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS tile_id FROM orders WHERE o_orderkey % 10 <> 0",
    "x01_append_csv": "SELECT n_name AS name, n_nationkey::VARCHAR AS key FROM nation UNION ALL SELECT r_name, NULL FROM region",
    "x05_drift_code": "WITH b AS (SELECT p_brand AS channel, max(p_size) >= 50 AS concerning FROM part GROUP BY 1) SELECT channel, concerning, CASE WHEN (SELECT bool_or(concerning) FROM b) THEN 2 ELSE 0 END AS code FROM b",
    "x08_kept_checkpoints": "SELECT kept, (SELECT sum(n_nationkey * 4) FROM nation)::BIGINT AS weight FROM (VALUES ('epoch=3'), ('epoch=4')) t(kept)",
    "x09_keyed_cache": f"WITH {CATALOG_SQL} SELECT region, count(*) AS n FROM cat GROUP BY 1",
    "x10_logged_metrics": "SELECT n_name AS run_id, 0 AS epoch, 'loss' AS metric, n_nationkey * 0.5::DOUBLE AS value FROM nation UNION ALL SELECT n_name, 1, 'f1', n_nationkey * 0.5::DOUBLE + 1 FROM nation",
    "x12_by_region": f"WITH {CATALOG_SQL} SELECT region, train_class, count(*) AS n FROM cat GROUP BY 1, 2",
    "x13_lr_range_csv": "SELECT p_partkey AS global_step, p_retailprice AS lr, p_size::DOUBLE AS loss FROM part",
    "r15_joint_flip": f"{W} SELECT tile_id, row, ({SIDE - 1} - col)::INT AS col, v FROM grid",
    "d01_mapped_rasters": raster.SQL["r02_dilate"],
    "o04_best_k": "SELECT p_size AS k FROM part GROUP BY 1 ORDER BY count(*) % 7 DESC, k LIMIT 1",
    "u10_split_shape": """WITH s AS (SELECT DISTINCT n_regionkey AS k, ['train', 'val_balanced', 'extra', 'val_realistic', 'other'][n_regionkey + 1] AS split FROM nation)
      SELECT 'missing split ' || n AS error FROM (VALUES ('train'), ('val_balanced'), ('val_realistic'), ('test_realistic')) t(n) WHERE n NOT IN (SELECT split FROM s)
      UNION ALL SELECT 'unknown split ' || split FROM s WHERE split IN ('extra', 'other') UNION ALL SELECT split || ' isn''t a list of names' FROM s WHERE k % 2 = 1""",
    "f25_config_hash": """SELECT n_name, sha256('[{"key":"key","value":"' || n_nationkey || '"},{"key":"name","value":"' || n_name || '"}]') AS h, true AS same FROM nation""",
    "f27_overrides": "SELECT 'n.k' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey // 2) || '.0' ELSE (n_nationkey // 2) || '.5' END AS value FROM nation UNION ALL SELECT * FROM (VALUES ('a.b', 'True'), ('a.c', 'x'), ('a.d', '7')) t(k, v)",
    "m16_free_rider": """WITH RECURSIVE g AS (SELECT 0 AS m, 0.0::DOUBLE AS g UNION ALL SELECT l_linenumber::INT, round(avg(l_extendedprice) / 100000, 4) + bit_count(l_linenumber::INT) * 0.03::DOUBLE FROM lineitem GROUP BY l_linenumber),
      bits(b, name) AS (VALUES (1, 'a'), (2, 'b'), (4, 'c')),
      grow AS (SELECT 0 AS step, 0 AS m, 0.0::DOUBLE AS score, 0 AS added UNION ALL SELECT step + 1, new.m, new.g, new.b FROM grow, LATERAL (SELECT g.m, g.g, b FROM bits, g WHERE grow.m & b = 0 AND g.m = grow.m | b ORDER BY g.g DESC, b LIMIT 1) new WHERE new.g - grow.score >= 0.02),
      cut AS (SELECT 1 AS i, m, score FROM grow WHERE step = (SELECT max(step) FROM grow) UNION ALL
        SELECT i + 1, CASE WHEN bit_count(cut.m) > 1 AND g.g >= cut.score THEN g.m ELSE cut.m END, CASE WHEN bit_count(cut.m) > 1 AND g.g >= cut.score THEN g.g ELSE cut.score END FROM cut JOIN grow ON grow.step = i JOIN g ON g.m = cut.m & (7 - grow.added))
      SELECT name AS chosen FROM bits, (SELECT m FROM cut ORDER BY i DESC LIMIT 1) WHERE m & b > 0""",
}
