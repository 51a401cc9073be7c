"""Integrity of a dataset of tiles: layout, names, tables, splits, rasters and labels, as one table of findings.

Rules that look at one row are tested in one pass over their table, whatever their number; rules that compare tables are joins by key.
What breaks a rule becomes a row (check, key); these are counted and of each rule the least keys are shown, which each task limits first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema
from ..operators import catalog
from ..schema import CLASSES

#: Fixed values of the data format: folders and files, a catalog's columns in order, the projection, the sizes and label values of tiles.
FOLDERS, FILES, OPTIONAL = ("PLANET-RGB", "labels"), ("metadata.csv", "splits.yaml"), ("EXTRA", "version.json")
COLUMNS = ("Tile_id", "centroid_lat", "centroid_lon", "TrainClass", "RegionName", "UIDs")
EPSG, SIDE = 3857, 512
BANDS = {"rgb": 3, "extra": 4, "label": 1}
DTYPES = {"rgb": "uint8", "extra": "float32", "label": "uint8"}
LABELS = (0, 1, 255)
ROLES = {"PLANET-RGB": "rgb", "EXTRA": "extra", "labels": "label"}
Rule = tuple[str, str, Column]

#: Every rule and how grave it is; the order of the report.
RULES = (
    ("layout.folders", "error"), ("layout.files", "error"), ("layout.optional", "warning"),
    ("files.suffix", "error"), ("files.nesting", "error"),
    ("names.numeric", "error"), ("names.width", "error"),
    ("ids.rgb_label", "error"), ("ids.rgb_extra", "error"), ("ids.rgb_catalog", "error"), ("ids.catalog_rgb", "error"),
    ("schema.missing", "error"), ("schema.unexpected", "warning"), ("schema.order", "error"),
    ("catalog.unique", "error"), ("catalog.class", "error"), ("catalog.region", "error"), ("catalog.uids", "error"), ("catalog.place", "error"),
    ("splits.names", "error"), ("splits.unknown", "error"), ("splits.unassigned", "warning"), ("splits.leaked", "error"),
    ("raster.bands", "error"), ("raster.size", "error"), ("raster.dtype", "error"), ("raster.finite", "error"), ("raster.values", "error"), ("raster.crs", "error"),
    ("geometry.transform", "error"), ("geometry.bounds", "error"),
    ("label.positive", "error"), ("label.negative", "error"),
)


def broken(df: DataFrame, key: Column, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(check, key) for each rule (check, holds) that a row breaks; a rule that is null is broken."""
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)), lambda c: c.isNotNull())
    return df.select(F.explode(found).alias("check"), key.cast("string").alias("key"))


def _tag(df: DataFrame, check: str, key: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"))


def layout(listing: DataFrame) -> DataFrame:
    """Of a listing (path, relative to the root; files alone): folders and files that have to be there or may be, and names below the folders."""
    p = F.split("path", "/")
    parts = listing.select("path", p[0].alias("top"), F.size(p).alias("depth"), F.element_at(p, -1).alias("name"))
    there = parts.groupBy("top").agg(F.max((F.col("depth") > 1).cast("int")).alias("is_folder"))
    spark = listing.sparkSession
    wanted = spark.createDataFrame([("layout.folders", x, 1) for x in FOLDERS] + [("layout.files", x, 0) for x in FILES] + [("layout.optional", x, int("." not in x)) for x in OPTIONAL], "check string, top string, is_folder int")
    missing = wanted.join(there, ["top", "is_folder"], "left_anti").select("check", F.col("top").alias("key"))
    tiles = parts.filter(F.col("top").isin(*ROLES) & (F.col("depth") > 1))
    each = broken(tiles, F.col("path"), [("files.suffix", F.col("name").endswith(".tif")), ("files.nesting", F.col("depth") == 2)])
    stem = F.regexp_extract("name", r"^(.*)\.tif$", 1)
    named = tiles.filter(F.col("name").endswith(".tif") & (F.col("depth") == 2)).select("path", stem.alias("stem"))
    numeric = broken(named, F.col("path"), [("names.numeric", F.col("stem").rlike("^[0-9]+$"))])
    # the width that most names have, the least of several
    widths = named.groupBy(F.length("stem").alias("width")).agg(F.count("*").alias("n"))
    most = widths.agg(F.max_by("width", F.struct("n", -F.col("width"))).alias("_most"))
    uneven = _tag(named.crossJoin(F.broadcast(most)).filter(F.length("stem") != F.col("_most")), "names.width", "path")  # one row
    return reduce(DataFrame.unionByName, [missing, each, numeric, uneven])


def tile_ids(listing: DataFrame) -> DataFrame:
    """(role, tile_id) of the tiles of a listing."""
    p = F.split("path", "/")
    role = reduce(lambda c, r: F.when(p[0] == r[0], r[1]).otherwise(c), ROLES.items(), F.lit(None).cast("string"))
    return listing.filter((F.size(p) == 2) & F.col("path").endswith(".tif")).select(role.alias("role"), F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("tile_id")).filter("role IS NOT NULL").distinct()


def correspondence(ids: DataFrame, tiles: DataFrame) -> DataFrame:
    """Ids that the image folder has and another lacks, or the other way; EXTRA only where it exists. One full join by id."""
    rows = ids.groupBy("tile_id").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in ("rgb", "label", "extra")))
    all_ = rows.join(tiles.select(F.col("tile_id").cast("string").alias("tile_id"), F.lit(1).alias("cat")).distinct(), "tile_id", "full").fillna(0)
    extra = ids.filter("role = 'extra'").limit(1).count() > 0
    same = lambda a, b: F.col(a) == F.col(b)
    rules = [("ids.rgb_label", same("rgb", "label")), ("ids.rgb_catalog", (F.col("rgb") == 0) | (F.col("cat") == 1)), ("ids.catalog_rgb", (F.col("cat") == 0) | (F.col("rgb") == 1))]
    return broken(all_, F.col("tile_id"), rules + [("ids.rgb_extra", same("rgb", "extra"))] * extra)


def columns(spark: SparkSession, found: Sequence[str]) -> DataFrame:
    """What a catalog's header lacks or has besides, and whether the rest comes in order."""
    diff = catalog.compare_columns(found, COLUMNS)
    rows = [("schema.missing", c) for c in diff["missing"]] + [("schema.unexpected", c) for c in diff["unexpected"]] + ([] if diff["ordered"] else [("schema.order", ",".join(found))])
    return spark.createDataFrame(rows, "check string, key string")


def catalog_values(tiles: DataFrame) -> DataFrame:
    """tiles: tile_id, train_class, region, uids (array), centroid_lat, centroid_lon."""
    rules = [
        ("catalog.class", F.col("train_class").isin(*CLASSES)), ("catalog.region", ~catalog.is_blank(F.col("region"))),
        ("catalog.uids", (F.col("train_class") != "Positive") | (F.size(F.coalesce("uids", F.array().cast("array<string>"))) > 0)),
        ("catalog.place", F.col("centroid_lat").between(-90, 90) & F.col("centroid_lon").between(-180, 180)),
    ]
    twice = tiles.groupBy("tile_id").agg(F.count("*").alias("n")).filter("n > 1")
    return broken(tiles, F.col("tile_id"), rules).unionByName(_tag(twice, "catalog.unique", "tile_id"))


def split_values(splits: DataFrame, tiles: DataFrame) -> DataFrame:
    """splits: (split, region)."""
    regions = tiles.select("region").distinct()
    names = broken(splits.select("split").distinct(), F.col("split"), [("splits.names", F.col("split").isin(*schema.SPLIT_NAMES))])
    unknown = _tag(splits.select("region").distinct().join(regions, "region", "left_anti"), "splits.unknown", "region")
    rest = _tag(regions.filter(F.col("region").isNotNull()).join(splits.select("region"), "region", "left_anti"), "splits.unassigned", "region")
    return reduce(DataFrame.unionByName, [names, unknown, rest, _tag(catalog.leakage(splits), "splits.leaked", "region")])


RECORD = "tile_id string, role string, bands int, height int, width int, dtype string, epsg int, transform array<double>, n_bad long, n_target long, odd boolean"


def raster_records(rasters: DataFrame, role: str) -> DataFrame:
    """RECORD of each tile that read_rasters() gives: what the rules on rasters look at, in an Arrow pass. n_bad counts values that aren't finite,
    n_target ones of label 1, odd is whether labels have values they can't have. dtype is null, as pixels come as float32."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for t, h, w, tr, epsg, data in zip(x["tile_id"], x["height"], x["width"], x["transform"], x["epsg"], x["data"], strict=True):
                a = np.frombuffer(data, "<f4")
                rows.append((t, role, len(a) // (int(h) * int(w)), h, w, None, epsg, tr, int((~np.isfinite(a)).sum()), int((a == 1).sum()), bool((~np.isin(a, LABELS)).any())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    return rasters.filter("data IS NOT NULL").select("tile_id", "height", "width", "transform", "epsg", "data").mapInPandas(run, RECORD)


def raster_values(records: DataFrame, side: int = SIDE) -> DataFrame:
    """Rules on each record, and on the records of a tile together: places and extents agree among all roles."""
    of = lambda d: reduce(lambda c, r: F.when(F.col("role") == r[0], r[1]).otherwise(c), d.items(), F.lit(None))
    key = F.concat_ws("/", "role", "tile_id")
    rules = [
        ("raster.bands", F.col("bands") == of(BANDS)), ("raster.size", (F.col("height") == side) & (F.col("width") == side)),
        ("raster.dtype", F.col("dtype").isNull() | (F.col("dtype") == of(DTYPES))), ("raster.finite", F.col("n_bad") == 0),
        ("raster.values", (F.col("role") != "label") | ~F.col("odd")), ("raster.crs", F.col("epsg") == EPSG),
    ]
    t = F.col("transform")
    bounds = F.array(t[2], t[5] + t[4] * F.col("height"), t[2] + t[0] * F.col("width"), t[5])
    per = records.groupBy("tile_id").agg(F.count_distinct("transform").alias("n_transforms"), F.count_distinct(bounds).alias("n_bounds"))
    return broken(records, key, rules).unionByName(broken(per, F.col("tile_id"), [("geometry.transform", F.col("n_transforms") <= 1), ("geometry.bounds", F.col("n_bounds") <= 1)]))


def label_semantics(records: DataFrame, tiles: DataFrame) -> DataFrame:
    """A positive tile's label has target pixels, a negative one's none."""
    both = records.filter("role = 'label'").select("tile_id", "n_target").join(tiles.select(F.col("tile_id").cast("string").alias("tile_id"), "train_class"), "tile_id")
    return broken(both, F.col("tile_id"), [("label.positive", (F.col("train_class") != "Positive") | (F.col("n_target") > 0)), ("label.negative", (F.col("train_class") != "Negative") | (F.col("n_target") == 0))])


def findings(bad: DataFrame, first: int = 5) -> DataFrame:
    """(check, severity, n_bad, sample, passed) for every rule: how many keys break it, and the first of them by code point."""
    n = bad.groupBy("check").agg(F.count("*").alias("n_bad"))
    top = bad.withColumn("_i", F.row_number().over(W.partitionBy("check").orderBy("key"))).filter(F.col("_i") <= first)
    top = top.groupBy("check").agg(F.concat_ws(",", F.array_sort(F.collect_list("key"))).alias("sample"))
    rules = bad.sparkSession.createDataFrame(list(RULES), "check string, severity string")
    out = rules.join(n, "check", "left").join(top, "check", "left")
    return out.select("check", "severity", F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"), F.coalesce("sample", F.lit("")).alias("sample"), (F.coalesce("n_bad", F.lit(0)) == 0).alias("passed"))


def integrity(listing: DataFrame, header: Sequence[str], tiles: DataFrame, splits: DataFrame, records: DataFrame, side: int = SIDE) -> DataFrame:
    """All rules over a dataset: its listing (path), the catalog's header and rows in canonical form, its splits (split, region) and its raster
    records. A dataset passes if no rule of severity error has findings."""
    bad = [layout(listing), correspondence(tile_ids(listing), tiles), columns(listing.sparkSession, header), catalog_values(tiles), split_values(splits, tiles), raster_values(records, side), label_semantics(records, tiles)]
    return findings(reduce(DataFrame.unionByName, bad))


# --- queries -------------------------------------------------------------------------------------------------------


def _dataset(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A dataset with faults of every kind, made of the suppliers: listing, catalog, splits, records."""
    sup = schema.table(s, d, "supplier").join(schema.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    tid = F.when(k % 41 == 0, F.concat(F.lit("t"), k.cast("string"))).when(k % 37 == 0, k.cast("string")).otherwise(F.lpad(k.cast("string"), 9, "0"))
    sup = sup.select(k.alias("k"), tid.alias("tile_id"), F.col("n_name").alias("region"), "s_acctbal")
    name = lambda folder, ext=".tif": F.concat(F.lit(folder + "/"), F.col("tile_id"), F.lit(ext))
    k = F.col("k")
    paths = F.array(name("PLANET-RGB"), F.when(k % 11 != 0, name("labels")), F.when(k % 13 != 0, name("EXTRA")), F.when(k % 17 == 0, name("labels/old")), F.when(k % 19 == 0, name("PLANET-RGB", ".xml")), F.when(k == 1, F.lit("metadata.csv")))
    listing = sup.select(F.explode(paths).alias("path")).filter("path IS NOT NULL")
    cls = F.when(k % 23 == 0, "Unknown").when(F.col("s_acctbal") > 3000, "Positive").otherwise("Negative")
    tiles = sup.filter("k % 7 <> 0").select("k", "tile_id", cls.alias("train_class"), F.when(k % 29 == 0, " ").otherwise(F.col("region")).alias("region"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("tile_id")).alias("uids"), (k % 95).cast("double").alias("centroid_lat"), F.lit(0.0).alias("centroid_lon"))
    tiles = tiles.unionByName(tiles.filter("k % 31 = 0")).drop("k")
    splits = schema.table(s, d, "nation").select(F.when(F.col("n_nationkey") < 10, "train").when(F.col("n_nationkey") < 12, "holdout").otherwise("val_realistic").alias("split"), F.concat(F.col("n_name"), F.when(F.col("n_nationkey") == 3, "?").otherwise("")).alias("region")).filter("region <> 'NATION_20'")
    splits = splits.unionByName(splits.filter("region = 'NATION_5'").withColumn("split", F.lit("test_realistic")))
    rec = lambda role, b, k: F.struct(F.lit(role).alias("role"), (F.lit(b) - (k % 43 == 0).cast("int")).alias("bands"))
    records = sup.select("k", "tile_id", F.explode(F.array(rec("rgb", 3, k), rec("label", 1, k + 1), rec("extra", 4, k + 2))).alias("r")).select(
        "tile_id", "r.role", "r.bands", F.lit(512).alias("height"), F.when(k % 47 == 0, 500).otherwise(512).alias("width"), F.when((k % 53 == 0) & (F.col("r.role") == "rgb"), "uint16").otherwise(F.lit(None)).alias("dtype"), F.when(k % 59 == 0, 4326).otherwise(3857).alias("epsg"),
        F.array(F.lit(3.0), F.lit(0.0), F.when((k % 61 == 0) & (F.col("r.role") == "label"), 1.0).otherwise(0.0), F.lit(0.0), F.lit(-3.0), F.lit(0.0)).alias("transform"), F.when((k % 67 == 0) & (F.col("r.role") == "extra"), 5).otherwise(0).cast("long").alias("n_bad"),
        (k % 3).cast("long").alias("n_target"), (k % 71 == 0).alias("odd"))
    return listing, tiles, splits, records


def _integrity(s: SparkSession, d: str) -> DataFrame:
    listing, tiles, splits, records = _dataset(s, d)
    return integrity(listing, ["Tile_id", "centroid_lat", "TrainClass", "centroid_lon", "RegionName", "note"], tiles, splits, records)


QUERIES = {"m20_integrity": _integrity}
_SUP = """sup AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 41 = 0 THEN 't' || s_suppkey WHEN s_suppkey % 37 = 0 THEN s_suppkey::VARCHAR ELSE lpad(s_suppkey::VARCHAR, 9, '0') END AS t, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
rgb AS (SELECT t FROM sup), lab AS (SELECT t FROM sup WHERE k % 11 <> 0), ext AS (SELECT t FROM sup WHERE k % 13 <> 0),
files AS (SELECT 'PLANET-RGB/' || t || '.tif' AS p, t FROM rgb UNION ALL SELECT 'labels/' || t || '.tif', t FROM lab UNION ALL SELECT 'EXTRA/' || t || '.tif', t FROM ext),
one AS (SELECT k, t, CASE WHEN k % 23 = 0 THEN 'Unknown' WHEN s_acctbal > 3000 THEN 'Positive' ELSE 'Negative' END AS cls, CASE WHEN k % 29 = 0 THEN ' ' ELSE n_name END AS region FROM sup WHERE k % 7 <> 0),
cat AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE k % 31 = 0),
sp AS (SELECT CASE WHEN n_nationkey < 10 THEN 'train' WHEN n_nationkey < 12 THEN 'holdout' ELSE 'val_realistic' END AS split, n_name || CASE WHEN n_nationkey = 3 THEN '?' ELSE '' END AS region FROM nation WHERE n_name <> 'NATION_20'),
role(r) AS (VALUES ('rgb'), ('label'), ('extra')),
width AS (SELECT arg_max(w, n * 1000 - w) AS w FROM (SELECT length(t) AS w, count(*) AS n FROM files GROUP BY 1))"""
_BAD = {
    "layout.files": "SELECT 'splits.yaml' UNION ALL SELECT 'metadata.csv' WHERE NOT EXISTS (SELECT 1 FROM sup WHERE k = 1)", "layout.optional": "SELECT 'version.json'",
    "files.suffix": "SELECT 'PLANET-RGB/' || t || '.xml' FROM sup WHERE k % 19 = 0", "files.nesting": "SELECT 'labels/old/' || t || '.tif' FROM sup WHERE k % 17 = 0",
    "names.numeric": "SELECT p FROM files WHERE NOT regexp_full_match(t, '[0-9]+')", "names.width": "SELECT p FROM files, width WHERE length(t) <> w",
    "ids.rgb_label": "SELECT t FROM sup WHERE k % 11 = 0", "ids.rgb_extra": "SELECT t FROM sup WHERE k % 13 = 0", "ids.rgb_catalog": "SELECT t FROM sup WHERE k % 7 = 0",
    "schema.missing": "SELECT 'UIDs'", "schema.unexpected": "SELECT 'note'", "schema.order": "SELECT 'Tile_id,centroid_lat,TrainClass,centroid_lon,RegionName,note'",
    "catalog.unique": "SELECT t FROM one WHERE k % 31 = 0", "catalog.class": "SELECT t FROM cat WHERE cls = 'Unknown'", "catalog.region": "SELECT t FROM cat WHERE region = ' '",
    "catalog.uids": "SELECT t FROM cat WHERE cls = 'Positive' AND k % 5 = 0", "catalog.place": "SELECT t FROM cat WHERE k % 95 > 90",
    "splits.names": "SELECT DISTINCT split FROM sp WHERE split = 'holdout'", "splits.unknown": "SELECT DISTINCT region FROM sp WHERE region NOT IN (SELECT region FROM cat)",
    "splits.unassigned": "SELECT DISTINCT region FROM cat WHERE region NOT IN (SELECT region FROM sp)", "splits.leaked": "SELECT region FROM sp WHERE region = 'NATION_5'",
    "raster.bands": "SELECT r || '/' || t FROM sup, role WHERE (r = 'rgb' AND k % 43 = 0) OR (r = 'label' AND (k + 1) % 43 = 0) OR (r = 'extra' AND (k + 2) % 43 = 0)",
    "raster.size": "SELECT r || '/' || t FROM sup, role WHERE k % 47 = 0", "raster.dtype": "SELECT 'rgb/' || t FROM sup WHERE k % 53 = 0", "raster.finite": "SELECT 'extra/' || t FROM sup WHERE k % 67 = 0",
    "raster.values": "SELECT 'label/' || t FROM sup WHERE k % 71 = 0", "raster.crs": "SELECT r || '/' || t FROM sup, role WHERE k % 59 = 0",
    "geometry.transform": "SELECT t FROM sup WHERE k % 61 = 0", "geometry.bounds": "SELECT t FROM sup WHERE k % 61 = 0",
    "label.positive": "SELECT t FROM cat WHERE cls = 'Positive' AND k % 3 = 0", "label.negative": "SELECT t FROM cat WHERE cls = 'Negative' AND k % 3 > 0",
}
SQL = {
    "m20_integrity": f"WITH {_SUP}, bad(c, key) AS (" + " UNION ALL ".join(f"SELECT '{c}', x.* FROM ({q}) x" for c, q in _BAD.items()) + "), rules(c, severity) AS (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in RULES) + """),
      n AS (SELECT c, count(*) AS n_bad, string_agg(key, ',' ORDER BY key) FILTER (i <= 5) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY key) AS i FROM bad) GROUP BY c)
      SELECT c AS "check", severity, coalesce(n_bad, 0)::BIGINT AS n_bad, coalesce(sample, '') AS sample, coalesce(n_bad, 0) = 0 AS passed FROM rules LEFT JOIN n USING (c)""",
}
