"""Scalar functions as column expressions, and the driver-side functions on configurations."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

#: Fixed value: geohash digits.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH = 6378137.0


def geohash(lat: Column, lon: Column, precision: int = 12) -> Column:
    """Closed form: both coordinates as whole numbers of 5 * precision / 2 bits, interleaved, longitude first."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    cell = lambda v, n: F.least(F.greatest(F.floor(v * float(1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")
    x, y = cell((lon + 180) / 360, nx), cell((lat + 90) / 180, ny)

    def digit(i: int) -> Column:
        value = F.lit(0).cast("long")
        for b in range(5 * i, 5 * i + 5):  # bit b from the left belongs to x if it is even
            v, n = (x, nx) if b % 2 == 0 else (y, ny)
            value = value * 2 + F.shiftright(v, n - 1 - b // 2).bitwiseAND(1)
        return F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1))

    return F.concat(*(digit(i) for i in range(precision)))


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.pi() / 2)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH, F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * EARTH


#: WGS84 flattening; the rest follows from it.
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E1 = E2**0.5


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal area with true scale at 30 degrees (EPSG:6933), by the authalic q."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.ln((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    k = 0.75**0.5 / (1 - E2 * 0.25) ** 0.5
    return F.radians(lon) * EARTH * k, q * EARTH / (2 * k)


def affine(t: Sequence[float] | Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Top-left corner of a pixel under (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (t[i] for i in range(6))
    return c + col * a + row * b, f + col * d + row * e


def to_pixel(x: Column, y: Column, origin_x: float, origin_y: float, scale: float) -> tuple[Column, Column]:
    """(row, col), not rounded; rows count downwards."""
    return (origin_y - y) / scale, (x - origin_x) / scale


def bbox(t: Sequence[float], height: int, width: int) -> tuple[float, float, float, float]:
    a, b, c, d, e, f = t
    xs, ys = [c, c + width * a + height * b], [f, f + width * d + height * e]
    return min(xs), min(ys), max(xs), max(ys)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def weighted_sum(bands: Sequence[Column], weights: Sequence[float]) -> Column:
    """A tasselled-cap component: the dot product of bands and weights."""
    return F.aggregate(F.zip_with(F.array(*bands), F.array(*map(F.lit, weights)), lambda b, w: b * w), F.lit(0.0), lambda s, x: s + x)


def radar_vegetation(co: Column, cross: Column) -> Column:
    return F.try_divide(4 * cross, co + cross)


def uuid5(name: Column, space: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """The name-based UUID of version 5, without leaving the engine."""
    h = F.sha1(F.concat(F.lit(bytearray(space.bytes)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def next_version(v: Column) -> Column:
    """v.N.0.0 to v.N+1.0.0."""
    p = F.split(v, r"\.")
    return F.concat_ws(".", p[0], (p[1].cast("int") + 1).cast("string"), F.lit("0"), F.lit("0"))


def list_items(raw: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def blob_path(*parts: Column) -> Column:
    """Parts joined by one slash each."""
    return F.concat_ws("/", *(F.regexp_replace(p.cast("string"), "^/+|/+$", "") for p in parts))


def bucket_and_prefix(url: Column) -> tuple[Column, Column]:
    """gs://bucket/prefix in two, without slashes at the prefix's ends."""
    return F.regexp_extract(url, "^gs://([^/]+)", 1), F.regexp_extract(url, "^gs://[^/]+/*(.*?)/*$", 1)


def tile_id_of(path: Column, suffix: str = "tif") -> Column:
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}$", 1)


def round_points(ring: Column, digits: int) -> Column:
    return F.transform(ring, lambda p: F.transform(p, lambda x: F.round(x, digits)))


def numeric_ids(df: DataFrame, column: str) -> DataFrame:
    """Count of ids that aren't all digits, and the distinct widths of those that are."""
    c = F.col(column).cast("string")
    digits = c.rlike("^[0-9]+$")
    return df.agg(F.count_if(~digits).alias("n_bad"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(digits, F.length(c)).cast("string")))).alias("widths"))


def rgb_arm(x: Column, kind: str, mean: float = 0.0, std: float = 1.0, image_mean: float = 0.485, image_std: float = 0.229) -> Column:
    """A channel as the network's input: by the dataset's statistics, by the image collection's, or only to 0..1."""
    return {"dataset": (x - mean) / std, "imagenet": (x / 255 - image_mean) / image_std, "unit": x / 255}[kind]


# Configurations.


def flatten(cfg: Any, prefix: str = "", most: int = 500) -> dict[str, str]:
    """Nested mappings to dotted keys and strings of at most `most` characters."""
    if isinstance(cfg, Mapping):
        out: dict[str, str] = {}
        for k, v in cfg.items():
            out |= flatten(v, f"{prefix}.{k}" if prefix else str(k), most)
        return out
    return {prefix: str(cfg)[:most]}


def config_hash(cfg: Mapping) -> str:
    """SHA-256 that doesn't depend on the order of keys."""
    return hashlib.sha256(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()


def map_hash(m: Column) -> Column:
    """The same idea for a map column: its entries sorted by key."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(m))), 256)


def coerce(raw: str) -> Any:
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


def override(cfg: dict, changes: Sequence[str]) -> dict:
    """A copy of cfg with changes such as "a.b=3"."""
    out = json.loads(json.dumps(cfg))
    for change in changes:
        key, eq, raw = change.partition("=")
        if not eq:
            raise ValueError(f"{change!r} isn't key=value")
        at, *path = [out], *key.split(".")
        node = at[0]
        for k in path[:-1]:
            node = node.setdefault(k, {})
        node[path[-1]] = coerce(raw)
    return out


# --- queries -------------------------------------------------------------------------------------------------------

R = lambda c, n=6: F.round(c, n)


def _points(s: SparkSession, d: str) -> DataFrame:
    """Points on the globe by customer number."""
    k = F.col("c_custkey")
    return schema.table(s, d, "customer").select(k.alias("id"), ((k * 7919) % 17000 / 100.0 - 85).alias("lat"), ((k * 104729) % 35980 / 100.0 - 179.9).alias("lon"))


PTS = "pts AS (SELECT c_custkey AS id, (c_custkey * 7919) % 17000 / 100.0::DOUBLE - 85 AS lat, (c_custkey * 104729) % 35980 / 100.0::DOUBLE - 179.9::DOUBLE AS lon FROM customer)"
CAP = [0.3029, 0.2786, 0.4733, 0.5599]


def _geohash_check(s, d):
    p = _points(s, d).withColumn("stored", geohash(F.col("lat"), F.col("lon"))).withColumn("stored", F.when(F.col("id") % 10 == 0, F.reverse("stored")).otherwise(F.col("stored")))
    return p.filter(geohash(F.col("lat"), F.col("lon")) != F.col("stored")).select("id")


def _merc(s, d):
    x, y = lonlat_to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = mercator_to_lonlat(F.col("x"), F.col("y"))
    return _points(s, d).withColumn("x", x).withColumn("y", y).select("id", R(lon).alias("lon"), R(lat).alias("lat"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def _pix(s, d):
    x, y = affine((3.0, 0.0, 100.0, 0.0, -3.0, 900.0), F.col("p_size"), F.col("p_partkey") % 512)
    r, c = to_pixel(F.col("x"), F.col("y"), 100.0, 900.0, 3.0)
    return schema.table(s, d, "part").select("p_partkey", x.alias("x"), y.alias("y")).select("p_partkey", "x", "y", r.alias("row"), c.alias("col"))


def _eq(s, d):
    x, y = equal_area(F.col("lon"), F.col("lat"))
    return _points(s, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_li = lambda s, d: schema.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
QUERIES = {
    "f01_geohash": lambda s, d: _points(s, d).select("id", geohash(F.col("lat"), F.col("lon")).alias("geohash")),
    "f02_geohash_check": _geohash_check,
    "f03_rounded_key": lambda s, d: _points(s, d).groupBy(F.floor("lat").alias("cell")).agg(F.count_distinct(F.round("lon", 6)).alias("n")),
    "f04_mercator": _merc,
    "f05_f06_affine": _pix,
    "f07_equal_area": _eq,
    "f08_bbox": lambda s, d: schema.table(s, d, "part").select("p_partkey", (100.0 + F.col("p_size") * 1536).alias("min_x"), (900.0 - (F.col("p_size") + 1) * 1536).alias("min_y"), (100.0 + (F.col("p_size") + 1) * 1536).alias("max_x"), (900.0 - F.col("p_size") * 1536).alias("max_y")),
    "f09_normalised_difference": lambda s, d: _li(s, d).select("l_orderkey", "l_linenumber", "l_partkey", R(normalised_difference(F.col("l_discount"), F.col("l_tax"))).alias("nd")),
    "f10_tasselled_cap": lambda s, d: _li(s, d).select("l_orderkey", "l_linenumber", "l_partkey", F.round(weighted_sum([F.col("l_quantity"), F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")], CAP) + 1e-7, 4).alias("tc")),
    "f11_radar_indices": lambda s, d: _li(s, d).select("l_orderkey", "l_linenumber", "l_partkey", R(radar_vegetation(F.col("l_quantity"), F.col("l_tax"))).alias("rvi")),
    "f21_uuid5": lambda s, d: schema.table(s, d, "nation").select("n_name", uuid5(F.col("n_name")).alias("uid")),
    "f22_next_version": lambda s, d: schema.table(s, d, "nation").select("n_name", next_version(F.concat(F.lit("v."), F.col("n_nationkey").cast("string"), F.lit(".0.0"))).alias("version")),
    "f23_list_items": lambda s, d: schema.table(s, d, "part").select("p_partkey", F.concat_ws("|", list_items(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " , ,"), F.lit(",")))).alias("items")),
    "f24_blob_path": lambda s, d: schema.table(s, d, "part").select("p_partkey", blob_path(F.concat(F.lit("/"), F.col("p_brand"), F.lit("/")), F.col("p_type"), F.concat(F.col("p_size").cast("string"), F.lit(".tif"))).alias("path")),
    "s10_listing_ids": lambda s, d: schema.table(s, d, "part").select(tile_id_of(F.concat_ws("/", F.lit("data"), "p_type", F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 20, ".tif").otherwise(".txt")))).alias("tile_id")).filter("tile_id <> ''"),
    "s12_bucket_prefix": lambda s, d: schema.table(s, d, "part").select("p_partkey", F.concat(F.lit("gs://b"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_type"), F.lit("/x/")).alias("u")).select("p_partkey", *(c.alias(n) for c, n in zip(bucket_and_prefix(F.col("u")), ("bucket", "prefix"), strict=True))),
    "f26_map_entries": lambda s, d: schema.table(s, d, "nation").select(F.explode(F.create_map(F.lit("a.name"), F.left("n_name", F.lit(6)), F.lit("a.key"), F.col("n_nationkey").cast("string"))).alias("key", "value")),
    "f28_numeric_ids": lambda s, d: numeric_ids(schema.table(s, d, "orders"), "o_orderkey"),
    "f40_json_properties": lambda s, d: schema.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")),
    "f41_date_parse": lambda s, d: schema.table(s, d, "events").select("event_id", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t")).select("event_id", F.year("t").alias("y"), F.dayofyear("t").alias("doy"), F.hour("t").alias("h")),
    "f42_rounded_ring": lambda s, d: _points(s, d).select("id", round_points(F.array(F.array("lon", "lat"), F.array(F.col("lon") + 0.123456, F.col("lat"))), 2).alias("ring")).select("id", F.round(F.col("ring")[1][0], 2).alias("x")),
    "f43_input_arms": lambda s, d: _li(s, d).select("l_orderkey", "l_linenumber", "l_partkey", *(R(rgb_arm(F.col("l_quantity"), k, 25.0, 14.0)).alias(k) for k in ("dataset", "imagenet", "unit"))),
    "s13_delimited_fields": lambda s, d: schema.table(s, d, "nation").select("n_nationkey", F.split("n_name", "_")[1].try_cast("double").alias("number")),
}
BITS = lambda v, n: f"list_transform(range({n}), lambda k: ({v} >> ({n} - 1 - k)) & 1)"
GH = f"""g AS (SELECT id, lat, lon, floor((lon + 180) / 360 * 1073741824)::BIGINT AS x, floor((lat + 90) / 180 * 1073741824)::BIGINT AS y FROM pts),
  h AS (SELECT id, list_aggregate(list_transform(range(12), lambda i: substr('{BASE32}', (list_sum(list_transform(range(5), lambda j: (CASE WHEN (5 * i + j) % 2 = 0 THEN (x >> (29 - (5 * i + j) // 2)) & 1 ELSE (y >> (29 - (5 * i + j) // 2)) & 1 END) << (4 - j))) + 1)::INT, 1)), 'string_agg', '') AS geohash FROM g)"""
ID3 = "l_orderkey, l_linenumber, l_partkey"
K30 = 0.75**0.5 / (1 - E2 * 0.25) ** 0.5
SQL = {
    "f01_geohash": f"WITH {PTS}, {GH} SELECT id, geohash FROM h",
    "f02_geohash_check": f"WITH {PTS}, {GH} SELECT id FROM h WHERE id % 10 = 0 AND reverse(geohash) <> geohash",
    "f03_rounded_key": f"WITH {PTS} SELECT floor(lat)::BIGINT AS cell, count(DISTINCT round(lon, 6)) AS n FROM pts GROUP BY 1",
    "f04_mercator": f"WITH {PTS} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(radians(lon) * {EARTH}, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * {EARTH}, 2) AS y FROM pts",
    "f05_f06_affine": "SELECT p_partkey, 100.0::DOUBLE + (p_partkey % 512) * 3 AS x, 900.0::DOUBLE - p_size * 3 AS y, p_size::DOUBLE AS row, (p_partkey % 512)::DOUBLE AS col FROM part",
    "f07_equal_area": f"WITH {PTS}, t AS (SELECT id, lon, sin(radians(lat)) AS s FROM pts) SELECT id, round(radians(lon) * {EARTH} * {K30!r}, 3) AS x, round({1 - E2!r}::DOUBLE * (s / (1 - {E2!r}::DOUBLE * s * s) - ln((1 - {E1!r}::DOUBLE * s) / (1 + {E1!r}::DOUBLE * s)) / (2 * {E1!r}::DOUBLE)) * {EARTH} / (2 * {K30!r}::DOUBLE), 3) AS y FROM t",
    "f08_bbox": "SELECT p_partkey, 100.0::DOUBLE + p_size * 1536 AS min_x, 900.0::DOUBLE - (p_size + 1) * 1536 AS min_y, 100.0::DOUBLE + (p_size + 1) * 1536 AS max_x, 900.0::DOUBLE - p_size * 1536 AS max_y FROM part",
    "f09_normalised_difference": f"SELECT {ID3}, CASE WHEN l_discount + l_tax <> 0 THEN round((l_discount - l_tax) / (l_discount + l_tax), 6) END AS nd FROM lineitem",
    "f10_tasselled_cap": f"SELECT {ID3}, round(l_quantity * {CAP[0]} + l_tax * {CAP[1]} + l_discount * {CAP[2]} + l_quantity * {CAP[3]} + 1e-7, 4) AS tc FROM lineitem",
    "f11_radar_indices": f"SELECT {ID3}, round(4 * l_tax / (l_quantity + l_tax), 6) AS rvi FROM lineitem",
    "f21_uuid5": "WITH h AS (SELECT n_name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || n_name::BLOB) AS h FROM nation) SELECT n_name, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS uid FROM h",
    "f22_next_version": "SELECT n_name, 'v.' || (n_nationkey + 1) || '.0.0' AS version FROM nation",
    "f23_list_items": "SELECT p_partkey, replace(p_name, ' ', '|') AS items FROM part",
    "f24_blob_path": "SELECT p_partkey, p_brand || '/' || p_type || '/' || p_size || '.tif' AS path FROM part",
    "s10_listing_ids": "SELECT p_partkey::VARCHAR AS tile_id FROM part WHERE p_size > 20",
    "s12_bucket_prefix": "SELECT p_partkey, 'b' || p_size AS bucket, p_type || '/x' AS prefix FROM part",
    "f26_map_entries": "SELECT 'a.name' AS key, left(n_name, 6) AS value FROM nation UNION ALL SELECT 'a.key', n_nationkey::VARCHAR FROM nation",
    "f28_numeric_ids": "SELECT count(*) FILTER (NOT regexp_full_match(o_orderkey::VARCHAR, '[0-9]+')) AS n_bad, string_agg(DISTINCT length(o_orderkey::VARCHAR)::VARCHAR, ',' ORDER BY length(o_orderkey::VARCHAR)::VARCHAR) AS widths FROM orders",
    "f40_json_properties": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events",
    "f41_date_parse": "SELECT event_id, year(ts)::INT AS y, dayofyear(ts)::INT AS doy, hour(ts)::INT AS h FROM events",
    "f42_rounded_ring": f"WITH {PTS} SELECT id, round(round(lon + 0.123456, 2), 2) AS x FROM pts",
    "f43_input_arms": f"SELECT {ID3}, round((l_quantity - 25) / 14, 6) AS dataset, round((l_quantity / 255 - 0.485) / 0.229, 6) AS imagenet, round(l_quantity / 255, 6) AS unit FROM lineitem",
    "s13_delimited_fields": "SELECT n_nationkey, try_cast(string_split(n_name, '_')[2] AS DOUBLE) AS number FROM nation",
}
