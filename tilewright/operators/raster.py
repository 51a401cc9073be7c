"""Raster operators over tiles.

Pixels are long tables (tile_id, row, col, ...); neighbourhood operators gather a tile of bounded size in one numpy call per tile,
everything else stays a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema
from ..schema import IGNORE

# Array cores.


def neighbours(a: np.ndarray, eight: bool = False, fill: float = 0) -> np.ndarray:
    """The 4 (or 8) neighbours of each pixel, stacked; outside counts as fill."""
    p = np.pad(a, 1, constant_values=fill)
    at = [(0, 1), (2, 1), (1, 0), (1, 2)] + [(0, 0), (0, 2), (2, 0), (2, 2)] * eight
    h, w = a.shape
    return np.stack([p[i : i + h, j : j + w] for i, j in at])


def dilate(mask: np.ndarray, n: int = 1, eight: bool = False) -> np.ndarray:
    m = mask.astype(bool)
    for _ in range(n):
        m = m | neighbours(m, eight, False).any(0)
    return m


def erode(mask: np.ndarray, n: int = 1, eight: bool = False) -> np.ndarray:
    """Outside the tile is background, so objects shrink from its edge too."""
    m = mask.astype(bool)
    for _ in range(n):
        m = m & neighbours(m, eight, False).all(0)
    return m


def boundary_ignore(label: np.ndarray, width: int) -> np.ndarray:
    """The label with the band of `width` pixels on both sides of each boundary set to ignore; no width changes nothing."""
    if width <= 0:
        return label
    target = label == 1
    out = label.copy()
    out[dilate(target, width) ^ erode(target, width)] = IGNORE
    return out


def boundary_band(label: np.ndarray, width: int = 10) -> np.ndarray:
    target = label == 1
    return dilate(target, width, True) & ~erode(target, width, True)


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Numbers from 1 in reading order of each component's first pixel, 0 outside: roots of neighbours hang on the lesser one and paths are
    halved, in rounds of whole arrays."""
    h, w = mask.shape
    m, at, root = mask.astype(bool), np.arange(h * w).reshape(h, w), np.arange(h * w)
    sides = [((slice(None), slice(0, -1)), (slice(None), slice(1, None))), ((slice(0, -1), slice(None)), (slice(1, None), slice(None)))]
    sides += [((slice(0, -1), slice(0, -1)), (slice(1, None), slice(1, None))), ((slice(0, -1), slice(1, None)), (slice(1, None), slice(0, -1)))] * eight
    a, b = (np.concatenate([at[s[k]][m[s[0]] & m[s[1]]] for s in sides]) for k in (0, 1))
    while len(a):
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(h * w, int)
    out[m.ravel()] = np.unique(root[m.ravel()], return_inverse=True)[1] + 1
    return out.reshape(h, w)


def drop_small(mask: np.ndarray, least: int, eight: bool = False) -> np.ndarray:
    if least <= 1:
        return mask.astype(bool)
    c = components(mask, eight)
    keep = np.bincount(c.ravel()) >= least
    keep[0] = False
    return keep[c]


def match_objects(pred: np.ndarray, truth: np.ndarray, confidence: np.ndarray, least: float = 0.3, best_only: bool = False) -> tuple[int, int, int]:
    """(tp, fp, fn) of components: predictions by falling confidence, ties by number, each take the free true object of greatest
    overlap of at least `least`. best_only: only their best object counts, and they fail if it is taken. Equal confidences have no
    order of their own; the lower number, which comes first in reading order, goes first."""
    n, m = int(pred.max(initial=0)), int(truth.max(initial=0))
    joint = np.bincount((pred.astype(np.int64) * (m + 1) + truth).ravel(), minlength=(n + 1) * (m + 1)).reshape(n + 1, m + 1)
    union = joint.sum(1)[1:, None] + joint.sum(0)[None, 1:] - joint[1:, 1:]
    iou = joint[1:, 1:] / np.maximum(union, 1)
    free, tp = np.ones(m, bool), 0
    for i in sorted(range(n), key=lambda i: (-confidence[i], i)):
        own = iou[i] if best_only else np.where(free, iou[i], -1.0)
        if m and own.max() >= least and free[own.argmax()]:
            free[own.argmax()] = False
            tp += 1
    return tp, n - tp, m - tp


def focal_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over an odd square window, edges repeated; by sums of a summed-area table."""
    r = size // 2
    s = np.pad(np.pad(a.astype(np.float64), r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def terrain(a: np.ndarray, scale: float, azimuth: float = 315.0, altitude: float = 45.0) -> dict[str, np.ndarray]:
    """Laplacian of 8 neighbours, slope and aspect in degrees (aspect clockwise from north), and hillshade from 0 to 255."""
    p = np.pad(a.astype(np.float64), 1, mode="edge")
    h, w = a.shape
    s = lambda i, j: p[i : i + h, j : j + w]
    dx = ((s(0, 2) + 2 * s(1, 2) + s(2, 2)) - (s(0, 0) + 2 * s(1, 0) + s(2, 0))) / (8 * scale)
    dy = ((s(2, 0) + 2 * s(2, 1) + s(2, 2)) - (s(0, 0) + 2 * s(0, 1) + s(0, 2))) / (8 * scale)
    slope, aspect = np.arctan(np.hypot(dx, dy)), np.arctan2(-dx, dy)
    zenith, sun = np.radians(90 - altitude), np.radians(azimuth)
    shade = np.cos(zenith) * np.cos(slope) + np.sin(zenith) * np.sin(slope) * np.cos(sun - aspect)
    around = sum(s(i, j) for i in range(3) for j in range(3)) - 9 * s(1, 1)
    return {"laplacian": around, "slope": np.degrees(slope), "aspect": np.degrees(aspect) % 360, "hillshade": np.clip(255 * shade, 0, 255)}


def shaded_relief(hillshade: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """0.7 hillshade and 0.3 curvature, both clipped to their 2nd and 98th percentiles and scaled to 0..1."""

    def scaled(x: np.ndarray) -> np.ndarray:
        lo, hi = np.percentile(x, [2, 98])
        return np.clip((x - lo) / (hi - lo), 0, 1) if hi > lo else np.zeros_like(x)

    return 0.7 * scaled(hillshade) + 0.3 * scaled(curvature)


def resample(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by pixel centres, edges repeated."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (r0, r1, fr), (c0, c1, fc) = axis(a.shape[0], height), axis(a.shape[1], width)
    rows = a[r0] * (1 - fr)[:, None] + a[r1] * fr[:, None]
    return rows[:, c0] * (1 - fc) + rows[:, c1] * fc


def crop(a: np.ndarray, row: int, col: int, size: int) -> np.ndarray:
    """size x size around a pixel; what lies outside is zero, at the bottom and right."""
    r, c = max(0, row - size // 2), max(0, col - size // 2)
    part = a[r : r + size, c : c + size]
    return np.pad(part, ((0, size - part.shape[0]), (0, size - part.shape[1])))


#: Symmetries of a tile by name: what is done, and what undoes it.
FLIPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda a: a, "hflip": lambda a: a[:, ::-1], "vflip": lambda a: a[::-1], "rot180": lambda a: a[::-1, ::-1],
    "transpose": lambda a: a.T, "rot90": lambda a: np.rot90(a), "rot270": lambda a: np.rot90(a, 3), "antitranspose": lambda a: a[::-1, ::-1].T,
}
INVERSE = {k: {"rot90": "rot270", "rot270": "rot90"}.get(k, k) for k in FLIPS}
#: full_compat stands for compositions of flips, of which only four differ, each twice.
TTA = {"none": ["identity"], "minimal": ["identity", "hflip"], "standard": ["identity", "hflip", "vflip", "rot180"], "full_compat": ["identity", "hflip", "vflip", "rot180"] * 2, "full": list(FLIPS)}


def augmented_mean(predict: Callable[[np.ndarray], np.ndarray], tile: np.ndarray, kind: str, space: str = "logit") -> np.ndarray:
    """The mean of predictions under symmetries, each undone, of logits or of probabilities (then back as a logit)."""
    if kind not in TTA:
        raise ValueError(f"unknown augmentation {kind!r}")
    out = [FLIPS[INVERSE[k]](predict(FLIPS[k](tile))) for k in TTA[kind]]
    if space == "logit":
        return np.mean(out, 0)
    p = np.clip(np.mean([1 / (1 + np.exp(-x)) for x in out], 0), 1e-7, 1 - 1e-7)
    return np.log(p / (1 - p))


# Operators on tables.


def per_tile(df: DataFrame, value: str, f: Callable[[np.ndarray], np.ndarray], kind: str = "double", *by: str) -> DataFrame:
    """(by..., row, col, out): an array function applied to each tile, whose pixels may come in any order."""
    keys = list(by) or ["tile_id"]

    def run(x: pd.DataFrame) -> pd.DataFrame:
        h, w = int(x["row"].max()) + 1, int(x["col"].max()) + 1
        a = np.zeros((h, w), np.float64)
        a[x["row"], x["col"]] = x[value]
        out = f(a)
        r, c = np.indices(out.shape)
        return pd.DataFrame({**{k: x[k].iat[0] for k in keys}, "row": r.ravel(), "col": c.ravel(), "out": out.ravel()})

    fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    return df.select(*keys, "row", "col", value).groupBy(*keys).applyInPandas(run, ", ".join([*fields, "row int", "col int", f"out {kind}"]))


def map_rasters(rasters: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(tile_id, height, width, data): an array function applied to whole tiles as read_rasters() gives them (band, row, column; float32),
    where they lie. Tiles with an error are left out. This is the way for tiles in files; per_tile() is for pixels in tables."""

    def run(frames):
        for x in frames:
            rows = []
            for t, h, w, data in zip(x["tile_id"], x["height"], x["width"], x["data"], strict=True):
                out = np.asarray(f(np.frombuffer(data, "<f4").reshape(-1, int(h), int(w))), "<f4")
                out = out if out.ndim == 3 else out[None]
                rows.append((t, out.shape[1], out.shape[2], np.ascontiguousarray(out).tobytes()))
            yield pd.DataFrame(rows, columns=["tile_id", "height", "width", "data"])

    return rasters.filter("data is not null").select("tile_id", "height", "width", "data").mapInPandas(run, "tile_id string, height int, width int, data binary")


def blobs(df: DataFrame, mask: str = "mask", least: int = 1, eight: bool = False) -> DataFrame:
    """Pixels (tile_id, row, col, blob) of components with at least `least` pixels."""
    out = per_tile(df, mask, lambda a: components(drop_small(a > 0, least, eight), eight).astype(float), "double")
    return out.filter("out > 0").select("tile_id", "row", "col", F.col("out").cast("int").alias("blob"))


def blob_records(df: DataFrame, least: int = 1) -> DataFrame:
    """Per blob: area, mean and greatest score, and centroid; df: tile_id, row, col, mask, score. Pixels get their blob where their tile is
    gathered, so that they needn't be joined with themselves."""

    def run(x: pa.Table) -> pa.Table:
        row, col = x["row"].to_numpy(), x["col"].to_numpy()
        a = np.zeros((int(row.max()) + 1, int(col.max()) + 1), bool)
        a[row, col] = pc.fill_null(pc.cast(x["mask"], "double"), 0.0).to_numpy() > 0
        blob = components(drop_small(a, least))[row, col]
        return x.drop_columns("mask").append_column("blob", pa.array(blob, pa.int32())).filter(pa.array(blob > 0))

    px = df.select("tile_id", "row", "col", "score", "mask")
    kinds = [f"{c} {px.schema[c].dataType.simpleString()}" for c in ("tile_id", "row", "col", "score")]
    b = px.groupBy("tile_id").applyInArrow(run, ", ".join([*kinds, "blob int"]))
    return b.groupBy("tile_id", "blob").agg(F.count("*").alias("area"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.avg("row").alias("row"), F.avg("col").alias("col"))


def object_counts(df: DataFrame, threshold: float = 0.5, least: int = 4, iou: float = 0.3) -> DataFrame:
    """(tile_id, tp, fp, fn) of objects in df (tile_id, row, col, score, label); ignored pixels belong to no object."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        h, w = int(x["row"].max()) + 1, int(x["col"].max()) + 1
        score, label = np.zeros((h, w)), np.full((h, w), IGNORE)
        score[x["row"], x["col"]], label[x["row"], x["col"]] = x["score"], x["label"]
        ok = label != IGNORE
        pred, truth = components(drop_small((score >= threshold) & ok, least)), components((label == 1) & ok)
        n = np.bincount(pred.ravel())
        mean = np.bincount(pred.ravel(), score.ravel())[1:] / np.maximum(n[1:], 1)
        tp, fp, fn = match_objects(pred, truth, mean, iou)
        return pd.DataFrame({"tile_id": [x["tile_id"].iat[0]], "tp": [tp], "fp": [fp], "fn": [fn]})

    kind = df.schema["tile_id"].dataType.simpleString()
    return df.groupBy("tile_id").applyInPandas(run, f"tile_id {kind}, tp long, fp long, fn long")


def rasterize(tiles: DataFrame, polygons: DataFrame, size: int, scale: float) -> DataFrame:
    """(tile_id, row, col, label): pixel centres in polygons (tile_id, rings, label); target wins over ignore, tiles without target vanish.

    tiles: tile_id, origin_x, origin_y (top left). The labels are filled by scan lines, a tile at a time.
    """
    from . import outlines

    return outlines.label_pixels(outlines.rasterize(tiles, polygons, size, scale), size)


def fuse(df: DataFrame, mode: str = "weighted_mean", size: int = 512, sigma: float = 128.0) -> DataFrame:
    """(grow, gcol, p) of overlapping predictions by global pixel; df: grow, gcol, row, col, p. Weights fall from the tile's centre."""
    c = (size - 1) / 2
    w = F.exp(-(F.pow(F.col("row") - c, 2) + F.pow(F.col("col") - c, 2)) / (2 * sigma * sigma))
    p = {"weighted_mean": F.sum(F.when(F.col("p").isNotNull(), w * F.col("p"))) / F.sum(F.when(F.col("p").isNotNull(), w)), "max": F.max("p"), "consensus": F.min("p")}
    if mode not in p:
        raise ValueError(f"unknown fusion {mode!r}")
    return df.groupBy("grow", "gcol").agg(p[mode].alias("p"))


def scale_mean(*scales: Column) -> Column:
    """Mean of the scales that have data; none: -1."""
    have = F.filter(F.array(*scales), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have)).otherwise(-1.0)


def fill_nodata(df: DataFrame, value: str, nodata: Column, mean: Column) -> DataFrame:
    """value with the channel's mean where there are no data; status: 'skip' for tiles without any, else 'partial' or 'full'."""
    n = F.count("*").over(W.partitionBy("tile_id"))
    empty = F.count_if(nodata).over(W.partitionBy("tile_id"))
    return df.withColumn("status", F.when(empty == n, "skip").when(empty > 0, "partial").otherwise("full")).withColumn(value, F.when(nodata, mean).otherwise(F.col(value)))


def regimes(df: DataFrame, width: int = 10) -> DataFrame:
    """Each pixel once for each of its regimes: all, positive, and boundary where a band was marked in column band."""
    tags = F.filter(F.array(F.lit("all"), F.when(F.col("label") == 1, "positive"), F.when(F.col("band") == 1, "boundary")), lambda t: t.isNotNull())
    return df.withColumn("regime", F.explode(tags))


def mosaic(df: DataFrame, order: str, value: str) -> DataFrame:
    """The value of the last image on each pixel."""
    return df.filter(F.col(value).isNotNull()).groupBy("grow", "gcol").agg(F.max_by(value, order).alias(value))


def clip(df: DataFrame, domain: DataFrame) -> DataFrame:
    """The pixels (tile_id, row, col) of df that domain has. Pixels that are generated look few to the optimizer; they aren't broadcast."""
    return df.join(domain.hint("merge"), ["tile_id", "row", "col"], "left_semi")


def block_any(df: DataFrame, size: int = 100, *by: str) -> DataFrame:
    """1 for blocks with any 1, else null; the blocks of each by are apart."""
    return df.groupBy(*by, F.floor(F.col("row") / size).alias("brow"), F.floor(F.col("col") / size).alias("bcol")).agg(F.max(F.when(F.col("v") == 1, 1)).alias("v"))


def window_of(min_x: Column, min_y: Column, max_x: Column, max_y: Column, height: Column, width: Column, size: int = 512) -> Column:
    """struct<row, col> of the window of size around bounds in pixels, shifted into the raster; null if it can't hold them."""
    fits = (max_x - min_x <= size) & (max_y - min_y <= size) & (height >= size) & (width >= size)
    place = lambda lo, hi, n: F.greatest(F.lit(0), F.least(F.floor((lo + hi) / 2 - size / 2).cast("int"), (n - size).cast("int")))
    return F.when(fits, F.struct(place(min_y, max_y, height).alias("row"), place(min_x, max_x, width).alias("col")))


def tile_errors(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(tile_id, error) for each rule (message, holds) that a tile breaks."""
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules)), lambda e: e.isNotNull())
    return df.select("tile_id", F.explode(found).alias("error"))


# --- queries -------------------------------------------------------------------------------------------------------

SIDE, TILES = 12, 2000  # pixels of a tile's side, tiles in a task


def _grid(s: SparkSession, d: str) -> DataFrame:
    """A tile of SIDE x SIDE pixels for each supplier, filled by arithmetic; tiles are dealt out before they are filled."""
    t, r, c = F.col("tile_id"), F.col("row"), F.col("col")
    g = schema.dealt(schema.table(s, d, "supplier").select(F.col("s_suppkey").alias("tile_id")), TILES, "tile_id").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    g = g.withColumn("v", ((t * 31 + r * r * 7 + c * 13 + r * c * 3) % 17).cast("double"))
    return g.withColumn("mask", (F.col("v") >= 9).cast("int")).withColumn("label", F.when((r == 0) & (t % 3 == 0), IGNORE).otherwise(((t * 5 + r * r * 7 + c * 13 + r * c * 3) % 17 >= 10).cast("int"))).withColumn("score", F.col("v") / 16)


GRID = f"""grid AS (SELECT tile_id, row, col, ((tile_id * 31 + row * row * 7 + col * 13 + row * col * 3) % 17)::DOUBLE AS v, ((tile_id * 31 + row * row * 7 + col * 13 + row * col * 3) % 17 >= 9)::INT AS mask,
  CASE WHEN row = 0 AND tile_id % 3 = 0 THEN 255 ELSE ((tile_id * 5 + row * row * 7 + col * 13 + row * col * 3) % 17 >= 10)::INT END AS label FROM (SELECT s_suppkey AS tile_id, r::INT AS row, c::INT AS col FROM supplier, range({SIDE}) a(r), range({SIDE}) b(c)))"""
AROUND = "SELECT a.tile_id, a.row, a.col, {f} AS x FROM grid a LEFT JOIN grid b ON a.tile_id = b.tile_id AND {near} GROUP BY a.tile_id, a.row, a.col"
FOUR, NINE = "abs(a.row - b.row) + abs(a.col - b.col) <= 1", "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1"


def _count(df: DataFrame) -> DataFrame:
    return df.filter("out <> 0").groupBy("tile_id").agg(F.count("*").alias("n"))


def _fused(s, d, mode):
    """Tiles side by side with an overlap of four columns."""
    g = _grid(s, d).withColumn("grow", F.col("row") + F.floor(F.col("tile_id") / 10) * SIDE).withColumn("gcol", F.col("col") + F.col("tile_id") % 10 * 8).withColumn("p", F.col("score"))
    return fuse(g, mode, SIDE, 3.0).select(F.col("grow").cast("long").alias("grow"), F.col("gcol").cast("long").alias("gcol"), F.round("p", 6).alias("p"))


PLACED = f"WITH {GRID}, g AS (SELECT row + tile_id // 10 * {SIDE} AS grow, col + tile_id % 10 * 8 AS gcol, v / 16 AS p, exp(-(pow(row - 5.5, 2) + pow(col - 5.5, 2)) / 18) AS w, tile_id FROM grid)"


def _rasterized(s, d):
    t = schema.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("tile_id"), F.lit(0.0).alias("origin_x"), F.lit(16.0).alias("origin_y"))
    k = F.col("tile_id") % 5
    box = lambda a, b: F.array(F.array(F.array(a, a), F.array(b, a), F.array(b, b), F.array(a, b), F.array(a, a)))
    one = t.filter("tile_id % 4 <> 3").select("tile_id", box((2 + k).cast("double"), (9 + k).cast("double")).alias("rings"), F.lit(1).alias("label"))
    two = t.select("tile_id", box(F.lit(1.0), F.lit(6.0)).alias("rings"), F.lit(IGNORE).alias("label"))
    return rasterize(t, one.union(two), 16, 1.0).groupBy("tile_id", "label").agg(F.count("*").alias("n"))


def _mosaicked(s, d):
    """The tiles side by side in one grid of pixels."""
    g = _grid(s, d)
    return g.select((F.col("row") + F.floor(F.col("tile_id") / 10) * SIDE).alias("row"), (F.col("col") + F.col("tile_id") % 10 * SIDE).alias("col"), (F.col("v") >= 15).cast("int").alias("v"))


def _windows(s, d):
    k = F.col("p_partkey")
    w = window_of(k % 900, k % 700, k % 900 + F.col("p_size") * 11, k % 700 + 40, F.lit(1000), F.lit(1200))
    return schema.table(s, d, "part").select("p_partkey", w.alias("w")).select("p_partkey", F.col("w.row").alias("row"), F.col("w.col").alias("col"))


def _errors(s, d):
    per = _grid(s, d).groupBy("tile_id").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count("*").alias("n"), F.collect_set("label").alias("values"))
    rules = [("labels outside 0 and 1", F.size(F.array_except("values", F.array(F.lit(0), F.lit(1)))) == 0), ("no target", F.col("n1") > 50), ("wrong size", F.col("n") == SIDE * SIDE)]
    return tile_errors(per, rules)


QUERIES = {
    "r01_rasterize": _rasterized,
    "r02_dilate": lambda s, d: _count(per_tile(_grid(s, d), "mask", lambda a: dilate(a > 0).astype(float))),
    "r02_erode_eight": lambda s, d: _count(per_tile(_grid(s, d), "mask", lambda a: erode(a > 0, 1, True).astype(float))),
    "r03_components": lambda s, d: blobs(_grid(s, d)).groupBy("tile_id").agg(F.count_distinct("blob").alias("n_blobs"), F.count("*").alias("n")),
    "r04_large_blobs": lambda s, d: blobs(_grid(s, d), least=4).groupBy("tile_id", "blob").agg(F.count("*").alias("area")),
    "r05_blob_records": lambda s, d: blob_records(_grid(s, d), 4).select("tile_id", "blob", "area", F.round("mean_score", 6).alias("mean_score"), "max_score"),
    "r06_object_matching": lambda s, d: object_counts(_grid(s, d)),
    "r07_boundary_ignore": lambda s, d: per_tile(_grid(s, d), "label", lambda a: boundary_ignore(a, 1), "double").groupBy("tile_id").agg(F.count_if(F.col("out") == IGNORE).alias("n_ignored"), F.count_if(F.col("out") == 1).alias("n_target")),
    "r08_boundary_band": lambda s, d: _count(per_tile(_grid(s, d), "label", lambda a: boundary_band(a, 1).astype(float))),
    "r09_regimes": lambda s, d: regimes(_grid(s, d).withColumn("band", F.col("mask"))).groupBy("tile_id", "regime").agg(F.count("*").alias("n"), F.sum("v").alias("total")),
    "r10_focal_mean": lambda s, d: per_tile(_grid(s, d), "v", lambda a: focal_mean(a, 3)).select("tile_id", "row", "col", F.round("out", 6).alias("mean")),
    "r11_laplacian": lambda s, d: per_tile(_grid(s, d), "v", lambda a: terrain(a, 1.0)["laplacian"]).select("tile_id", "row", "col", F.round("out", 6).alias("laplacian")),
    "r11_slope": lambda s, d: per_tile(_grid(s, d), "v", lambda a: terrain(a, 1.0)["slope"]).groupBy("tile_id").agg(F.round(F.avg("out"), 6).alias("slope")),
    "r12_shaded_relief": lambda s, d: per_tile(_grid(s, d), "v", lambda a: shaded_relief(terrain(a, 1.0)["hillshade"], terrain(a, 1.0)["laplacian"])).groupBy("tile_id").agg(F.round(F.avg("out"), 6).alias("relief")),
    "r13_flip_average": lambda s, d: per_tile(_grid(s, d), "v", lambda a: augmented_mean(lambda x: x * (np.arange(x.shape[1]) + 1), a, "standard")).select("tile_id", "row", "col", F.round("out", 6).alias("mean")),
    "r14_half_scale": lambda s, d: per_tile(_grid(s, d), "v", lambda a: resample(resample(a, SIDE // 2, SIDE // 2), SIDE, SIDE)).select("tile_id", "row", "col", F.round("out", 6).alias("v")),
    "r16_channel_stack": lambda s, d: _grid(s, d).select("tile_id", "row", "col", F.array("v", "score", F.col("mask").cast("double")).alias("stack")).select("tile_id", "row", "col", F.col("stack")[1].alias("second")),
    "r17_weighted_fusion": lambda s, d: _fused(s, d, "weighted_mean"),
    "r18_max_fusion": lambda s, d: _fused(s, d, "max"),
    "r18_consensus_fusion": lambda s, d: _fused(s, d, "consensus"),
    "r19_scale_mean": lambda s, d: _grid(s, d).select("tile_id", "row", "col", F.round(scale_mean(F.when(F.col("v") > 3, F.col("score")), F.when(F.col("v") > 8, F.col("score") / 2)), 6).alias("p")),
    "r20_nodata": lambda s, d: fill_nodata(_grid(s, d), "v", (F.col("v") == 0) | (F.col("tile_id") % 9 == 0), F.lit(8.0)).groupBy("tile_id", "status").agg(F.sum("v").alias("total")),
    "r21_vectors": lambda s, d: blob_records(_grid(s, d), 6).select("tile_id", "blob", F.round("row", 6).alias("row"), F.round("col", 6).alias("col")),
    "r22_tile_errors": _errors,
    "r23_label_semantics": lambda s, d: _grid(s, d).groupBy("tile_id").agg(F.count_if(F.col("label") == 1).alias("n1")).select("tile_id", F.when(F.col("tile_id") % 2 == 0, F.col("n1") > 0).otherwise(F.col("n1") == 0).alias("ok")),
    "r24_mosaic": lambda s, d: mosaic(_grid(s, d).withColumn("grow", F.col("row") + F.floor(F.col("tile_id") / 10) * SIDE).withColumn("gcol", F.col("col") + F.col("tile_id") % 10 * 8), "tile_id", "v").select(F.col("grow").cast("long").alias("grow"), F.col("gcol").cast("long").alias("gcol"), "v"),
    "r25_reclassify": lambda s, d: _grid(s, d).select("tile_id", "row", "col", F.when((F.col("v") > 0) & (F.col("v") <= 5), 1).alias("cls")),
    "r26_crop": lambda s, d: per_tile(_grid(s, d), "v", lambda a: crop(a, 9, 2, 8)).select("tile_id", "row", "col", "out"),
    "r25_reclassify_in_domain": lambda s, d: clip(_grid(s, d), _grid(s, d).filter(F.col("label") != IGNORE)).select("tile_id", "row", "col", F.when((F.col("v") > 0) & (F.col("v") <= 5), 1).alias("cls")),
    "a29_block_any_by_tile": lambda s, d: block_any(_grid(s, d).withColumn("v", F.col("mask")), 4, "tile_id"),
    "a29_block_any": lambda s, d: block_any(_mosaicked(s, d), 5),
    "j16_blob_overlap": lambda s, d: blobs(_grid(s, d)).join(blobs(_grid(s, d).withColumn("mask", (F.col("label") == 1).cast("int"))).withColumnRenamed("blob", "truth").hint("merge"), ["tile_id", "row", "col"]).groupBy("tile_id", "blob", "truth").agg(F.count("*").alias("n")).groupBy("tile_id").agg(F.sum("n").alias("n")),
    "s06_window_read": _windows,
}
BLOBS = f"""WITH RECURSIVE {GRID}, m AS (SELECT tile_id, row, col, v FROM grid WHERE mask = 1), reach AS (SELECT tile_id, row AS r0, col AS c0, row, col FROM m
  UNION SELECT a.tile_id, a.r0, a.c0, b.row, b.col FROM reach a JOIN m b ON a.tile_id = b.tile_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
  c AS (SELECT r.tile_id, r.row, r.col, min(r0 * {SIDE} + c0) AS root, any_value(m.v) AS v FROM reach r JOIN m ON m.tile_id = r.tile_id AND m.row = r.row AND m.col = r.col GROUP BY 1, 2, 3)"""
LARGE = "b AS (SELECT tile_id, root, count(*) AS area, row_number() OVER (PARTITION BY tile_id ORDER BY root)::INT AS blob FROM c GROUP BY 1, 2 HAVING count(*) >= {least})"
_edge = lambda a, n: f"greatest(0, least({n}, {a}))"
FOC = f"""WITH {GRID}, p AS (SELECT g.tile_id, g.row, g.col, o.v FROM grid g, (SELECT unnest(range(-1, 2)) AS i) x, (SELECT unnest(range(-1, 2)) AS j) y, grid o
  WHERE o.tile_id = g.tile_id AND o.row = {_edge('g.row + i', SIDE - 1)} AND o.col = {_edge('g.col + j', SIDE - 1)})"""
SLOPE = f"""WITH {GRID}, q AS (SELECT g.tile_id, g.row, g.col, i, j, o.v FROM grid g, (SELECT unnest(range(-1, 2)) AS i) x, (SELECT unnest(range(-1, 2)) AS j) y, grid o
  WHERE o.tile_id = g.tile_id AND o.row = {_edge('g.row + i', SIDE - 1)} AND o.col = {_edge('g.col + j', SIDE - 1)}),
  d AS (SELECT tile_id, row, col, sum(v * j * CASE i WHEN 0 THEN 2 ELSE 1 END) / 8 AS dx, sum(v * i * CASE j WHEN 0 THEN 2 ELSE 1 END) / 8 AS dy, sum(v) - 9 * sum(v) FILTER (i = 0 AND j = 0) AS lap FROM q GROUP BY 1, 2, 3)"""
_flood = lambda a, where: f"""{a}m AS (SELECT tile_id, row, col, v / 16 AS s FROM grid WHERE {where}), {a}r AS (SELECT tile_id, row AS r0, col AS c0, row, col FROM {a}m
  UNION SELECT a.tile_id, a.r0, a.c0, b.row, b.col FROM {a}r a JOIN {a}m b ON a.tile_id = b.tile_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1), {a}c AS (SELECT tile_id, row, col, min(r0 * {SIDE} + c0) AS {a} FROM {a}r GROUP BY 1, 2, 3)"""  # noqa: E731
MATCHED = f"""{_flood('p', 'v / 16 >= 0.5 AND label <> 255')}, {_flood('t', 'label = 1')},
      po AS (SELECT tile_id, p, count(*) AS n, row_number() OVER (PARTITION BY tile_id ORDER BY avg(s) DESC, p) AS i FROM pc JOIN pm USING (tile_id, row, col) GROUP BY 1, 2 HAVING count(*) >= 4),
      ts AS (SELECT tile_id, t, count(*) AS m FROM tc GROUP BY 1, 2),
      iou AS (SELECT tile_id, i, t, count(*)::DOUBLE / (any_value(n) + any_value(m) - count(*)) AS u FROM po JOIN pc USING (tile_id, p) JOIN tc USING (tile_id, row, col) JOIN ts USING (tile_id, t) GROUP BY 1, 2, 3 HAVING u >= 0.3),
      cnt AS (SELECT tile_id, (SELECT count(*) FROM po WHERE po.tile_id = g.tile_id) AS k, (SELECT count(*) FROM ts WHERE ts.tile_id = g.tile_id) AS m FROM (SELECT DISTINCT tile_id FROM grid) g),
      step AS (SELECT tile_id, 0::BIGINT AS i, []::BIGINT[] AS used FROM cnt UNION ALL
        SELECT s.tile_id, s.i + 1, CASE WHEN count(x.t) = 0 THEN any_value(s.used) ELSE list_append(any_value(s.used), arg_max(x.t, x.u * 1e6 - x.t * 1e-6)) END
        FROM step s JOIN cnt c ON c.tile_id = s.tile_id AND s.i < c.k LEFT JOIN iou x ON x.tile_id = s.tile_id AND x.i = s.i + 1 AND NOT list_contains(s.used, x.t) GROUP BY s.tile_id, s.i),
      matched AS (SELECT tile_id, len(used)::BIGINT AS tp, k - len(used)::BIGINT AS fp, m - len(used)::BIGINT AS fn FROM step JOIN cnt USING (tile_id) WHERE i = k)"""
SQL = {
    "r06_object_matching": f"WITH RECURSIVE {GRID}, {MATCHED} SELECT * FROM matched",
    "r01_rasterize": """WITH t AS (SELECT n_nationkey::BIGINT AS tile_id, r + 0.5 AS y0, c + 0.5 AS x FROM nation, range(16) a(r), range(16) b(c)), p AS (SELECT tile_id, x, 16 - y0 AS y, tile_id % 5 AS k FROM t),
      l AS (SELECT tile_id, CASE WHEN tile_id % 4 <> 3 AND x > 2 + k AND x < 9 + k AND y > 2 + k AND y < 9 + k THEN 1 WHEN x > 1 AND x < 6 AND y > 1 AND y < 6 THEN 255 ELSE 0 END AS label FROM p) SELECT tile_id, label, count(*) AS n FROM l WHERE tile_id % 4 <> 3 GROUP BY 1, 2""",
    "r02_dilate": f"WITH {GRID}, m AS ({AROUND.format(f='max(b.mask)', near=FOUR)}) SELECT tile_id, count(*) AS n FROM m WHERE x = 1 GROUP BY 1",
    "r02_erode_eight": f"WITH {GRID}, m AS ({AROUND.format(f='sum(b.mask)', near=NINE)}) SELECT tile_id, count(*) AS n FROM m WHERE x = 9 GROUP BY 1",
    "r07_boundary_ignore": f"WITH {GRID}, m AS (SELECT a.tile_id, a.row, a.col, any_value(a.label) AS label, max((b.label = 1)::INT) AS d, sum((b.label = 1)::INT) = 5 AS e FROM grid a LEFT JOIN grid b ON a.tile_id = b.tile_id AND {FOUR} GROUP BY 1, 2, 3), o AS (SELECT tile_id, CASE WHEN (d = 1) <> e THEN 255 ELSE label END AS l FROM m) SELECT tile_id, count(*) FILTER (l = 255) AS n_ignored, count(*) FILTER (l = 1) AS n_target FROM o GROUP BY 1",
    "r08_boundary_band": f"WITH {GRID}, m AS (SELECT a.tile_id, a.row, a.col, max((b.label = 1)::INT) AS d, sum((b.label = 1)::INT) = 9 AS e FROM grid a LEFT JOIN grid b ON a.tile_id = b.tile_id AND {NINE} GROUP BY 1, 2, 3) SELECT tile_id, count(*) AS n FROM m WHERE d = 1 AND NOT e GROUP BY 1",
    "r09_regimes": f"WITH {GRID} SELECT tile_id, 'all' AS regime, count(*) AS n, sum(v) AS total FROM grid GROUP BY 1 UNION ALL SELECT tile_id, 'positive', count(*), sum(v) FROM grid WHERE label = 1 GROUP BY 1 UNION ALL SELECT tile_id, 'boundary', count(*), sum(v) FROM grid WHERE mask = 1 GROUP BY 1",
    "r10_focal_mean": f"{FOC} SELECT tile_id, row, col, round(sum(v) / 9, 6) AS mean FROM p GROUP BY 1, 2, 3",
    "r11_laplacian": f"{FOC} SELECT tile_id, row, col, round(sum(p.v) - 9 * any_value(g.v), 6) AS laplacian FROM p JOIN grid g USING (tile_id, row, col) GROUP BY 1, 2, 3",
    "r13_flip_average": f"WITH {GRID} SELECT tile_id, row, col, round(v * {SIDE + 1} / 2, 6) AS mean FROM grid",
    "r16_channel_stack": f"WITH {GRID} SELECT tile_id, row, col, v / 16 AS second FROM grid",
    "r17_weighted_fusion": f"{PLACED} SELECT grow, gcol, round(sum(w * p) / sum(w), 6) AS p FROM g GROUP BY 1, 2",
    "r18_max_fusion": f"{PLACED} SELECT grow, gcol, round(max(p), 6) AS p FROM g GROUP BY 1, 2",
    "r18_consensus_fusion": f"{PLACED} SELECT grow, gcol, round(min(p), 6) AS p FROM g GROUP BY 1, 2",
    "r19_scale_mean": f"WITH {GRID} SELECT tile_id, row, col, round(CASE WHEN v > 8 THEN (v / 16 + v / 32) / 2 WHEN v > 3 THEN v / 16 ELSE -1 END, 6) AS p FROM grid",
    "r20_nodata": f"WITH {GRID} SELECT tile_id, CASE WHEN bool_and(v = 0 OR tile_id % 9 = 0) THEN 'skip' WHEN bool_or(v = 0 OR tile_id % 9 = 0) THEN 'partial' ELSE 'full' END AS status, sum(CASE WHEN v = 0 OR tile_id % 9 = 0 THEN 8 ELSE v END)::DOUBLE AS total FROM grid GROUP BY tile_id",
    "r22_tile_errors": f"WITH {GRID}, p AS (SELECT tile_id, count(*) FILTER (label = 1) AS n1, bool_or(label NOT IN (0, 1)) AS bad FROM grid GROUP BY 1) SELECT tile_id, 'labels outside 0 and 1' AS error FROM p WHERE bad UNION ALL SELECT tile_id, 'no target' FROM p WHERE n1 <= 50",
    "r23_label_semantics": f"WITH {GRID} SELECT tile_id, CASE WHEN tile_id % 2 = 0 THEN count(*) FILTER (label = 1) > 0 ELSE count(*) FILTER (label = 1) = 0 END AS ok FROM grid GROUP BY 1",
    "r24_mosaic": f"WITH {GRID} SELECT row + tile_id // 10 * {SIDE} AS grow, col + tile_id % 10 * 8 AS gcol, arg_max(v, tile_id) AS v FROM grid GROUP BY 1, 2",
    "r25_reclassify": f"WITH {GRID} SELECT tile_id, row, col, CASE WHEN v > 0 AND v <= 5 THEN 1 END AS cls FROM grid",
    "r25_reclassify_in_domain": f"WITH {GRID} SELECT tile_id, row, col, CASE WHEN v > 0 AND v <= 5 THEN 1 END AS cls FROM grid WHERE label <> 255",
    "r26_crop": f"WITH {GRID} SELECT t.tile_id, r::INT AS row, c::INT AS col, coalesce(v, 0) AS out FROM (SELECT DISTINCT tile_id FROM grid) t CROSS JOIN range(8) a(r) CROSS JOIN range(8) b(c) LEFT JOIN grid g ON g.tile_id = t.tile_id AND g.row = r + 5 AND g.col = c",
    "a29_block_any": f"WITH {GRID} SELECT ((row + tile_id // 10 * {SIDE}) // 5)::BIGINT AS brow, ((col + tile_id % 10 * {SIDE}) // 5)::BIGINT AS bcol, max(CASE WHEN v >= 15 THEN 1 END) AS v FROM grid GROUP BY 1, 2",
    "a29_block_any_by_tile": f"WITH {GRID} SELECT tile_id, (row // 4)::BIGINT AS brow, (col // 4)::BIGINT AS bcol, max(CASE WHEN mask = 1 THEN 1 END) AS v FROM grid GROUP BY 1, 2, 3",
    "r03_components": f"{BLOBS} SELECT tile_id, count(DISTINCT root) AS n_blobs, count(*) AS n FROM c GROUP BY 1",
    "r04_large_blobs": f"{BLOBS}, {LARGE.format(least=4)} SELECT tile_id, blob, area FROM b",
    "r05_blob_records": f"{BLOBS}, {LARGE.format(least=4)} SELECT tile_id, blob, any_value(area) AS area, round(avg(v / 16), 6) AS mean_score, max(v / 16) AS max_score FROM b JOIN c USING (tile_id, root) GROUP BY 1, 2",
    "r21_vectors": f"{BLOBS}, {LARGE.format(least=6)} SELECT tile_id, blob, round(avg(row), 6) AS row, round(avg(col), 6) AS col FROM b JOIN c USING (tile_id, root) GROUP BY 1, 2",
    "r11_slope": f"{SLOPE} SELECT tile_id, round(avg(degrees(atan(sqrt(dx * dx + dy * dy)))), 6) AS slope FROM d GROUP BY 1",
    "r12_shaded_relief": f"""{SLOPE}, h AS (SELECT tile_id, lap, atan(sqrt(dx * dx + dy * dy)) AS s, atan2(-dx, dy) AS a FROM d),
      x AS (SELECT tile_id, lap, greatest(0, least(255, 255 * (cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians(315) - a)))) AS hs FROM h),
      p AS (SELECT tile_id, quantile_cont(hs, 0.02) AS h0, quantile_cont(hs, 0.98) AS h1, quantile_cont(lap, 0.02) AS l0, quantile_cont(lap, 0.98) AS l1 FROM x GROUP BY 1)
      SELECT tile_id, round(avg(0.7::DOUBLE * greatest(0, least(1, (hs - h0) / (h1 - h0))) + 0.3::DOUBLE * greatest(0, least(1, (lap - l0) / (l1 - l0)))), 6) AS relief FROM x JOIN p USING (tile_id) GROUP BY 1""",
    "r14_half_scale": f"""WITH {GRID}, h AS (SELECT tile_id, row // 2 AS r, col // 2 AS c, avg(v) AS m FROM grid GROUP BY 1, 2, 3),
      w(k, near, far, a, b) AS (VALUES {", ".join(f"({k}, {min(max(k // 2, 0), SIDE // 2 - 1)}, {min(max(k // 2 + (1 if k % 2 else -1), 0), SIDE // 2 - 1)}, 0.75::DOUBLE, 0.25::DOUBLE)" for k in range(SIDE))}),
      ax AS (SELECT k, near AS at, a AS w FROM w UNION ALL SELECT k, far, b FROM w)
      SELECT tile_id, y.k::INT AS row, x.k::INT AS col, round(sum(m * y.w * x.w), 6) AS v FROM ax y, ax x, h WHERE h.r = y.at AND h.c = x.at GROUP BY 1, 2, 3""",
    "j16_blob_overlap": f"WITH {GRID} SELECT tile_id, count(*)::BIGINT AS n FROM grid WHERE mask = 1 AND label = 1 GROUP BY 1",
    "s06_window_read": """WITH b AS (SELECT p_partkey, p_partkey % 900 AS x0, p_partkey % 700 AS y0, p_partkey % 900 + p_size * 11 AS x1, p_partkey % 700 + 40 AS y1 FROM part)
      SELECT p_partkey, CASE WHEN x1 - x0 <= 512 THEN greatest(0, least(floor((y0 + y1) / 2 - 256)::INT, 488)) END AS row, CASE WHEN x1 - x0 <= 512 THEN greatest(0, least(floor((x0 + x1) / 2 - 256)::INT, 688)) END AS col FROM b""",
}
