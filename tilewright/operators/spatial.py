"""Spatial joins: points in polygons, nearest regions and features, grid cells, box overlaps.

Both sides of a join are dealt out by the cells of a grid that they touch, so a point meets only what is near it. Nearest joins widen
the cells for the points that haven't found theirs; only few candidates, counted before, are held in each task instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

HELD, HELD_POINTS = 1000, 20_000  # candidates, and their polygons' points, that each task may hold
WIDER, CROWDED = 8, 64
TASK_POINTS, BLOCK = 20_000, 1 << 18  # points of a task; distances that it holds at once
#: Held candidates to a function of arrays x and y: (place of the nearest, its distance).
Distances = Callable[[list[dict]], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed or open ring of [x, y] points, by counting crossings of a ray to the right."""
    n = F.size(ring)
    nexts = F.concat(F.slice(ring, 2, n - 1), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nexts, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in none of the holes."""
    return in_ring(x, y, rings[0]) & ~F.exists(F.slice(rings, 2, F.size(rings)), lambda r: in_ring(x, y, r))


def with_bounds(df: DataFrame, rings: str = "rings") -> DataFrame:
    """df with min_x, min_y, max_x, max_y of the outer ring."""
    xs, ys = F.transform(F.col(rings)[0], lambda p: p[0]), F.transform(F.col(rings)[0], lambda p: p[1])
    return df.withColumn("min_x", F.array_min(xs)).withColumn("max_x", F.array_max(xs)).withColumn("min_y", F.array_min(ys)).withColumn("max_y", F.array_max(ys))


def cells_of(df: DataFrame, size: float) -> DataFrame:
    """A row of df for each grid cell (cx, cy) that its bounds touch."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return df.withColumn("cx", span("min_x", "max_x")).withColumn("cy", span("min_y", "max_y"))


def within(points: DataFrame, polygons: DataFrame, key: str, name: str, cell: float = 1.0) -> DataFrame:
    """points (key, x, y, ...) with the least name of the polygons (name, rings) that hold them, else null, as where x or y is null or NaN."""
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    q = cells_of(with_bounds(polygons.select(name, "rings")), cell)
    hits = p.join(q, ["cx", "cy"]).filter(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")) & in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    return points.join(hits.groupBy(key).agg(F.min(name).alias(name)), key, "left")


def _nearest(points: DataFrame, candidates: DataFrame, key: str, name: str, distance: Column, own: tuple[str, ...]) -> DataFrame:
    """(key, name, dist): of the candidates (name, min_x, max_x, min_y, max_y and the columns `own`) the nearest to each point (key, x, y)
    by `distance`, ties to the least name; none: null.

    A point looks at the candidates that touch the nine cells around it; what isn't there is a cell's width away at least. Points
    whose best is farther than that go on with cells WIDER times as wide, until the nine cells hold everything. The first cells
    hold few candidates each (CROWDED, unless polygons are larger than such cells), so a point with a candidate nearby meets few. One
    that is far from all meets those of ever wider cells.
    """
    best = F.struct(F.col("_d").alias("dist"), F.col(name))
    e = candidates.agg(F.count("*").alias("n"), F.min("min_x").alias("x0"), F.max("max_x").alias("x1"), F.min("min_y").alias("y0"), F.max("max_y").alias("y1"), F.greatest(F.avg(F.col("max_x") - F.col("min_x")), F.avg(F.col("max_y") - F.col("min_y"))).alias("side")).first()
    p = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    state = points.select(key, "x", "y", F.lit(None).cast(f"struct<dist:double,{name}:{candidates.schema[name].dataType.simpleString()}>").alias("_best"))
    if e.n and e.x0 is not None and p.x0 is not None:
        width, height = e.x1 - e.x0, e.y1 - e.y0
        reach = max(max(e.x1, p.x1) - min(e.x0, p.x0), max(e.y1, p.y1) - min(e.y0, p.y0))
        cell = max(2 * (width * height / e.n) ** 0.5, e.side, max(width, height) / 1e6) or 1.0
        while cell / WIDER > max(e.side, reach / 1e9) and cells_of(candidates, cell).groupBy("cx", "cy").count().filter(F.col("count") > CROWDED).limit(1).count():
            cell /= WIDER  # candidates lie in clusters
        while True:
            around = F.array(*(F.struct((F.floor(F.col("x") / cell) + i).alias("cx"), (F.floor(F.col("y") / cell) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
            none = F.array(F.lit(None).cast("struct<cx:bigint,cy:bigint>"))
            # points that have found theirs meet nothing more
            looks = state.withColumn("_c", F.explode(F.when(F.col("_best").isNull() | (F.col("_best.dist") >= cell / WIDER), around).otherwise(none)))
            near = cells_of(candidates, cell).select(name, *own, F.struct("cx", "cy").alias("_cell"))
            met = looks.join(near, F.col("_c") == F.col("_cell"), "left").withColumn("_d", F.when(F.col("_cell").isNotNull(), distance))
            state = met.groupBy(key, "x", "y").agg(F.min(F.when(F.col("_d").isNotNull(), best)).alias("_new"), F.min("_best").alias("_old"))
            state = state.select(key, "x", "y", F.coalesce("_new", "_old").alias("_best"))
            if cell > reach:
                break
            cell *= WIDER
    out = state.groupBy(key).agg(F.min("_best").alias("_b"))
    return out.select(key, F.col(f"_b.{name}").alias(name), F.col("_b.dist").alias("dist"))


def _held(points: DataFrame, candidates: DataFrame, key: str, name: str, distances: Distances) -> DataFrame:
    """The same by comparing each point with all of a few candidates, which each task holds: (points, candidates) blocks of distances in
    numpy. Points are dealt out, as a small file of them comes as one part. Without candidates there are no rows."""
    held = candidates.orderBy(name).toArrow()  # HELD at most; the first of equal distances has the least name
    names, measure = held.column(name).combine_chunks(), distances(held.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if len(names) else ():
            x, y = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
            at, dist = measure(x, y)
            none = np.isnan(x) | np.isnan(y) | np.isnan(dist)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(at, mask=none)), pa.array(dist, mask=none)], names=[key, name, "dist"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((points, key), (candidates, name))]
    p = schema.dealt(points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), TASK_POINTS, key)
    found = p.mapInArrow(run, ", ".join([*kinds, "dist double"]))
    best = found.groupBy(key).agg(F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", name))).alias("b"))
    return best.select(key, F.col(f"b.{name}").alias(name), F.col("b.dist").alias("dist"))


def _blocks(x: np.ndarray, y: np.ndarray, width: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the least distance, the distance) of each point, for blocks of points such that some BLOCK numbers are held; NaN counts as farthest."""
    at, best, step = np.zeros(len(x), np.int64), np.zeros(len(x)), max(1, BLOCK // max(width, 1))
    with np.errstate(all="ignore"):
        for s in range(0, len(x), step):
            d = distance(x[s : s + step, None], y[s : s + step, None])
            k = np.where(np.isnan(d), np.inf, d).argmin(1)
            at[s : s + step], best[s : s + step] = k, d[np.arange(len(k)), k]
    return at, best


def _to_centres(held: list[dict]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    cx, cy = (np.array([c[k] for c in held], np.float64) for k in ("_x", "_y"))
    return lambda x, y: _blocks(x, y, len(cx), lambda x, y: np.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)))


def _to_polygons(held: list[dict]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Distances to the edges of all rings laid end to end, 0 where the first ring holds the point and no other one does."""
    gap = [[None, None]]  # of a ring without points; NaN is near to nothing and crossed by nothing
    rings = [[np.array(r or gap, np.float64).reshape(-1, 2) for r in c["rings"] or [gap]] for c in held]
    flat = [r for rs in rings for r in rs]
    first = np.cumsum([0, *(len(r) for r in flat[:-1])])  # edges of each ring
    outer = np.cumsum([0, *(len(rs) for rs in rings[:-1])])  # rings of each polygon
    (x1, y1), (x2, y2) = (np.concatenate(p).T if flat else np.zeros((2, 0)) for p in (flat, [np.roll(r, -1, 0) for r in flat]))
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t = np.clip(np.where(square != 0, ((x - x1) * dx + (y - y1) * dy) / square, 0.0), 0.0, 1.0)
        ex, ey = x1 + t * dx - x, y1 + t * dy - y
        edge = np.fmin.reduceat(np.fmin.reduceat(np.sqrt(ex * ex + ey * ey), first, 1), outer, 1)
        crossed = ((y1 > y) != (y2 > y)) & (x < dx * (y - y1) / dy + x1)
        odd = np.add.reduceat(crossed, first, 1, np.int64) % 2
        return np.where((odd[:, outer] == 1) & (np.add.reduceat(odd, outer, 1) == 1), 0.0, edge)

    return lambda x, y: _blocks(x, y, len(x1), distance)


def _placed(points: DataFrame) -> DataFrame:
    """Points without a place, whose x or y is null or NaN, have none in either; they are near to nothing."""
    there = ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double"))
    return points.withColumn("x", F.when(there, F.col("x"))).withColumn("y", F.when(there, F.col("y")))


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, dist): the centroid (name, cx, cy) nearest to each point (key, x, y), ties to the least name; null for a point whose x or
    y is null or NaN."""
    c = centroids.groupBy(F.col("cx").cast("double").alias("_x"), F.col("cy").cast("double").alias("_y")).agg(F.min(name).alias(name))
    d = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    points = _placed(points)
    if c.limit(HELD + 1).count() <= HELD:
        return _held(points, c, key, name, _to_centres)
    boxes = c.select("*", F.col("_x").alias("min_x"), F.col("_x").alias("max_x"), F.col("_y").alias("min_y"), F.col("_y").alias("max_y"))
    return _nearest(points, boxes, key, name, d, ("_x", "_y"))


def segment_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to the nearest edge of a ring."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))

    def one(a: Column, b: Column) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a[0]) * dx + (y - a[1]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.sqrt(F.pow(a[0] + t * dx - x, 2) + F.pow(a[1] + t * dy - y, 2))

    return F.array_min(F.zip_with(ring, nexts, one))


def nearest_feature(points: DataFrame, polygons: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, dist): the polygon nearest to each point, 0 inside; in a hole, as outside, the distance to the nearest edge of any ring.
    Null for a point whose x or y is null or NaN."""
    points = _placed(points)
    edge = F.array_min(F.transform("rings", lambda r: segment_distance(F.col("x"), F.col("y"), r)))
    d = F.when(in_polygon(F.col("x"), F.col("y"), F.col("rings")), 0.0).otherwise(edge)
    c = polygons.select(name, "rings")
    n = c.limit(HELD + 1).agg(F.count("*").alias("n"), F.sum(F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))).alias("points")).first()
    if n.n <= HELD and (n.points or 0) <= HELD_POINTS:
        return _held(points, c, key, name, _to_polygons)
    return _nearest(points, with_bounds(c), key, name, d, ("rings",))


def region_of(points: DataFrame, polygons: DataFrame, centroids: DataFrame, key: str, name: str, cell: float = 1.0) -> DataFrame:
    """The polygon that holds a point, else the nearest centroid."""
    inside = within(points, polygons, key, name, cell)
    rest = nearest_centroid(inside.filter(F.col(name).isNull()).drop(name), centroids, key, name)
    return inside.filter(F.col(name).isNotNull()).select(key, name).unionByName(rest.select(key, name))


def covering_cell(points: DataFrame, grid: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, grid, contained): of the grid boxes (grid, min_x, ...) near a point, one that holds it, else the nearest; ties to the first."""
    p = schema.dealt(points, TASK_POINTS, key).withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    p = p.withColumn("_dx", near).withColumn("_dy", near).withColumn("cx", F.col("_cx") + F.col("_dx")).withColumn("cy", F.col("_cy") + F.col("_dy"))
    both = p.join(cells_of(grid, cell), ["cx", "cy"])
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    gap = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.lit(0.0), F.col(v) - F.col(b))
    dist = F.sqrt(F.pow(gap("x", "min_x", "max_x"), 2) + F.pow(gap("y", "min_y", "max_y"), 2))
    best = both.groupBy(key).agg(F.min(F.struct((~inside).alias("out"), dist.alias("dist"), F.col("grid"))).alias("b"))
    return best.select(key, "b.grid", (~F.col("b.out")).alias("contained"))


def boxes_hit(boxes: DataFrame, polygons: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """The boxes (key, min_x, ...) that some polygon's bounds overlap and that share a point with it: a corner in the polygon, a
    vertex in the box, or an edge through it, those of holes included. A box that lies in a hole is missed by all three."""
    q = cells_of(with_bounds(polygons.select("rings")), cell).select("rings", "cx", "cy", *(F.col(c).alias(f"p_{c}") for c in ("min_x", "min_y", "max_x", "max_y")))
    c = {k: F.col(k) for k in ("min_x", "min_y", "max_x", "max_y")}
    overlap = (c["min_x"] <= F.col("p_max_x")) & (c["max_x"] >= F.col("p_min_x")) & (c["min_y"] <= F.col("p_max_y")) & (c["max_y"] >= F.col("p_min_y"))
    corner = in_polygon(c["min_x"], c["min_y"], F.col("rings")) | in_polygon(c["max_x"], c["max_y"], F.col("rings")) | in_polygon(c["min_x"], c["max_y"], F.col("rings")) | in_polygon(c["max_x"], c["min_y"], F.col("rings"))
    vertex = F.exists("rings", lambda r: F.exists(r, lambda p: p[0].between(c["min_x"], c["max_x"]) & p[1].between(c["min_y"], c["max_y"])))
    nexts = lambda r: F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
    side = lambda a, b, x, y: F.signum((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]))

    def through(a: Column, b: Column) -> Column:
        s = [side(a, b, c[x], c[y]) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
        apart = (F.greatest(*s) < 0) | (F.least(*s) > 0)
        near = (F.least(a[0], b[0]) <= c["max_x"]) & (F.greatest(a[0], b[0]) >= c["min_x"]) & (F.least(a[1], b[1]) <= c["max_y"]) & (F.greatest(a[1], b[1]) >= c["min_y"])
        return ~apart & near

    edge = F.exists("rings", lambda r: F.exists(F.zip_with(r, nexts(r), through), lambda t: t))
    hits = cells_of(boxes, cell).join(q, ["cx", "cy"]).filter(overlap & (vertex | corner | edge)).select(key).distinct()
    return boxes.join(hits, key, "left_semi")


def zonal_mean(pixels: DataFrame, polygons: DataFrame, name: str, value: str, cell: float = 16.0) -> DataFrame:
    """(name, mean, n): the mean over pixels (x, y, value) within each polygon, null if there is none."""
    q = cells_of(with_bounds(polygons.select(name, "rings")), cell)
    p = pixels.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    hits = p.join(q, ["cx", "cy"]).filter(in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    return polygons.select(name).join(hits.groupBy(name).agg(F.avg(value).alias("mean"), F.count("*").alias("n")), name, "left").fillna(0, ["n"])


def sphere_area(ring: Column, radius: float = 6371008.8) -> Column:
    """Area of a ring of [lon, lat] on the sphere, in square metres."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    part = F.zip_with(ring, nexts, lambda a, b: F.radians(b[0] - a[0]) * (2 + F.sin(F.radians(a[1])) + F.sin(F.radians(b[1]))))
    return F.abs(F.aggregate(part, F.lit(0.0), lambda s, x: s + x)) * radius * radius / 2


def realign(values: DataFrame, inputs: DataFrame) -> DataFrame:
    """The inputs (idx, ...) whose value came back, in their order."""
    return inputs.join(values, "idx").orderBy("idx")


# --- queries -------------------------------------------------------------------------------------------------------


def _pts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return schema.table(s, d, "customer").select(k.alias("id"), ((k * 7919) % 3600 / 100.0).alias("x"), ((k * 104729) % 2500 / 100.0).alias("y"), (k % 5).alias("cls"))


def _regions(s: SparkSession, d: str) -> DataFrame:
    """Rectangles with a gap to the right of each, by nation number, on a grid of five by five."""
    i, j = F.col("n_nationkey") % 5 * 7.2, F.floor(F.col("n_nationkey") / 5) * 5.0
    p = lambda x, y: F.array(x, y)
    ring = F.array(p(i, j), p(i + 6.0, j), p(i + 6.0, j + 4.0), p(i, j + 4.0), p(i, j))
    return schema.table(s, d, "nation").select(F.col("n_name").alias("region"), F.array(ring).alias("rings"), (i + 3.0).alias("cx"), (j + 2.0).alias("cy"))


def _centres(s, d):
    return _regions(s, d).select("region", "cx", "cy")


def _box(s, d):
    k = F.col("s_suppkey")
    x, y = (k * 37) % 360 / 10.0, (k * 53) % 250 / 10.0
    return schema.table(s, d, "supplier").select(k.alias("id"), (x * 1.0).alias("min_x"), (y * 1.0).alias("min_y"), (x + 0.5).alias("max_x"), (y + 0.5).alias("max_y"))


def _resume(s, d):
    from .catalog import resume

    p = _pts(s, d).select(F.col("id").alias("tile_id"), F.col("y").alias("centroid_lat"), F.col("x").alias("centroid_lon"))
    return resume(p, p.filter("tile_id % 3 = 0")).select("tile_id")


def _positive_distance(s, d):
    p = _pts(s, d)
    pos = p.filter("cls = 0").select(F.col("id").cast("string").alias("name"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return nearest_centroid(p.filter("cls > 0"), pos, "id", "name").select("id", F.round("dist", 6).alias("dist"))


QUERIES = {
    "j05_resume_anti_join": _resume,
    "j06_within_region": lambda s, d: within(_pts(s, d), _regions(s, d), "id", "region", 4.0).select("id", "region"),
    "j07_nearest_centroid": lambda s, d: nearest_centroid(_pts(s, d), _centres(s, d), "id", "region").select("id", "region", F.round("dist", 6).alias("dist")),
    "j08_nearest_feature": lambda s, d: nearest_feature(_pts(s, d), _regions(s, d), "id", "region").select("id", F.round("dist", 6).alias("dist")),
    "c18_within_then_nearest": lambda s, d: region_of(_pts(s, d), _regions(s, d), _centres(s, d), "id", "region", 4.0),
    "j09_covering_cell": lambda s, d: covering_cell(_pts(s, d), with_bounds(_regions(s, d)).select(F.col("region").alias("grid"), "min_x", "min_y", "max_x", "max_y"), "id", 8.0),
    "j10_boxes_hit": lambda s, d: boxes_hit(_box(s, d), _regions(s, d), "id", 4.0).select("id"),
    "j11_distance_to_positive": _positive_distance,
    "j11_distance_to_all_positives": _positive_distance,
    "j13_realigned_samples": lambda s, d: realign(schema.table(s, d, "supplier").filter("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("v")), schema.table(s, d, "supplier").select(F.col("s_suppkey").alias("idx"), "s_name")),
    "j14_provenance": lambda s, d: _pts(s, d).select(F.col("id").alias("idx"), F.struct("x", "y").alias("at")).join(schema.table(s, d, "supplier").select(F.col("s_suppkey").alias("idx")), "idx", "left_semi").select("idx", F.col("at.x").alias("x"), F.col("at.y").alias("y")),
    "a22_zonal_mean": lambda s, d: zonal_mean(_pts(s, d).withColumn("v", F.col("cls").cast("double")), _regions(s, d), "region", "v", 4.0).select("region", F.round("mean", 6).alias("mean"), "n"),
    "f39_sphere_area": lambda s, d: _regions(s, d).select("region", F.round(sphere_area(F.col("rings")[0]) / 1e6, 2).alias("km2")),
}
PTS = "pts AS (SELECT c_custkey AS id, (c_custkey * 7919) % 3600 / 100.0::DOUBLE AS x, (c_custkey * 104729) % 2500 / 100.0::DOUBLE AS y, c_custkey % 5 AS cls FROM customer), reg AS (SELECT n_name AS region, n_nationkey % 5 * 7.2::DOUBLE AS x0, floor(n_nationkey / 5) * 5.0::DOUBLE AS y0 FROM nation)"
IN = "x >= x0 AND x < x0 + 6 AND y >= y0 AND y < y0 + 4"
OUT = "sqrt(pow(greatest(x0 - x, 0, x - x0 - 6), 2) + pow(greatest(y0 - y, 0, y - y0 - 4), 2))"
INC = "(x BETWEEN x0 AND x0 + 6 AND y BETWEEN y0 AND y0 + 4)"
NEAR = "SELECT id, arg_min(region, d) AS region, min(d) AS dist FROM (SELECT id, region, (sqrt(pow(x - (x0 + 3), 2) + pow(y - (y0 + 2), 2)), region) AS d FROM pts, reg) GROUP BY 1"
SQL = {
    "j05_resume_anti_join": f"WITH {PTS}, k AS (SELECT id, round(x, 6) AS a, round(y, 6) AS b FROM pts) SELECT min(id) AS tile_id FROM k WHERE (a, b) NOT IN (SELECT (a, b) FROM k WHERE id % 3 = 0) GROUP BY a, b",
    "j06_within_region": f"WITH {PTS} SELECT id, min(region) AS region FROM pts LEFT JOIN reg ON {IN} GROUP BY 1",
    "j07_nearest_centroid": f"WITH {PTS}, n AS ({NEAR}) SELECT id, region, round(dist[1], 6) AS dist FROM n",
    "j08_nearest_feature": f"WITH {PTS} SELECT id, round(min({OUT}), 6) AS dist FROM pts, reg GROUP BY 1",
    "c18_within_then_nearest": f"WITH {PTS}, n AS ({NEAR}), w AS (SELECT id, min(region) AS w FROM pts LEFT JOIN reg ON {IN} GROUP BY 1) SELECT id, coalesce(w, region) AS region FROM w JOIN n USING (id)",
    "j09_covering_cell": f"WITH {PTS}, d AS (SELECT id, region, NOT {INC} AS o, {OUT} AS d FROM pts, reg WHERE floor(x / 8) + 1 >= floor(x0 / 8) AND floor(x / 8) - 1 <= floor((x0 + 6) / 8) AND floor(y / 8) + 1 >= floor(y0 / 8) AND floor(y / 8) - 1 <= floor((y0 + 4) / 8)), b AS (SELECT id, min((o, d, region)) AS b FROM d GROUP BY 1) SELECT id, b[3] AS grid, NOT b[1] AS contained FROM b",
    "j10_boxes_hit": f"WITH {PTS}, box AS (SELECT s_suppkey AS id, (s_suppkey * 37) % 360 / 10.0::DOUBLE AS x, (s_suppkey * 53) % 250 / 10.0::DOUBLE AS y FROM supplier) SELECT DISTINCT id FROM box, reg WHERE x <= x0 + 6 AND x + 0.5::DOUBLE >= x0 AND y <= y0 + 4 AND y + 0.5::DOUBLE >= y0",
    "j11_distance_to_positive": f"WITH {PTS} SELECT a.id, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS dist FROM pts a, pts b WHERE a.cls > 0 AND b.cls = 0 GROUP BY 1",
    "j13_realigned_samples": "SELECT s_suppkey AS idx, s_name, s_acctbal AS v FROM supplier WHERE s_suppkey % 4 <> 1 ORDER BY 1",
    "j14_provenance": f"WITH {PTS} SELECT id AS idx, x, y FROM pts WHERE id IN (SELECT s_suppkey FROM supplier)",
    "a22_zonal_mean": f"WITH {PTS} SELECT region, round(avg(cls::DOUBLE), 6) AS mean, count(id) AS n FROM reg LEFT JOIN pts ON {IN} GROUP BY 1",
    "f39_sphere_area": f"WITH {PTS} SELECT region, round(radians(6) * (sin(radians(y0 + 4)) - sin(radians(y0))) * 6371008.8::DOUBLE * 6371008.8::DOUBLE / 1e6, 2) AS km2 FROM reg",
}
SQL["j11_distance_to_all_positives"] = SQL["j11_distance_to_positive"]
