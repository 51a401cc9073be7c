"""Outlines: masks to polygons with holes, objects across tile seams, and grid cells dissolved to rings.

A region's outline is made of the unit sides that only one of its cells has, each with the region on the same hand, so that at every
corner point one side follows another; where two cells of a region meet at a point only, the outline keeps to its cell (with
`eight` it crosses). In one tile the sides are an array and its cycles are found by pointer jumping. Across tiles they are a table,
and the same jumps are joins: no task holds more than a tile or a share of the sides, however large a ring is.

Points are (x, y) = (column, row) of cell corners. Outer rings have a positive area by the usual formula, holes a negative one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from . import raster
from .links import components as linked
from .state_io import Kept

#: (dx, dy) of the four directions in which sides go: along the least y, the greatest x, the greatest y, the least x.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))
HALF = 1 << 29  # coordinates of cells lie between -HALF and HALF
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))

# Array cores.


def sides(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, direction, label) of the sides between a labelled cell and another label or none, by their first points."""
    p = np.pad(label, 1)
    here = p[1:-1, 1:-1]
    out = []
    for d, (around, dy, dx) in enumerate(((p[:-2, 1:-1], 0, 0), (p[1:-1, 2:], 0, 1), (p[2:, 1:-1], 1, 1), (p[1:-1, :-2], 1, 0))):
        y, x = np.nonzero((here > 0) & (here != around))
        out.append((y + dy, x + dx, np.full(len(y), d), here[y, x]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cycles(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least element of its cycle, steps from there) of each element of a permutation."""
    n = len(follow)
    least, jump = np.arange(n), follow
    while True:
        new = np.minimum(least, least[jump])
        if (new == least).all():
            break
        least, jump = new, jump[jump]
    root = least == np.arange(n)
    left, jump = np.where(root, 0, 1), np.where(root, np.arange(n), follow)
    while not root[jump].all():
        left, jump = left + left[jump], jump[jump]
    return least, np.where(root, 0, np.bincount(least, minlength=n)[least] - left)


def trace(label: np.ndarray, eight: bool = False) -> list[tuple[int, np.ndarray]]:
    """(label, closed ring of corner points) of each ring, a label's outer one first."""
    y, x, d, of = sides(label)
    if not len(y):
        return []
    wide = label.shape[1] + 1
    at = np.full((label.shape[0] + 1) * wide * 4, -1)
    at[(y * wide + x) * 4 + d] = np.arange(len(y))
    step = np.array(STEPS)[d]
    end = (y + step[:, 1]) * wide + x + step[:, 0]
    follow = np.full(len(y), -1)
    for turn in (3, 0, 1) if eight else (1, 0, 3):
        new = at[end * 4 + (d + turn) % 4]
        fits = (follow < 0) & (new >= 0)
        fits[fits] = of[new[fits]] == of[fits]
        follow[fits] = new[fits]
    least, place = cycles(follow)
    before = np.empty_like(follow)
    before[follow] = np.arange(len(follow))
    by = np.lexsort((place, least))
    by = by[d[before[by]] != d[by]]
    starts = np.flatnonzero(np.diff(least[by], prepend=-1))
    rings = []
    for ring in np.split(by, starts[1:]):
        points = np.stack([x[ring], y[ring]], 1)
        rings.append((int(of[ring[0]]), np.concatenate([points, points[:1]])))
    return sorted(rings, key=lambda r: (r[0], -area(r[1])))


def area(ring: np.ndarray) -> float:
    """Of a closed ring; negative for holes."""
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring: every point left out lies within `tolerance` of the line that replaces it. The first point and the one
    farthest from it stay; a ring that would be left with fewer than three corners stays as it is."""
    if tolerance <= 0 or len(ring) < 5:
        return ring
    p = ring.astype(float)
    far = int(np.hypot(*(p - p[0]).T).argmax())
    keep = np.zeros(len(p), bool)
    keep[[0, far, -1]] = True
    todo = [(0, far), (far, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, off = p[b] - p[a], p[a + 1 : b] - p[a]
        length = float(line @ line)
        t = np.clip(off @ line / length, 0, 1) if length else np.zeros(len(off))
        away = np.hypot(*(off - t[:, None] * line).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep] if keep.sum() >= 4 else ring


# Operators on tables.


def vectorize(df: DataFrame, mask: str = "mask", score: str | None = None, least: int = 1, eight: bool = False, tolerance: float = 0.0) -> DataFrame:
    """A polygon for each component of at least `least` pixels in each tile of df (tile_id, row, col, mask, score).

    (tile_id, blob, rings, area, perimeter, corners, holes, mean_score, max_score): rings are closed, the outer one first, simplified by
    `tolerance` pixels; the figures are those of the pixels. Blobs are numbered in reading order. Tiles without a blob give no row.
    """
    names = ["tile_id", "blob", "rings", "area", "perimeter", "corners", "holes", "mean_score", "max_score"]

    def run(x: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(x["row"].max()) + 1, int(x["col"].max()) + 1), bool)
        value = np.zeros(a.shape)
        a[x["row"], x["col"]] = x[mask].fillna(0) > 0
        value[x["row"], x["col"]] = x[score] if score else np.nan
        label = raster.components(raster.drop_small(a, least, eight), eight)
        n = np.bincount(label.ravel())
        mean = np.bincount(label.ravel(), value.ravel()) / np.maximum(n, 1)
        top = np.full(len(n), -np.inf)
        if score:
            np.maximum.at(top, label.ravel(), value.ravel())
        round_ = np.bincount(sides(label)[3], minlength=len(n))
        rows: dict[int, list] = {}
        for k, ring in trace(label, eight):
            rows.setdefault(k, []).append(ring)
        tile = x["tile_id"].iat[0]
        out = [(tile, k, [simplify(r, tolerance).astype(float).tolist() for r in rs], n[k], round_[k], sum(len(r) - 1 for r in rs), len(rs) - 1, mean[k], top[k]) for k, rs in rows.items()]
        return pd.DataFrame(out, columns=names)

    kind = df.schema["tile_id"].dataType.simpleString()
    columns = ["tile_id", "row", "col", mask] + [score] * bool(score)
    out = df.select(*columns).groupBy("tile_id").applyInPandas(run, f"tile_id {kind}, blob int, rings array<array<array<double>>>, area long, perimeter long, corners int, holes int, mean_score double, max_score double")
    return out if score else out.drop("mean_score", "max_score")


def to_map(rings: Column, transform: Column) -> Column:
    """Rings in pixels as rings on the map, by an affine (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f. Where it mirrors, as with
    rows that go down, the order of points is reversed, so outer rings keep a positive area."""
    t = [transform[k] for k in range(6)]
    moved = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(t[0] * p[0] + t[1] * p[1] + t[2], t[3] * p[0] + t[4] * p[1] + t[5])))
    return F.when(t[0] * t[4] - t[1] * t[3] < 0, F.transform(moved, F.reverse)).otherwise(moved)


def seam_objects(df: DataFrame, size: int, kept: Kept, mask: str = "mask", eight: bool = False) -> DataFrame:
    """Pixels (grow, gcol, object) of the components of a mosaic of tiles: df (tile_row, tile_col, row, col, mask), tiles of size x size.

    grow, gcol: row and column in the mosaic. object: grow * 2^32 + gcol of the component's first pixel in reading order, as one flood fill
    over the mosaic would give. Each tile is labelled by itself; pixels on both sides of a seam then link the labels, and the links alone
    are settled in rounds.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((size, size), bool)
        a[x["row"], x["col"]] = x[mask].fillna(0) > 0
        label = raster.components(a, eight)
        r, c = np.nonzero(label)
        top, left = int(x["tile_row"].iat[0]) * size, int(x["tile_col"].iat[0]) * size
        first = np.full(label.max(initial=0) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, label[r, c], ((top + r) << 32) + left + c)
        return pd.DataFrame({"grow": top + r, "gcol": left + c, "part": first[label[r, c]]})

    parts = kept.put(df.select("tile_row", "tile_col", "row", "col", mask).groupBy("tile_row", "tile_col").applyInPandas(run, "grow long, gcol long, part long"))
    around = [(1, 0), (0, 1)] + [(1, 1), (1, -1)] * eight
    on = lambda c, at: F.pmod(F.col(c), F.lit(size)) == at
    # from the last row, the last column and, over corners, the first one, to what lies beyond
    edge = parts.filter(on("grow", size - 1) | on("gcol", size - 1) | on("gcol", 0) | on("grow", 0))
    over = edge.select(F.explode(F.array(*(F.struct((F.col("grow") + i).alias("grow"), (F.col("gcol") + j).alias("gcol")) for i, j in around))).alias("to"), F.col("part").alias("a"))
    links = over.select("to.grow", "to.gcol", "a").join(edge.select("grow", "gcol", F.col("part").alias("b")), ["grow", "gcol"]).filter("a <> b").select("a", "b").distinct()
    root = linked(links, kept).select(F.col("id").alias("part"), F.col("root"))
    return parts.join(root, "part", "left").select("grow", "gcol", F.coalesce("root", "part").alias("object"))


def _code(x: Column, y: Column, d: Column) -> Column:
    """One number for a side, in the order of y, x and direction."""
    ok = (F.abs(x) < HALF) & (F.abs(y) < HALF)
    n = F.shiftleft((y + HALF).cast("long"), 32).bitwiseOR(F.shiftleft((x + HALF).cast("long"), 2)).bitwiseOR(d.cast("long"))
    return F.when(ok, n).otherwise(F.raise_error(F.lit("cells lie beyond 2^29")).cast("long"))


def cell_sides(cells: DataFrame, key: str, x: str = "cx", y: str = "cy") -> DataFrame:
    """(key, x, y, d): the sides of distinct cells that only one cell of a key has; what two share cancels."""
    a, b = F.col(x).cast("long"), F.col(y).cast("long")
    side = lambda k, x0, y0, upright: F.struct(F.lit(k).alias("d"), x0.alias("sx"), y0.alias("sy"), F.lit(upright).alias("upright"))
    four = F.array(side(0, a, b, 0), side(1, a + 1, b, 1), side(2, a, b + 1, 0), side(3, a, b, 1))
    once = cells.select(key, F.explode(four).alias("s")).groupBy(key, "s.sx", "s.sy", "s.upright").agg(F.count("*").alias("n"), F.max("s.d").alias("d")).filter("n = 1")
    # a side's first point: sides that go back begin at the far end
    return once.select(key, (F.col("sx") + F.when(F.col("d") == 2, 1).otherwise(0)).alias("x"), (F.col("sy") + F.when(F.col("d") == 3, 1).otherwise(0)).alias("y"), "d")


def ring_points(sides: DataFrame, key: str, kept: Kept, eight: bool = False) -> DataFrame:
    """(key, ring, place, x, y, d, corner) of all sides (key, x, y, d) of outlines: ring names the ring by the code of its first side,
    place counts from it, corner tells whether the direction changes there.

    At each point what ends there is joined to what begins there (two of each at most). Then the sides jump along their ring, twice as far each
    round, until each knows its ring's least side, and again until each knows the way to it: rounds are the logarithm of the longest ring.
    """
    d = F.col("d")
    dx, dy = (F.element_at(F.array(*(F.lit(s[k]) for s in STEPS)), d + 1) for k in (0, 1))
    own = sides.select(key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "d", _code(F.col("x"), F.col("y"), d).alias("id"), (F.col("x") + dx).cast("long").alias("ex"), (F.col("y") + dy).cast("long").alias("ey"))
    own = kept.put(own)
    begins = own.groupBy(key, F.col("x").alias("ex"), F.col("y").alias("ey")).agg(F.collect_list("d").alias("next"))
    turn = F.pmod(d + (3 if eight else 1), F.lit(4))
    went = F.when(F.size("next") == 1, F.col("next")[0]).otherwise(turn)
    follow = kept.put(own.join(begins, [key, "ex", "ey"]).select(key, "id", "x", "y", "d", _code(F.col("ex"), F.col("ey"), went).alias("follow"), went.alias("turned")))
    state = kept.put(follow.select(key, "id", F.col("follow").alias("jump"), F.least("id", "follow").alias("least")))
    target = lambda s, *c: s.select(F.col(key).alias("_k"), F.col("id").alias("_id"), *(F.col(n).alias(f"_{n}") for n in c))
    same = (F.col(key) == F.col("_k")) & (F.col("jump") == F.col("_id"))
    while True:
        new = state.join(target(state, "jump", "least"), same).select(key, "id", F.col("_jump").alias("jump"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("fell"))
        new = kept.put(new)
        kept.drop(state)
        state = new.drop("fell")
        state.kept_path = new.kept_path
        if not new.filter("fell").limit(1).count():
            break
    root = F.col("id") == F.col("least")
    ranked = follow.select(key, F.col("id").alias("i"), "follow").join(state.select(F.col(key).alias("_k"), "id", "least"), (F.col(key) == F.col("_k")) & (F.col("i") == F.col("id")))
    old, state = state, kept.put(ranked.select(key, "id", "least", F.when(root, F.col("id")).otherwise(F.col("follow")).alias("jump"), F.when(root, 0).otherwise(1).cast("long").alias("left")))
    kept.drop(old)
    while state.filter("jump <> least").limit(1).count():
        new = kept.put(state.join(target(state, "jump", "left"), same).select(key, "id", "least", F.col("_jump").alias("jump"), (F.col("left") + F.col("_left")).alias("left")))
        kept.drop(state)
        state = new
    long = state.groupBy(F.col(key).alias("_k"), F.col("least").alias("ring")).agg(F.count("*").alias("n"))
    placed = state.select(key, "id", "least", "left").join(long, (F.col(key) == F.col("_k")) & (F.col("least") == F.col("ring")))
    placed = placed.select(F.col(key).alias("_k"), F.col("id").alias("_i"), "ring", F.when(F.col("left") == 0, 0).otherwise(F.col("n") - F.col("left")).alias("place"))
    # a corner is where the side before went another way
    came = follow.select(F.col(key).alias("_k2"), F.col("follow").alias("_f"), (F.col("d") != F.col("turned")).alias("corner"))
    out = follow.join(placed, (F.col(key) == F.col("_k")) & (F.col("id") == F.col("_i"))).join(came, (F.col(key) == F.col("_k2")) & (F.col("id") == F.col("_f")))
    return out.select(key, "ring", "place", "x", "y", "d", "corner")


def ring_figures(points: DataFrame, key: str) -> DataFrame:
    """(key, ring, area, perimeter, corners) of rings in cells; holes have a negative area."""
    part = F.when(F.col("d") == 1, F.col("x")).when(F.col("d") == 3, -F.col("x")).otherwise(0)
    return points.groupBy(key, "ring").agg(F.sum(part).alias("area"), F.count("*").alias("perimeter"), F.count_if("corner").alias("corners"))


def rings_of(points: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """(key, ring, points): each ring as one closed array of its corners, for readers that want it in one value, which has to fit a task."""
    xy = F.array(F.col("x") * scale, F.col("y") * scale)
    got = points.filter("corner").groupBy(key, "ring").agg(F.array_sort(F.collect_list(F.struct("place", xy.alias("p")))).alias("ps"))
    ps = F.transform("ps", lambda p: p["p"])
    return got.select(key, "ring", F.concat(ps, F.slice(ps, 1, 1)).alias("points"))


def dissolve_rings(cells: DataFrame, key: str, kept: Kept, x: str = "cx", y: str = "cy", eight: bool = False) -> DataFrame:
    """The outlines of each key's cells, repeated cells once, as ring_points() gives them; null keys or cells are left out."""
    return ring_points(cell_sides(cells.select(key, x, y).dropna().distinct(), key, x, y), key, kept, eight)


def seam_outlines(df: DataFrame, size: int, kept: Kept, mask: str = "mask", eight: bool = False) -> DataFrame:
    """The outlines of the objects across tile seams, as ring_points() gives them with key `object`."""
    return dissolve_rings(kept.put(seam_objects(df, size, kept, mask, eight)), "object", kept, "gcol", "grow", eight)


def tile_chains(m: np.ndarray, top: int, left: int, eight: bool = False) -> dict[str, np.ndarray]:
    """Columns of PIECES of a tile: m has its mask and a pixel more around it, (top, left) is its first pixel in the mosaic.

    What follows a side depends on the two cells ahead alone, so a ring that stays in the tile is complete (RING), and others are
    cut where they go on in another tile (CHAIN, from the code of its first side, `a`, to that of the side that follows its last, `b`).
    OVER and EDGE hold both ends of what is connected over the tile's edge: the code of the pixel beyond or of its own.
    """
    m = m.astype(bool)
    here = m[1:-1, 1:-1]
    h, w = here.shape
    label = raster.components(here, eight)
    r, c = np.nonzero(here)
    code = ((top + np.arange(-1, h + 1)[:, None]) << 32) + left + np.arange(-1, w + 1)
    first = np.full(label.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, label[r, c], code[1:-1, 1:-1][r, c])
    found = []
    own = np.zeros_like(m)
    own[1:-1, 1:-1] = True
    for i, j in [(1, 0), (0, 1)] + [(1, 1), (1, -1)] * eight:
        for kind, sign in ((OVER, 1), (EDGE, -1)):
            y, x = r + 1 + sign * i, c + 1 + sign * j
            ok = m[y, x] & ~own[y, x]
            found.append((np.full(ok.sum(), kind), first[label[r, c]][ok], code[y, x][ok] if kind == OVER else code[r + 1, c + 1][ok]))
    kinds, parts, pixels = (np.concatenate(f) for f in zip(*found, strict=True))
    zeros = np.zeros(len(kinds), np.int64)
    out = [(kinds, parts, pixels, zeros, zeros, zeros, zeros, zeros)]

    step = np.array(STEPS)
    cells = [(y, x, np.full(len(y), d)) for d in range(4) for y, x in [np.nonzero(here & ~m[1 + step[d - 1][1] : h + 1 + step[d - 1][1], 1 + step[d - 1][0] : w + 1 + step[d - 1][0]])]]
    y, x, d = (np.concatenate(a) for a in zip(*cells, strict=True))
    if len(y):
        (ax, ay), (nx, ny) = step[d].T, step[(d + 3) % 4].T  # ahead, and away from the cell
        ahead, beside = m[y + 1 + ay, x + 1 + ax], m[y + 1 + ay + ny, x + 1 + ax + nx]
        turn = np.where(beside & (ahead | eight), 3, np.where(ahead, 0, 1))
        ny, nx = y + (turn != 1) * ay + (turn == 3) * ny, x + (turn != 1) * ax + (turn == 3) * nx  # the cell that follows
        inside = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
        # a side's first point: the corner of its cell where it begins
        at_y, at_x = top + y + (d >= 2), left + x + ((d == 1) | (d == 2))
        name = lambda y, x, d: ((y + HALF) << 32) | ((x + HALF) << 2) | d
        codes, next_ = name(at_y, at_x, d), name(at_y + ay, at_x + ax, (d + turn) % 4)
        place = np.full(h * w * 4, -1)
        place[(y * w + x) * 4 + d] = np.arange(len(y))
        follow = np.full(len(y), -1)
        follow[inside] = place[(ny[inside] * w + nx[inside]) * 4 + (d[inside] + turn[inside]) % 4]
        all_ = np.arange(len(y))
        jump, least = np.where(inside, follow, all_), all_.copy()
        for _ in range(len(y).bit_length()):
            least = np.minimum(least, least[jump])
            jump = jump[jump]
        open_ = ~inside[jump]  # chains have come to their last side, which goes on elsewhere; rings haven't
        of = np.where(open_, jump, least)
        names, of = np.unique(of, return_inverse=True)
        starts = np.ones(len(y), bool)
        starts[follow[inside]] = False
        begin = np.zeros(len(names), np.int64)
        begin[of[starts]] = codes[starts]
        lowest, area_ = np.full(len(names), np.iinfo(np.int64).max), np.zeros(len(names), np.int64)
        np.minimum.at(lowest, of, codes)
        np.add.at(area_, of, np.where(d == 1, at_x, np.where(d == 3, -at_x, 0)))
        chain = ~inside[names]
        out.append((np.where(chain, CHAIN, RING), first[label[y[names], x[names]]], begin, np.where(chain, next_[names], 0), lowest, area_, np.bincount(of), np.bincount(of, turn != 0)))
    return {k: np.concatenate(v).astype(np.int64) for k, v in zip(PIECES, zip(*out, strict=True), strict=True)}


RING, CHAIN, OVER, EDGE = range(4)
PIECES = ("kind", "part", "a", "b", "ring", "area", "perimeter", "corners")


def seam_figures(df: DataFrame, size: int, kept: Kept, mask: str = "mask", eight: bool = False) -> DataFrame:
    """What ring_figures() tells of seam_outlines(), without a table of sides: (object, ring, area, perimeter, corners).

    Each tile gets the pixels around it and sums its rings up; of those that cross a seam only the chains between seams are
    shuffled, and settled in rounds like the objects.
    """
    to = lambda c: F.filter(F.array(F.lit(0), F.when(F.col(c) == 0, -1), F.when(F.col(c) == size - 1, 1)), lambda x: x.isNotNull())
    px = df.filter(F.col(mask) > 0).select("tile_row", "tile_col", "row", "col")
    px = px.withColumn("_i", F.explode(to("row"))).withColumn("_j", F.explode(to("col")))
    tile = lambda c, by: (F.col(c) + F.col(by)).cast("long").alias(c)
    px = px.select(tile("tile_row", "_i"), tile("tile_col", "_j"), *((F.col(c) - F.col(by) * size + 1).cast("int").alias(c) for c, by in (("row", "_i"), ("col", "_j"))))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((size + 2, size + 2), bool)
        m[x["row"], x["col"]] = True
        return pd.DataFrame(tile_chains(m, int(x["tile_row"].iat[0]) * size, int(x["tile_col"].iat[0]) * size, eight))

    pieces = kept.put(px.groupBy("tile_row", "tile_col").applyInPandas(run, ", ".join(f"{c} long" for c in PIECES)))
    of = lambda kind: pieces.filter(F.col("kind") == kind)
    over, edge = of(OVER).select("a", F.col("part").alias("x")), of(EDGE).select("a", F.col("part").alias("y"))
    objects = linked(over.distinct().join(edge.distinct(), "a").select(F.col("x").alias("a"), F.col("y").alias("b")), kept)
    rings = linked(of(CHAIN).select("a", "b"), kept).select(F.col("id").alias("a"), "root")
    sums = [F.sum(c).alias(c) for c in PIECES[5:]]
    crossing = of(CHAIN).join(rings, "a").groupBy("root").agg(F.min("part").alias("part"), F.min("ring").alias("ring"), *sums).drop("root")
    whole = of(RING).select(*crossing.columns).union(crossing)
    return whole.join(objects.select(F.col("id").alias("part"), "root"), "part", "left").select(F.coalesce("root", "part").alias("object"), *whole.columns[1:])


# Polygons back to pixels.


def filled(rings: list, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which pixel centres (rows at ys, columns at xs, both ascending or ys falling) lie in the first ring and in none of the others.

    Scan lines: each edge is active on the rows between its ends and crosses each once; left of a crossing all columns change sides.
    """
    out = np.zeros((len(ys), len(xs)), bool)
    for k, ring in enumerate(rings):
        p = np.array([[*q] for q in ring], float)
        q = np.roll(p, -1, 0)
        rows = np.zeros((len(ys), len(xs) + 1), np.int32)
        up = ys[::-1] if len(ys) > 1 and ys[0] > ys[-1] else ys
        lo = np.searchsorted(up, np.minimum(p[:, 1], q[:, 1]), "left")  # rows with least <= y < greatest
        hi = np.searchsorted(up, np.maximum(p[:, 1], q[:, 1]), "left")
        n = np.maximum(hi - lo, 0)
        e = np.repeat(np.arange(len(p)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[e]
        y = up[at]
        cross = (q[e, 0] - p[e, 0]) * (y - p[e, 1]) / (q[e, 1] - p[e, 1]) + p[e, 0]
        np.add.at(rows, (at if up is ys else len(ys) - 1 - at, np.searchsorted(xs, cross, "left")), 1)
        inside = rows[:, ::-1].cumsum(1)[:, ::-1][:, 1:] % 2 == 1
        out = inside if not k else out & ~inside
    return out


def rasterize(tiles: DataFrame, polygons: DataFrame, size: int, scale: float) -> DataFrame:
    """(tile_id, data): size x size labels, a byte each, of the pixel centres in polygons (tile_id, rings, label); what is written later wins:
    first all others, which count as ignored, then label 1. Tiles without a target vanish. tiles: tile_id, origin_x, origin_y (top left).

    The polygons of a tile come sorted and are written one by one; a task holds one tile, however many polygons it has.
    """
    both = tiles.select("tile_id", "origin_x", "origin_y").join(polygons.select("tile_id", "rings", "label"), "tile_id")
    both = both.withColumn("_last", (F.coalesce(F.col("label"), F.lit(0)) == 1).cast("int")).repartition("tile_id").sortWithinPartitions("tile_id", "_last")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        done: list[tuple] = []
        at = (np.arange(size) + 0.5) * scale
        for x in frames:
            for tile, left, top, rings, last in zip(x["tile_id"], x["origin_x"], x["origin_y"], x["rings"], x["_last"], strict=True):
                if held is None or tile != now:
                    if held is not None and (held == 1).any():
                        done.append((now, held.tobytes()))
                    now, held = tile, np.zeros((size, size), np.uint8)
                if rings is not None and len(rings):
                    held[filled(rings, left + at, top - at)] = 1 if last else schema.IGNORE
            if done:
                yield pd.DataFrame(done, columns=["tile_id", "data"])
                done = []
        if held is not None and (held == 1).any():
            yield pd.DataFrame([(now, held.tobytes())], columns=["tile_id", "data"])

    return both.select("tile_id", "origin_x", "origin_y", "rings", "_last").mapInPandas(run, f"tile_id {tiles.schema['tile_id'].dataType.simpleString()}, data binary")


def label_pixels(labels: DataFrame, size: int) -> DataFrame:
    """(tile_id, row, col, label) of tiles (tile_id, data) as rasterize() gives them, an Arrow pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, col = (a.ravel() for a in np.indices((size, size), np.int32))
        for x in frames:
            for tile, data in zip(x["tile_id"], x["data"], strict=True):
                yield pd.DataFrame({"tile_id": tile, "row": row, "col": col, "label": np.frombuffer(data, np.uint8).astype(np.int32)})

    return labels.mapInPandas(run, f"tile_id {labels.schema['tile_id'].dataType.simpleString()}, row int, col int, label int")


# --- queries -------------------------------------------------------------------------------------------------------


def _placed(s: SparkSession, d: str) -> DataFrame:
    """The tiles of the raster queries, ten in a row of a mosaic."""
    g = raster._grid(s, d)
    return g.withColumn("tile_row", F.floor(F.col("tile_id") / 10)).withColumn("tile_col", F.pmod(F.col("tile_id"), F.lit(10))).withColumn("mask", (F.col("v") >= 11).cast("int"))


def _refilled(s: SparkSession, d: str) -> DataFrame:
    """Masks to polygons and back."""
    polygons = vectorize(raster._grid(s, d), least=2).select("tile_id", to_map("rings", F.array(*map(F.lit, (1.0, 0.0, 5.0, 0.0, -1.0, 40.0)))).alias("rings"), F.lit(1).alias("label"))
    tiles = schema.table(s, d, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.lit(5.0).alias("origin_x"), F.lit(40.0).alias("origin_y"))
    return label_pixels(rasterize(tiles, polygons, raster.SIDE, 1.0), raster.SIDE).filter("label = 1").select("tile_id", "row", "col")


def _cells(s: SparkSession, d: str) -> DataFrame:
    from .spatial import _pts

    return _pts(s, d).select("cls", F.floor(F.col("x") / 1.5).alias("cx"), F.floor(F.col("y") / 1.5).alias("cy"))


def _dissolved(s: SparkSession, d: str) -> DataFrame:
    kept = Kept(s, "dissolve")
    f = ring_figures(dissolve_rings(_cells(s, d), "cls", kept), "cls")
    out = f.groupBy("cls").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.sum("corners").alias("corners"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes"))
    return kept.last(out)


def _overlaid(s: SparkSession, d: str, how: str) -> DataFrame:
    from .fields import overlay

    kept = Kept(s, how)
    c = _cells(s, d)
    both = overlay(c.filter("cls = 0").select("cx", "cy").distinct(), c.filter("cls = 1").select("cx", "cy").distinct(), how).withColumn("k", F.lit(0))
    f = ring_figures(dissolve_rings(both, "k", kept), "k")
    return kept.last(f.groupBy("k").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.sum("corners").alias("corners"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes")))


def _seams(s: SparkSession, d: str) -> DataFrame:
    kept = Kept(s, "seams")
    return kept.last(seam_objects(_placed(s, d), raster.SIDE, kept).groupBy("object").agg(F.count("*").alias("area")))


def _seam_rings(s: SparkSession, d: str) -> DataFrame:
    kept = Kept(s, "seam-rings")
    f = seam_figures(_placed(s, d), raster.SIDE, kept)
    return kept.last(f.groupBy("object").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.sum("corners").alias("corners"), F.count_if(F.col("area") < 0).alias("holes")))


QUERIES = {
    "r21_polygons": lambda s, d: vectorize(raster._grid(s, d), score="score", least=6).select("tile_id", "blob", "area", "perimeter", "corners", "holes", F.round("mean_score", 6).alias("mean_score"), "max_score"),
    "r21_refilled": _refilled,
    "r03_seam_objects": _seams,
    "r21_seam_outlines": _seam_rings,
    "a30_dissolved_rings": _dissolved,
    "u08_intersection_rings": lambda s, d: _overlaid(s, d, "intersection"),
    "u08_difference_rings": lambda s, d: _overlaid(s, d, "difference"),
}
#: Sides and corners of the cells of a table (k, x, y) by what lies around each.
AROUND = """around AS (SELECT m.k, sum((n.k IS NULL)::INT + (e.k IS NULL)::INT + (s.k IS NULL)::INT + (w.k IS NULL)::INT)::BIGINT AS perimeter, count(*) AS area,
  sum(((n.k IS NULL) AND (w.k IS NULL))::INT + ((n.k IS NULL) AND (e.k IS NULL))::INT + ((s.k IS NULL) AND (w.k IS NULL))::INT + ((s.k IS NULL) AND (e.k IS NULL))::INT)::BIGINT AS convex,
  sum((n.k IS NOT NULL AND w.k IS NOT NULL AND nw.k IS NULL)::INT + (n.k IS NOT NULL AND e.k IS NOT NULL AND ne.k IS NULL)::INT
    + (s.k IS NOT NULL AND w.k IS NOT NULL AND sw.k IS NULL)::INT + (s.k IS NOT NULL AND e.k IS NOT NULL AND se.k IS NULL)::INT)::BIGINT AS concave
  FROM {t} m """ + "\n  ".join(f"LEFT JOIN {{t}} {n} ON {n}.k = m.k AND {n}.x = m.x + {dx} AND {n}.y = m.y + {dy}" for n, dx, dy in (("n", 0, -1), ("s", 0, 1), ("w", -1, 0), ("e", 1, 0), ("nw", -1, -1), ("ne", 1, -1), ("sw", -1, 1), ("se", 1, 1))) + " GROUP BY m.k)"  # fmt: skip
_RINGS = "SELECT {k}, area, perimeter, convex + concave AS corners, (convex - concave) // 4 AS outer_less_holes FROM around"
_CELLS = "cells AS (SELECT DISTINCT c_custkey % 5 AS cls, floor((c_custkey * 7919) % 3600 / 100.0::DOUBLE / 1.5::DOUBLE)::BIGINT AS x, floor((c_custkey * 104729) % 2500 / 100.0::DOUBLE / 1.5::DOUBLE)::BIGINT AS y FROM customer)"
_MOSAIC = f"""px AS (SELECT row + tile_id // 10 * {raster.SIDE} AS y, col + tile_id % 10 * {raster.SIDE} AS x FROM grid WHERE v >= 11),
  reach AS (SELECT y * 4294967296 + x AS r, y, x FROM px UNION SELECT a.r, b.y, b.x FROM reach a JOIN px b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
  m AS (SELECT min(r)::BIGINT AS k, y, x FROM reach GROUP BY y, x)"""
SQL = {
    "r21_polygons": raster.BLOBS + ", " + raster.LARGE.format(least=6) + f""", px AS (SELECT tile_id * 1000 + blob AS k, c.col AS x, c.row AS y, c.v FROM b JOIN c USING (tile_id, root)), {AROUND.format(t='px')}
      SELECT k // 1000 AS tile_id, (k % 1000)::INT AS blob, any_value(area) AS area, any_value(perimeter) AS perimeter, any_value(convex + concave)::INT AS corners, any_value(1 - (convex - concave) // 4)::INT AS holes,
      round(avg(v / 16), 6) AS mean_score, max(v / 16) AS max_score FROM around JOIN px USING (k) GROUP BY k""",
    "r21_refilled": raster.BLOBS + ", " + raster.LARGE.format(least=2) + " SELECT tile_id, c.row, c.col FROM b JOIN c USING (tile_id, root)",
    "r03_seam_objects": f"WITH RECURSIVE {raster.GRID}, {_MOSAIC} SELECT k AS object, count(*) AS area FROM m GROUP BY 1",
    "r21_seam_outlines": f"WITH RECURSIVE {raster.GRID}, {_MOSAIC}, {AROUND.format(t='m')} SELECT k AS object, area, perimeter, convex + concave AS corners, 1 - (convex - concave) // 4 AS holes FROM around",
    "a30_dissolved_rings": f"WITH {_CELLS}, m AS (SELECT cls AS k, x, y FROM cells), {AROUND.format(t='m')} {_RINGS.format(k='k AS cls')}",
    "u08_intersection_rings": f"WITH {_CELLS}, m AS (SELECT 0 AS k, x, y FROM (SELECT x, y FROM cells WHERE cls = 0 INTERSECT SELECT x, y FROM cells WHERE cls = 1)), {AROUND.format(t='m')} {_RINGS.format(k='k')}",
    "u08_difference_rings": f"WITH {_CELLS}, m AS (SELECT 0 AS k, x, y FROM (SELECT x, y FROM cells WHERE cls = 0 EXCEPT SELECT x, y FROM cells WHERE cls = 1)), {AROUND.format(t='m')} {_RINGS.format(k='k')}",
}
