"""Polygons from masks, objects across seams, dissolved cells, rasterizing by scan lines, holes in spatial joins, geodesics."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import geodesy, links, outlines, raster, spatial
from tilewright.operators.state_io import Kept


@pytest.fixture
def kept(spark):
    return Kept(spark, "test")


def flood(mask: np.ndarray, eight: bool) -> np.ndarray:
    """Labels by a stack, from 1 in reading order."""
    out, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * eight
    for at in zip(*np.nonzero(mask), strict=True):
        if out[at]:
            continue
        n, todo = n + 1, [at]
        out[at] = n
        while todo:
            r, c = todo.pop()
            for i, j in steps:
                q = (r + i, c + j)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("share", [0.2, 0.5, 0.7, 0.95])
def test_rings_refill_to_the_mask(share, eight):
    rng = np.random.default_rng(int(share * 100))
    for _ in range(25):
        mask = rng.random(rng.integers(1, 15, 2)) < share
        label = raster.components(mask, eight)
        assert (label == flood(mask, eight)).all()
        rings: dict = {}
        for k, ring in outlines.trace(label, eight):
            assert (ring[0] == ring[-1]).all() and (np.abs(np.diff(ring, axis=0)) > 0).sum(1).max() == 1
            rings.setdefault(k, []).append(ring)
        assert set(rings) == set(range(1, label.max() + 1))
        h, w = mask.shape
        for k, rs in rings.items():
            assert outlines.area(rs[0]) > 0 and all(outlines.area(r) < 0 for r in rs[1:])
            assert sum(map(outlines.area, rs)) == (label == k).sum()
            for flip in (1, -1):
                got = outlines.filled([[[x, flip * y] for x, y in r] for r in rs], np.arange(w) + 0.5, flip * (np.arange(h) + 0.5))
                assert (got == (label == k)).all()


def test_simplified_rings_stay_within_tolerance():
    t = np.linspace(0, 2 * np.pi, 200)
    ring = np.stack([50 + 40 * np.cos(t), 50 + 40 * np.sin(t)], 1)
    ring[-1] = ring[0]
    for tolerance in (0.5, 3.0):
        less = outlines.simplify(ring, tolerance)
        assert len(less) < len(ring) and (less[0] == less[-1]).all()
        for p in ring:
            a, b = less[:-1], less[1:]
            u = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
            assert np.hypot(*(a + u[:, None] * (b - a) - p).T).min() <= tolerance + 1e-9
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]])
    assert (outlines.simplify(square, 10.0) == square).all()


def test_polygons_of_tiles_with_holes_and_affine(spark):
    mask = np.zeros((7, 9), int)
    mask[1:6, 1:8] = 1
    mask[3, 3] = mask[2, 5] = 0
    mask[6, 8] = 1
    rows = [(1, r, c, int(mask[r, c]), float(r + c)) for r in range(7) for c in range(9)] + [(2, r, 0, 0, 0.0) for r in range(3)] + [(3, 0, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "tile_id int, row int, col int, mask int, score double")
    got = outlines.vectorize(df, score="score", least=2).collect()
    assert len(got) == 1 and (got[0].area, got[0].holes, got[0].corners, got[0].perimeter) == (33, 2, 12, 32)
    inside = [r + c for r in range(7) for c in range(9) if mask[r, c] and (r, c) != (6, 8)]
    assert got[0].mean_score == pytest.approx(np.mean(inside)) and got[0].max_score == max(inside)
    both = outlines.vectorize(df, eight=True)
    assert both.count() == 1 and both.first().area == 34
    on_map = outlines.vectorize(df, least=2).select(outlines.to_map("rings", F.array(*map(F.lit, (3.0, 0.0, 100.0, 0.0, -3.0, 900.0)))).alias("r")).first().r
    areas = [outlines.area(np.array(r)) for r in on_map]
    assert areas[0] == 35 * 9 and sorted(areas[1:]) == [-9, -9]
    assert not outlines.vectorize(df.limit(0)).count()


@pytest.mark.parametrize("eight", [False, True])
def test_objects_across_seams_equal_one_flood_fill(spark, kept, eight):
    rng = np.random.default_rng(4)
    size, mask = 6, rng.random((24, 30)) < 0.55
    mask[11, :] = True  # one object through all tiles of two rows
    rows = [(r // size, c // size, r % size, c % size, int(mask[r, c])) for r in range(24) for c in range(30) if (r, c) != (0, 0)]
    mask[0, 0] = False  # a pixel that isn't there
    df = spark.createDataFrame(rows, "tile_row int, tile_col int, row int, col int, mask int").repartition(3)
    label = flood(mask, eight)
    first = {k: int(r[0]) * 2**32 + int(c[0]) for k in range(1, label.max() + 1) for r, c in [np.nonzero(label == k)]}
    got = {(r.grow, r.gcol): r.object for r in outlines.seam_objects(df, size, kept, eight=eight).collect()}
    assert got == {(int(r), int(c)): first[label[r, c]] for r, c in zip(*np.nonzero(mask), strict=True)}
    figures = {r.object: r for r in outlines.ring_figures(outlines.seam_outlines(df, size, kept, eight=eight), "object").groupBy("object").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("around"), F.sum("corners").alias("corners"), F.count("*").alias("rings")).collect()}
    by: dict = {}
    for k, ring in outlines.trace(label, eight):
        by.setdefault(first[k], []).append(ring)
    assert set(figures) == set(by)
    for k, rs in by.items():
        around = sum(int(np.abs(np.diff(r, axis=0)).sum()) for r in rs)
        assert (figures[k].area, figures[k].around, figures[k].corners, figures[k].rings) == (sum(map(outlines.area, rs)), around, sum(len(r) - 1 for r in rs), len(rs))


def test_dissolved_rings_are_those_of_the_tracing(spark, kept):
    rng = np.random.default_rng(9)
    mask = rng.random((9, 11)) < 0.6
    cells = [(k, int(c) - 5, int(r) - 4) for k in "ab" for r, c in zip(*np.nonzero(mask if k == "a" else ~mask), strict=True)]
    df = spark.createDataFrame([*cells, *cells[:20], (None, 0, 0), ("a", None, 1)], "k string, cx int, cy int")
    points = kept.put(outlines.dissolve_rings(df, "k", kept))
    for k in "ab":
        want = {frozenset(map(tuple, (ring - [5, 4]).tolist())) for _, ring in outlines.trace((mask if k == "a" else ~mask).astype(int))}
        got = [r.points for r in outlines.rings_of(points.filter(F.col("k") == k), "k").collect()]
        assert {frozenset(map(tuple, r)) for r in got} == want and all(r[0] == r[-1] for r in got)
        assert sum(outlines.area(np.array(r)) for r in got) == sum(x[0] == k for x in cells)
    assert not outlines.dissolve_rings(df.limit(0), "k", kept).count()
    with pytest.raises(Exception, match="beyond"):
        outlines.dissolve_rings(spark.createDataFrame([("a", 2**40, 0)], "k string, cx long, cy long"), "k", kept).collect()


def test_components_of_links_with_a_hub_and_a_path(spark, kept):
    pairs = [(0, k) for k in range(5, 60)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200), (7, 3)]
    got = {r.id: r.root for r in links.components(spark.createDataFrame(pairs, "a long, b long"), kept).collect()}
    assert got == {**{k: 0 for k in [0, 3, *range(5, 60)]}, **{k: 100 for k in range(100, 141)}}
    assert not links.components(spark.createDataFrame([], "a long, b long"), kept).count()


def test_rasterize_by_scan_lines_equals_the_ray_cast(spark):
    rng = np.random.default_rng(2)
    tiles, polygons = [], []
    for t in range(12):
        tiles.append((t, float(t), 20.0))
        for _ in range(t % 4):
            a = np.sort(rng.random(7)) * 2 * np.pi
            ring = [[float(t + 8 + r * np.cos(x)), float(12 + r * np.sin(x))] for r, x in zip(2 + 5 * rng.random(7), a, strict=True)]
            hole = [[t + 7.5, 11.5], [t + 8.6, 11.5], [t + 8.6, 12.7], [t + 7.5, 12.7]]
            polygons.append((t, [ring, hole], int(rng.choice([1, 255]))))
    got = outlines.label_pixels(outlines.rasterize(spark.createDataFrame(tiles, "tile_id int, origin_x double, origin_y double"), spark.createDataFrame(polygons, "tile_id int, rings array<array<array<double>>>, label int"), 16, 1.0), 16)
    seen = {(r.tile_id, r.row, r.col): r.label for r in got.collect()}

    def inside(x, y, ring):
        n = 0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return n % 2 == 1

    want = {}
    for t, left, top in tiles:
        px = {}
        for last in (False, True):
            for _, (ring, hole), label in (p for p in polygons if p[0] == t and (p[2] == 1) == last):
                px.update({(t, r, c): 1 if last else 255 for r in range(16) for c in range(16) if inside(left + c + 0.5, top - r - 0.5, ring) and not inside(left + c + 0.5, top - r - 0.5, hole)})
        if 1 in px.values():
            want.update({(t, r, c): px.get((t, r, c), 0) for r in range(16) for c in range(16)})
    assert seen == want
    plan = raster.rasterize(spark.createDataFrame(tiles, "tile_id int, origin_x double, origin_y double"), spark.createDataFrame(polygons, "tile_id int, rings array<array<array<double>>>, label int"), 16, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_points_in_holes_and_boxes_over_bars(spark, monkeypatch):
    square = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    rings = [square(0.0, 0.0, 10.0, 10.0), square(1.0, 1.0, 4.5, 9.0), square(5.5, 1.0, 9.0, 9.0)]
    polygons = spark.createDataFrame([("p", rings)], "name string, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 3.0, 5.0), (2, 5.0, 5.0), (3, 12.0, 5.0), (4, float("nan"), 5.0), (5, None, 1.0)], "id int, x double, y double")
    for held in (1000, 0):
        monkeypatch.setattr(spatial, "HELD", held)
        got = {r.id: (r.name, r.dist) for r in spatial.nearest_feature(points, polygons, "id", "name").collect()}
        assert got == {1: ("p", 1.5), 2: ("p", 0.0), 3: ("p", 2.0), 4: (None, None), 5: (None, None)}
        centres = spark.createDataFrame([("c", 0.0, 0.0)], "name string, cx double, cy double")
        near = {r.id: r.dist for r in spatial.nearest_centroid(points, centres, "id", "name").collect()}
        assert near[2] == pytest.approx(math.sqrt(50)) and near[4] is None and near[5] is None
    assert {r.id: r.name for r in spatial.within(points, polygons, "id", "name").collect()} == {1: None, 2: "p", 3: None, 4: None, 5: None}
    boxes = spark.createDataFrame([(1, 2.0, 3.0, 8.0, 4.0), (2, 2.0, 3.0, 3.0, 4.0), (3, -2.0, -2.0, 12.0, 12.0), (4, 11.0, 0.0, 12.0, 1.0)], "id int, min_x double, min_y double, max_x double, max_y double")
    assert {r.id for r in spatial.boxes_hit(boxes, polygons, "id").collect()} == {1, 3}


def test_geodesics_against_closed_forms(spark):
    length, _ = geodesy.inverse(np.array([0.0, 5, 10, 0]), np.array([0.0, 0, 0, 20]), np.array([10.0, 5, 10, 0]), np.array([0.0, 90, -90, 20]))
    assert length == pytest.approx([geodesy.A * math.radians(10), 10001965.7293, 10001965.7293, 0.0], rel=1e-11)
    e = math.sqrt(geodesy.E2)
    q = lambda p: (1 - e * e) * (math.sin(p) / (1 - e * e * math.sin(p) ** 2) + math.atanh(e * math.sin(p)) / e)
    zone = lambda w, a, b: geodesy.A**2 * math.radians(w) * (q(math.radians(b)) - q(math.radians(a))) / 2
    xs = np.linspace(170, 190, 2000).tolist()
    along = lambda a, b: [[[x, a] for x in xs] + [[x, b] for x in reversed(xs)]]
    rows = [(1, along(10.0, 30.0)), (2, along(-40.0, 20.0)), (3, None), (4, []), (5, [along(0.0, 20.0)[0], along(5.0, 10.0)[0]]), (6, [[[0.0, 1.0], [2.0, 3.0]]])]
    got = {r.id: (r.area, r.perimeter) for r in geodesy.geodesic_figures(spark.createDataFrame(rows, "id int, rings array<array<array<double>>>")).collect()}
    assert got[1][0] == pytest.approx(zone(20, 10, 30), rel=1e-6) and got[2][0] == pytest.approx(zone(20, -40, 20), rel=1e-6)
    assert got[5][0] == pytest.approx(zone(20, 0, 20) - zone(20, 5, 10), rel=1e-6)
    assert got[3] == (None, None) and got[4] == (0.0, 0.0) and got[6][0] == pytest.approx(0, abs=1e-3)


@pytest.mark.parametrize("eight", [False, True])
def test_figures_across_seams_equal_those_of_all_sides(spark, kept, eight):
    rng, size = np.random.default_rng(5), 5
    rows = [(tr, tc, r, c, int(v)) for k, tr, tc in ((0.45, 0, 0), (0.6, 0, 1), (0.7, 1, 0), (0.5, 1, 1), (1.1, 2, 0), (0.6, 2, 1), (0.8, -1, 0)) for (r, c), v in np.ndenumerate(rng.random((size, size)) < k)]
    df = spark.createDataFrame(rows, "tile_row long, tile_col long, row int, col int, mask int")
    found = lambda f: sorted(map(tuple, f.select("object", "ring", "area", "perimeter", "corners").collect()))
    want = found(outlines.ring_figures(outlines.seam_outlines(df, size, kept, eight=eight), "object"))
    assert found(outlines.seam_figures(df, size, kept, eight=eight)) == want and len(want) > 5
    assert outlines.seam_figures(df.filter("false"), size, kept).count() == 0
