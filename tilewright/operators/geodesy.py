"""Areas and lengths on the ellipsoid: polygons whose edges are geodesics.

The inverse problem is solved for all edges of a batch at once by Vincenty's iteration on the auxiliary sphere. The area between an edge and
the equator is c^2 times the difference of its azimuths there plus an integral along the edge in which the ellipsoid differs from the sphere; its
integrand is smooth, and Gauss-Legendre nodes on each edge give it to rounding. Nearly antipodal ends, for which the
iteration doesn't settle, give NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

#: Fixed values of the WGS 84 ellipsoid: half the great axis in metres, and the flattening.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
#: The square of the radius of the sphere with the ellipsoid's area.
C2 = float(A * A / 2 + B * B / 2 * np.arctanh(np.sqrt(E2)) / np.sqrt(E2))
NODES, WEIGHTS = np.polynomial.legendre.leggauss(20)
ROUNDS, NEAR = 200, 1e-14


def inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length in metres, area in square metres between edge and equator) of geodesics between points in degrees. The area is positive for edges
    that go east north of the equator."""
    lon = np.radians((np.asarray(lon2, float) - lon1 + 180) % 360 - 180)
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(np.asarray(x, float)))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = lon.copy(), np.zeros(lon.shape, bool)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            sl, cl = np.sin(lam), np.cos(lam)
            ss, cs = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl), s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sin_a = np.where(ss > 0, c1 * c2 * sl / np.where(ss > 0, ss, 1), 0.0)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a > 1e-24, cs - 2 * s1 * s2 / np.where(cos2_a > 1e-24, cos2_a, 1), 0.0)  # an edge along the equator has no middle
            c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
            new = lon + (1 - c) * FLAT * sin_a * (sigma + c * ss * (mid + c * cs * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < NEAR
            lam = new
            if settled.all():
                break
        k = EP2 * cos2_a
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        less = small * ss * (mid + small / 4 * (cs * (2 * mid**2 - 1) - small / 6 * mid * (4 * ss**2 - 3) * (4 * mid**2 - 3)))
        length = np.where((np.abs(lam) <= np.pi) & (settled | (np.abs(new - lam) < 1e-12)), B * big * (sigma - less), np.nan)
        a1 = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
        a2 = np.arctan2(c1 * np.sin(lam), -s1 * c2 + c1 * s2 * np.cos(lam))
        area = _beyond_sphere(s1, c1, a1, sigma) - C2 * _turn(s1, c1, s2, c2, lam, a1, a2)
    area = np.where(sigma > 0, area, 0.0)
    return np.where(sigma > 0, length, 0.0), np.where(np.isnan(length), np.nan, area)


def _turn(s1, c1, s2, c2, lam, a1, a2) -> np.ndarray:
    """Azimuth at the end less that at the start, by tangents of half angles, which keeps short edges exact."""
    t1, t2 = s1 / (1 + c1), s2 / (1 + c2)
    half = np.tan(lam / 2) * (t1 + t2) / (1 + t1 * t2)
    exact = 2 * np.arctan(half)
    return np.where(np.abs(np.cos(lam / 2)) > 1e-9, exact, (a2 - a1 + np.pi) % (2 * np.pi) - np.pi)


def _t(x: np.ndarray) -> np.ndarray:
    """x + sqrt(1/x + 1) asinh(sqrt x), which is 1 at 0."""
    root = np.sqrt(np.maximum(x, 0))
    return x + np.where(root > 1e-8, np.sqrt(1 + x) * np.arcsinh(root) / np.where(root > 1e-8, root, 1), 1.0)


def _beyond_sphere(s1, c1, a1, sigma) -> np.ndarray:
    sin_0, cos_0 = np.sin(a1) * c1, np.hypot(np.cos(a1), np.sin(a1) * s1)
    start = np.arctan2(s1, np.cos(a1) * c1)
    at = start[..., None] + sigma[..., None] / 2 * (NODES + 1)
    x = EP2 * cos_0[..., None] ** 2 * np.sin(at) ** 2
    gap = EP2 - x
    quotient = np.where(np.abs(gap) > 1e-9, (_t(np.full_like(x, EP2)) - _t(x)) / np.where(np.abs(gap) > 1e-9, gap, 1), 4 / 3)
    part = -(quotient * np.sin(at) / 2 * WEIGHTS).sum(-1) * sigma / 2
    return -E2 * A * A * cos_0 * sin_0 * part


def polygon_figures(rings: pd.Series) -> pd.DataFrame:
    """(area, perimeter) of each polygon: its outer ring's area less its holes', and the length of its outer ring. Rings may be open or closed and
    go either way; fewer than three points have no area. A null polygon gives nulls. No ring goes around a pole."""
    lon, lat, of, outer = [], [], [], []
    for k, polygon in enumerate(rings):
        for j, ring in enumerate([] if polygon is None else polygon):
            lon.append(np.array([p[0] for p in ring], float))
            lat.append(np.array([p[1] for p in ring], float))
            of.append(k)
            outer.append(j == 0)
    area, around = np.zeros(len(rings)), np.zeros(len(rings))
    if of:
        n = [len(x) for x in lon]
        length, under = inverse(np.concatenate(lon), np.concatenate(lat), np.concatenate([np.roll(x, -1) for x in lon]), np.concatenate([np.roll(x, -1) for x in lat]))
        ring = np.repeat(np.arange(len(of)), n)
        a, s = np.bincount(ring, under, len(of)), np.bincount(ring, length, len(of))
        sign = np.where(outer, 1.0, -1.0)
        area = np.bincount(of, sign * np.abs(a), len(rings))
        around = np.bincount(of, np.where(outer, s, 0.0), len(rings))
    none = np.array([p is None for p in rings], bool)
    return pd.DataFrame({"area": np.where(none, None, area), "perimeter": np.where(none, None, around)}).astype("Float64" if none.any() else "float64")


def geodesic_figures(df: DataFrame, rings: str = "rings") -> DataFrame:
    """df with area (m^2) and perimeter (m) of its polygons in degrees; an Arrow pass over all edges of a batch, no shuffle."""
    figures = F.pandas_udf(polygon_figures, "area double, perimeter double")
    return df.withColumn("_f", figures(F.col(rings))).select(*df.columns, F.col("_f.area").alias("area"), F.col("_f.perimeter").alias("perimeter"))


# --- queries -------------------------------------------------------------------------------------------------------


def _sectors(s: SparkSession, d: str) -> DataFrame:
    """Sectors from the equator to a pole, whose edges are geodesics: meridians and an arc of the equator."""
    k = F.col("c_custkey")
    x, w = (k % 300 - 150).cast("double"), (1 + k % 29).cast("double")
    p: list[Column] = [F.array(x, F.lit(0.0)), F.array(x + w, F.lit(0.0)), F.array(x + w, F.lit(90.0) * F.when(k % 2 == 0, 1).otherwise(-1))]
    return schema.table(s, d, "customer").select(k.alias("id"), F.array(F.array(*p)).alias("rings"))


QUERIES = {"f39_geodesic": lambda s, d: geodesic_figures(_sectors(s, d)).select("id", F.round(F.col("area") / 1e9, 3).alias("thousand_km2"), F.round("perimeter", 1).alias("metres"))}
SQL = {
    "f39_geodesic": f"""WITH k AS (SELECT c_custkey AS id, radians((1 + c_custkey % 29)::DOUBLE) AS w FROM customer)
      SELECT id, round({C2!r} * w / 1e9, 3) AS thousand_km2, round({A!r} * w + 2 * 10001965.729312::DOUBLE, 1) AS metres FROM k""",
}
