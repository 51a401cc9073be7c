"""Scene collections and pixel grids in files: the filters of a remote imagery catalog as pushed-down scans.

A scene is a row (scene_id, ts, min_lon, min_lat, max_lon, max_lat, properties...); its pixels are rows (scene_id, band, x, y, value) in
map units.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scenes(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, dates: tuple[str, str] | None = None, equal: Mapping[str, object] | None = None, below: Mapping[str, float] | None = None, has: Mapping[str, str] | None = None) -> DataFrame:
    """Scenes that touch bounds (min_lon, min_lat, max_lon, max_lat), from the first date up to but without the second, with the given
    properties: equal to a value, below one, or an array that has one. Comparisons reach the Parquet scan."""
    df = spark.read.parquet(path)
    if bounds is not None:
        lo_x, lo_y, hi_x, hi_y = bounds
        df = df.filter((F.col("min_lon") <= hi_x) & (F.col("max_lon") >= lo_x) & (F.col("min_lat") <= hi_y) & (F.col("max_lat") >= lo_y))
    if dates is not None:
        df = df.filter((F.col("ts") >= F.lit(dates[0]).cast("timestamp")) & (F.col("ts") < F.lit(dates[1]).cast("timestamp")))
    for name, v in (equal or {}).items():
        df = df.filter(F.col(name) == v)
    for name, v in (below or {}).items():
        df = df.filter(F.col(name) < v)
    for name, v in (has or {}).items():
        df = df.filter(F.array_contains(name, v))
    return df


@dataclass(frozen=True)
class Grid:
    """Pixels of size `scale` from a top left corner; rows count down."""

    x: float
    y: float
    scale: float
    width: int
    height: int


def band_groups(bands: Sequence[str], grid: Grid, bytes_per_value: int = 4, most_bytes: int = 48 << 20) -> list[list[str]]:
    """The bands in groups whose pixels stay under a payload; one band may be larger than that."""
    n = max(1, most_bytes // max(1, grid.width * grid.height * bytes_per_value))
    return [list(bands[i : i + n]) for i in range(0, len(bands), n)]


def fetch_pixels(pixels: DataFrame, scenes: DataFrame, grid: Grid, bands: Sequence[str]) -> DataFrame:
    """(scene_id, band, row, col, value) of the scenes' pixels in a grid: the pixel at whose place a value lies; of several the mean."""
    row, col = F.floor((grid.y - F.col("y")) / grid.scale).cast("int"), F.floor((F.col("x") - grid.x) / grid.scale).cast("int")
    inside = pixels.filter(F.col("band").isin(*bands) & F.col("x").between(grid.x, grid.x + grid.width * grid.scale) & F.col("y").between(grid.y - grid.height * grid.scale, grid.y))
    at = inside.join(scenes.select("scene_id"), "scene_id", "left_semi").select("scene_id", "band", row.alias("row"), col.alias("col"), "value")
    at = at.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return at.groupBy("scene_id", "band", "row", "col").agg(F.avg("value").alias("value"))
