"""Table functions for SQL: a tile's pixels go in as a partition of a table argument, and none or one row comes out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from .. import schema
from . import outlines, raster


@udtf(returnType="tile_id string, n_blobs int, area long, perimeter long, largest long")
class TileObjects:
    """tile_objects(TABLE(pixels) PARTITION BY tile_id [, least]): what lies in a tile's mask, or no row for a tile without a blob of `least`
    pixels. pixels: tile_id, row, col, mask, in any order; rows with a null place or mask don't count."""

    def __init__(self) -> None:
        self.tile: str | None = None
        self.at: list[tuple[int, int]] = []
        self.least = 1

    def eval(self, pixel: Row, least: int = 1) -> None:
        self.tile, self.least = None if pixel["tile_id"] is None else str(pixel["tile_id"]), least
        if pixel["mask"] and pixel["row"] is not None and pixel["col"] is not None:
            self.at.append((int(pixel["row"]), int(pixel["col"])))

    def terminate(self) -> Iterator[tuple]:
        if not self.at:
            return
        r, c = np.array(self.at).T
        mask = np.zeros((r.max() + 1, c.max() + 1), bool)
        mask[r, c] = True
        label = raster.components(raster.drop_small(mask, self.least))
        if label.any():
            n = np.bincount(label.ravel())[1:]
            yield self.tile, len(n), int(n.sum()), len(outlines.sides(label)[0]), int(n.max())


def register(spark: SparkSession) -> None:
    spark.udtf.register("tile_objects", TileObjects)


def tile_objects(pixels: DataFrame, least: int = 1) -> DataFrame:
    """The same of a table of pixels (tile_id, row, col, mask), by SQL."""
    spark = pixels.sparkSession
    register(spark)
    return spark.sql("SELECT * FROM tile_objects(TABLE(SELECT * FROM {pixels}) PARTITION BY (tile_id), {least})", pixels=pixels, least=least)


# --- queries -------------------------------------------------------------------------------------------------------


def _objects(s: SparkSession, d: str) -> DataFrame:
    g = raster._grid(s, d).select("tile_id", "row", "col", (raster.F.col("v") >= 13).cast("int").alias("mask"))
    return tile_objects(g, 5)


QUERIES = {"d07_tile_objects": _objects}
SQL = {
    "d07_tile_objects": raster.BLOBS.replace("FROM grid WHERE mask = 1", "FROM grid WHERE v >= 13") + ", " + raster.LARGE.format(least=5) + f""", px AS (SELECT tile_id AS k, c.col AS x, c.row AS y FROM b JOIN c USING (tile_id, root)), {outlines.AROUND.format(t='px')}
      SELECT b.tile_id::VARCHAR AS tile_id, count(*)::INT AS n_blobs, sum(b.area)::BIGINT AS area, any_value(perimeter) AS perimeter, max(b.area) AS largest FROM b JOIN around ON around.k = b.tile_id GROUP BY 1""",
}
