"""Suites: integrity checks as one table of findings, and the validation of an epoch end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import catalog, metrics, raster
from ..schema import CLASSES


def least(bad: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The least keys, without gathering all of them."""
    return bad.select(key).orderBy(key).limit(n)


def catalog_suite(tiles: DataFrame, splits: DataFrame) -> DataFrame:
    """All rules over a catalog (tile_id, region, train_class, ...) and its split map; n_bad = 0 means that a rule holds."""
    key = tiles.select("tile_id", "region", "train_class")
    rules = [
        ("class_values", "error", key.filter(F.col("train_class").isNull() | ~F.col("train_class").isin(*CLASSES)), "tile_id"),
        ("unique_ids", "error", catalog.duplicates(key, "tile_id"), "tile_id"),
        ("blank_regions", "error", key.filter(catalog.is_blank(F.col("region"))), "tile_id"),
        ("unassigned_regions", "warning", key.select("region").distinct().join(splits, "region", "left_anti"), "region"),
        ("unknown_regions", "warning", splits.select("region").distinct().join(key, "region", "left_anti"), "region"),
        ("leaked_regions", "error", catalog.leakage(splits), "region"),
    ]
    out = []
    for name, severity, bad, column in rules:
        n = bad.agg(F.count("*").alias("n_bad"))
        sample = least(bad, column).agg(F.concat_ws(",", F.array_sort(F.collect_list(F.col(column).cast("string")))).alias("sample"))
        out.append(n.crossJoin(sample).select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), "n_bad", "sample"))  # one row each
    return reduce(DataFrame.unionByName, out)


def validate_epoch(pixels: DataFrame, tiles: DataFrame, threshold: float = 0.5, ratios: tuple[int, ...] = metrics.RATIOS) -> DataFrame:
    """(metric, value) of an epoch: pixel and object counts and rates, average precision at each ratio and their geometric mean.

    pixels: tile_id, row, col, score, label; tiles: tile_id, is_pos.
    """
    px = metrics.pixel_counts(pixels, threshold)
    pairs = lambda df, cols, p="": df.select(F.explode(F.array(*(F.struct(F.lit(p + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols))).alias("x")).select("x.*")
    ob = raster.object_counts(pixels, threshold).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ob = ob.withColumn("precision", metrics.ratio(tp, tp + fp)).withColumn("recall", metrics.ratio(tp, tp + fn)).withColumn("f1", metrics.ratio(2 * tp, 2 * tp + fp + fn))
    ap = metrics.ap_at_ratios(pixels, tiles, ratios)
    at = ap.select(F.concat(F.lit("ap_1_"), F.col("ratio").cast("string")).alias("metric"), F.col("ap").alias("value"))
    mean = ap.agg(metrics.geomean(F.col("ap")).alias("value")).select(F.lit("ap_geomean").alias("metric"), "value")
    return pairs(px, ["iou", "f1", "precision", "recall"]).union(pairs(ob, ["tp", "fp", "fn", "precision", "recall", "f1"], "object_")).union(at).union(mean)


def _epoch(s: SparkSession, d: str) -> DataFrame:
    g = raster._grid(s, d)
    tiles = g.groupBy("tile_id").agg((F.max("tile_id") % 4 == 0).alias("is_pos"))
    return validate_epoch(g, tiles, ratios=(1, 2, 5)).select("metric", F.round("value", 6).alias("value"))


QUERIES = {
    "m02_epoch_validation": _epoch,
    "m20_catalog_suite": lambda s, d: catalog_suite(schema.catalog(s, d), schema.split_map(s)),
}
W_ = f"WITH {schema.CATALOG_SQL}, {schema.SPLITS_SQL}"
_row = lambda n, v, q, c: f"SELECT '{n}' AS \"check\", '{v}' AS severity, count(*) AS n_bad, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT {c}::VARCHAR AS k FROM ({q}) ORDER BY {c} LIMIT 5)), '') AS sample FROM ({q})"
_PAIRS = lambda cols, src, p="": " UNION ALL ".join(f"SELECT '{p}{c}' AS metric, {c}::DOUBLE AS value FROM {src}" for c in cols)
_RATES = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
SQL = {
    "m02_epoch_validation": f"""WITH RECURSIVE {raster.GRID}, {raster.MATCHED}, pix AS (SELECT tile_id, label, v / 16 AS score FROM grid), val AS (SELECT * FROM pix WHERE label <> 255),
      t AS (SELECT DISTINCT tile_id, tile_id % 4 = 0 AS is_pos FROM grid), {metrics.DRAWS}, ap AS ({" UNION ALL ".join(metrics.ratio_sql(r, 15) for r in (1, 2, 5))}),
      px AS (SELECT *, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, {_RATES} FROM (SELECT {metrics.COUNTS} FROM val)), ob AS (SELECT *, {_RATES} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM matched))
      SELECT metric, round(value, 6) AS value FROM ({_PAIRS(("iou", "f1", "precision", "recall"), "px")} UNION ALL {_PAIRS(("tp", "fp", "fn", "precision", "recall", "f1"), "ob", "object_")}
        UNION ALL SELECT 'ap_1_' || ratio, ap FROM ap UNION ALL SELECT 'ap_geomean', exp(avg(ln(greatest(ap, 1e-12)))) FROM ap)""",
    "m20_catalog_suite": f"{W_} " + " UNION ALL ".join([
        _row("class_values", "error", "SELECT * FROM cat WHERE train_class NOT IN ('Positive', 'Negative')", "tile_id"),
        _row("unique_ids", "error", "SELECT * FROM (SELECT tile_id, count(*) OVER (PARTITION BY tile_id) AS n FROM cat) WHERE n > 1", "tile_id"),
        _row("blank_regions", "error", "SELECT * FROM cat WHERE region IS NULL OR trim(region) = ''", "tile_id"),
        _row("unassigned_regions", "warning", "SELECT DISTINCT region FROM cat WHERE region NOT IN (SELECT region FROM splits)", "region"),
        _row("unknown_regions", "warning", "SELECT DISTINCT region FROM splits WHERE region NOT IN (SELECT region FROM cat)", "region"),
        _row("leaked_regions", "error", "SELECT region FROM splits WHERE split <> 'val_balanced' GROUP BY 1 HAVING count(DISTINCT split) > 1", "region"),
    ]),
}
