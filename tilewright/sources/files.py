"""Sources and sinks: catalogs, split maps, statistics, vectors, rasters, listings, reports, manifests and checkpoints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators.catalog import append_merge, split_errors
from ..operators.state_io import drop_epochs, exists, file_system, latest, replace, write_text
from . import tiles

STATS = T.StructType([
    T.StructField("dataset_version", T.StringType()), T.StructField("computed_date", T.StringType()), T.StructField("n_tiles_used", T.LongType()),
    *(T.StructField(n, T.StructType([T.StructField("channel_names", T.ArrayType(T.StringType())), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("std", T.ArrayType(T.DoubleType()))])) for n in ("rgb", "extra")),
])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog CSV in canonical form, ids as text; other class names than Positive and Negative raise ValueError."""
    columns = spark.read.csv(path, header=True).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])  # ids keep their zeros
    df = schema.canonical(spark.read.schema(text).csv(path, header=True))
    bad = [r.train_class for r in df.filter(F.col("train_class").isNull() | ~F.col("train_class").isin(*schema.CLASSES)).select("train_class").distinct().limit(10).collect()]
    if bad:
        raise ValueError(f"unknown classes: {bad}")
    return df


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(split, region) of a YAML split map, which is configuration and read on the driver."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    splits = yaml.safe_load(lines[0]) if lines else None
    if errors := split_errors(splits):
        raise ValueError("; ".join(errors))
    return schema.split_map(spark, splits)


def write_splits(splits: dict[str, list[str]], path: str, summary: dict | None = None) -> None:
    """The split map as YAML, and what split_report() says of it as JSON beside it."""
    if summary is not None:
        write_metrics(summary, f"{path}.summary.json")
    write_text(SparkSession.active(), path, yaml.safe_dump(splits, sort_keys=True))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS).json(path, multiLine=True)


def stats_vectors(stats: DataFrame, with_extra: bool) -> DataFrame:
    """(names, mean, std): RGB, then EXTRA; asking for EXTRA where there is none raises when read."""
    if not with_extra:
        return stats.select(*(F.col(f"rgb.{c}").alias(n) for c, n in (("channel_names", "names"), ("mean", "mean"), ("std", "std"))))
    part = lambda c: F.concat(f"rgb.{c}", F.when(F.col("extra").isNotNull(), F.col(f"extra.{c}")).otherwise(F.raise_error(F.lit("no EXTRA statistics"))))
    return stats.select(part("channel_names").alias("names"), part("mean").alias("mean"), part("std").alias("std"))


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON document."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, kind, rings) for each feature of collections, or of files with a feature in each line; of a multipolygon a row
    for each part."""
    poly = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    feature = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    doc = f"struct<type:string,features:array<{feature}>,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    # a whole collection is one document; features one a line are split among tasks
    text = spark.read.text(path)
    if text.filter(F.col("value").rlike(r"\S")).select(F.from_json("value", "type string").alias("j")).filter("j.type is null").limit(1).count():
        text = spark.read.text(path, wholetext=True)
    docs = text.select(F.from_json("value", doc).alias("d")).filter("d is not null")
    raw = docs.select(F.explode(F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(F.array(F.struct("d.type", "d.properties", "d.geometry")))).alias("f"))
    kind, xy = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "MultiPolygon", F.from_json(xy, T.ArrayType(poly))).when(kind == "Polygon", F.array(F.from_json(xy, poly))).otherwise(F.array(F.array(F.array(F.from_json(xy, T.ArrayType(T.DoubleType()))))))
    return raw.select(F.col("f.properties").alias("properties"), kind.alias("kind"), F.explode(parts).alias("rings"))


def write_geojson(df: DataFrame, path: str) -> None:
    """A feature for each row, one line each, which read_geojson() reads back: columns but rings become properties."""
    props = F.struct(*(c for c in df.columns if c != "rings"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)


def assemble(features: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Features with the row of a mapping table that names them; others vanish."""
    return features.withColumn(key, F.col("properties")[key]).join(mapping, key)


def read_rasters(spark: SparkSession, path: str, bands: Sequence[int] | None = None, windows: DataFrame | None = None, size: int = 512) -> DataFrame:
    """(tile_id, height, width, transform, epsg, names, data): TIFF tiles, of which only the wanted bands are kept; a file that can't be
    read has an error instead. data: float32, band by band. windows (tile_id, row, col): only the files named there, and of each the
    window of size from that corner.

    Tasks open the files themselves and read the directory and the blocks that are wanted by their ranges; what is listed, joined and dealt out
    are names. In a store that only Spark opens the files come whole, as binary rows.
    """
    wanted, part = None if bands is None else list(bands), windows is not None
    try:
        tiles.opened(path)
        content = False
    except ValueError:
        content = True

    def decode(batches):
        for b in batches:
            rows, held = [], 0
            for tile, at, row, col in zip(*(c.to_pylist() for c in b.columns), *([None] * b.num_rows,) * (0 if part else 2), strict=True):
                rows.append(tiles.read_tile(tile, at, wanted, (int(row), int(col), size, size) if part else None))
                held += len(rows[-1][6] or b"")
                if held >= tiles.BATCH_BYTES:
                    yield tiles.batch(rows)
                    rows, held = [], 0
            if rows:
                yield tiles.batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("tile_id"), F.col("content" if content else "path").alias("at"))
    if not content:
        # the scan counts 4 MB for opening a file, so small ones come some 30 to a task, which takes longer to start than to read them
        n = files.rdd.getNumPartitions()
        files = files.coalesce(max(1, n // 8, min(n, 4 * spark.sparkContext.defaultParallelism)))
    if part:
        files = files.join(windows.filter("row is not null and col is not null").select("tile_id", "row", "col"), "tile_id").select("tile_id", "at", "row", "col")
    return files.mapInArrow(decode, tiles.SCHEMA)


def listing(spark: SparkSession, path: str, suffix: str = "tif") -> DataFrame:
    """(tile_id, path, length) of the files of a folder, without what lies below it; only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "false").load(path)
    return files.select(F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1).alias("tile_id"), "path", "length")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, is_dir, length) of what lies directly in a folder; names only, nothing is read."""
    fs, p = file_system(spark, path)
    found = [(str(f.getPath().getName()), bool(f.isDirectory()), int(f.getLen())) for f in fs.listStatus(p)]
    return spark.createDataFrame(found, "name string, is_dir boolean, length long")


def read_tile_list(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """(tile_id) of a CSV that names tiles, whatever else it has; ids as text, once each and never blank."""
    columns = spark.read.csv(path, header=True).columns
    name = column or schema.first_present(columns, schema.SPELLINGS["tile_id"])
    if name not in columns:
        raise ValueError(f"no tile ids among {columns}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    ids = spark.read.schema(text).csv(path, header=True).select(F.trim(F.col(f"`{name}`")).alias("tile_id"))
    return ids.filter("tile_id is not null and tile_id <> ''").distinct()


def write_rasters(rasters: DataFrame, path: str, overviews: int = 0) -> None:
    """A tiled TIFF for each row (tile_id, height, width, transform, epsg, names, data: float32) below a path or URI, with overviews; others that lie
    there stay. Files take their places when all tasks have succeeded; a job that fails leaves none."""
    tiles.register(rasters.sparkSession)
    columns = ["tile_id", "height", "width", "transform", "epsg", "names", "data"]
    rows = rasters.filter("data is not null").select(*columns)
    rows.write.format("tiles").mode("append").option("overviews", str(overviews)).save(path)


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under a key: read if it was written whole, else made and written."""
    path = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_lr_range(steps: DataFrame, path: str, part_rows: int = 1_000_000) -> None:
    """(global_step, lr, loss) as CSV parts whose names follow the order of steps: each task sorts a range of about part_rows."""
    parts = max(1, -(-steps.count() // part_rows))
    steps.select("global_step", "lr", "loss").repartitionByRange(parts, "global_step").sortWithinPartitions("global_step").write.mode("overwrite").csv(path, header=True)


def append_csv(spark: SparkSession, new: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Old and new rows in one file set under the given columns; it is written beside the old one and then takes its place."""
    path = path.rstrip("/")
    merged = append_merge(spark.read.csv(path, header=True), new, columns) if exists(spark, path) else new.select(*columns)
    merged.write.mode("overwrite").csv(f"{path}.new", header=True)
    replace(spark, f"{path}.new", path)


def drift_report(drift: DataFrame, path: str) -> int:
    """Writes the report; 2 if any channel is concerning, else 0."""
    drift.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return 2 if drift.agg(F.coalesce(F.max(F.col("concerning").cast("int")), F.lit(0))).first()[0] else 0


def write_by_region(df: DataFrame, path: str, region: str = "region") -> None:
    df.write.mode("overwrite").partitionBy(region).parquet(path)


def write_metrics(metrics: dict, path: str) -> None:
    write_text(SparkSession.active(), path, json.dumps(metrics, indent=1, sort_keys=True))


def save_checkpoint(df: DataFrame, path: str, epoch: int, keep: int = 3) -> list[int]:
    """Writes an epoch's state under its number by Spark's commit protocol, then deletes older ones; returns the epochs that are kept."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    drop_epochs(df.sparkSession, path, keep)
    return latest(df.sparkSession, path, keep)


def load_checkpoint(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/epoch={epoch}")


def log_metrics(df: DataFrame, path: str) -> None:
    """Appends (run_id, epoch, metric, value)."""
    df.select("run_id", "epoch", "metric", "value").write.mode("append").parquet(path)


def feasibility(multi_scale: dict, variants: dict[str, dict[str, float]], gates: dict) -> dict:
    """The feasibility of inference as one document: figures of several scales, those of each variant of augmentation, the gates, and what
    they recommend: the cheapest variant (in the given order) that passes, else the first."""
    gain, drop = gates["least_gain"], gates["most_drop"]
    names = list(variants)
    base = variants[names[0]]
    passed = [n for n in names[1:] if variants[n]["pr_auc"] - base["pr_auc"] >= gain and base["precision"] - variants[n]["precision"] <= drop]
    large = multi_scale["multi_pr_auc"] - multi_scale["baseline_pr_auc"]
    ok = large >= gates["least_large_gain"] and multi_scale["fp_rate_delta"] <= gates["most_fp_delta"]
    return {"multi_scale": {**multi_scale, "gain": large, "passed": ok, "scales": [1.0, 0.5] if ok else [1.0]}, "variants": variants, "gates": gates, "recommended": passed[0] if passed else names[0]}


def write_feasibility(report: dict, path: str) -> None:
    """The document as JSON, and as a table for readers beside it."""
    write_metrics(report, f"{path}.json")
    m = report["multi_scale"]
    lines = ["# Feasibility", "", *(f"* {k}: {v}" for k, v in sorted(m.items())), "", "| Variant | PR-AUC | Precision |", "|---|---|---|"]
    lines += [f"| {n} | {v['pr_auc']:.4f} | {v['precision']:.4f} |" for n, v in report["variants"].items()] + ["", f"Recommended: {report['recommended']}", ""]
    write_text(SparkSession.active(), f"{path}.md", "\n".join(lines))
