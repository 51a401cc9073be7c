"""Tables of the data model, their canonical spellings, and the binding of the driver's tables to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("tile_id", T.StringType()), T.StructField("centroid_lat", T.DoubleType()), T.StructField("centroid_lon", T.DoubleType()),
    T.StructField("train_class", T.StringType()), T.StructField("region", T.StringType()), T.StructField("uids", T.ArrayType(T.StringType())),
])
CATALOG_COLUMNS = ("Tile_ID", "centroid_lat", "centroid_lon", "TrainClass", "RegionName", "UIDs")
CLASSES = ("Positive", "Negative")
NO_UID = "9999"
IGNORE = 255
SPLIT_NAMES = ("train", "val_balanced", "val_realistic", "test_realistic")
#: A split that repeats another one's regions on purpose.
ALIASES = {"val_balanced": "val_realistic"}

#: Both spellings of each catalog column.
SPELLINGS = {
    "tile_id": ("Tile_ID", "Tile_id", "tile_id"), "centroid_lat": ("centroid_lat",), "centroid_lon": ("centroid_lon",),
    "train_class": ("TrainClass", "train_class"), "region": ("RegionName", "region"), "uids": ("UIDs", "uids"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys to parts of about `rows` rows. Small files come as one part, however many rows are made of theirs; adaptive
    execution, which joins parts of few bytes, leaves a given number as it is."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate among the columns."""
    return next((c for c in candidates if c in columns), None)


def uid_list(raw: Column) -> Column:
    """A comma-separated list of ids as an array: trimmed, without blanks and the placeholder 9999."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda u: (u != "") & (u != NO_UID))


def canonical(df: DataFrame) -> DataFrame:
    """A catalog in any accepted spelling, as CATALOG plus its optional columns. Raises ValueError for missing columns."""
    found = {name: first_present(df.columns, c) for name, c in SPELLINGS.items()}
    if missing := [k for k, v in found.items() if v is None]:
        raise ValueError(f"missing catalog columns: {', '.join(missing)}")
    c = {k: F.col(f"`{v}`") for k, v in found.items()}
    uids = c["uids"] if isinstance(df.schema[found["uids"]].dataType, T.ArrayType) else uid_list(c["uids"].cast("string"))
    more = [F.col(f"`{x}`") for x in df.columns if x not in found.values()]
    return df.select(
        c["tile_id"].cast("string").alias("tile_id"), c["centroid_lat"].cast("double").alias("centroid_lat"), c["centroid_lon"].cast("double").alias("centroid_lon"),
        F.initcap(F.trim(c["train_class"])).alias("train_class"), c["region"].alias("region"), uids.alias("uids"), *more,
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile catalog that the driver's tables stand for: orders by the nation of their customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    cls = F.when(F.col("o_orderstatus") == "F", "Positive").otherwise("Negative")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("o_orderkey").alias("tile_id"), cls.alias("train_class"), F.col("n_name").alias("region"), F.col("r_name").alias("ecoregion"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))
    )


CATALOG_SQL = """cat AS (SELECT o_orderkey AS tile_id, CASE WHEN o_orderstatus = 'F' THEN 'Positive' ELSE 'Negative' END AS train_class,
  n_name AS region, r_name AS ecoregion, o_orderdate AS day, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: The split map of the queries; NATION_24 stays unassigned and NATION_99 is unknown to the catalog.
SPLITS: dict[str, list[str]] = {
    "train": [f"NATION_{i}" for i in range(15)], "val_balanced": [f"NATION_{i}" for i in range(15, 19)],
    "val_realistic": [f"NATION_{i}" for i in range(15, 19)], "test_realistic": [f"NATION_{i}" for i in range(19, 24)] + ["NATION_99"],
}


def split_map(spark: SparkSession, splits: dict[str, list[str]] = SPLITS) -> DataFrame:
    """(split, region), a row for each region of each split; as long as the configuration."""
    return spark.createDataFrame([(s, r) for s, rs in splits.items() for r in rs], "split string, region string")


SPLITS_SQL = "splits(split, region) AS (VALUES " + ", ".join(f"('{s}', '{r}')" for s, rs in SPLITS.items() for r in rs) + ")"
