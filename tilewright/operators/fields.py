"""Fields and cells: choosing columns, guarding names and values, cell sets on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema
from .catalog import project_fields
from .stats import check_names, finite

FLAGS = {"True": "required", "Generated": "generated", "False": "optional"}


def by_flag(fields: DataFrame, name: str = "field", flag: str = "required") -> DataFrame:
    """(kind, fields): the names of each kind of field, in order; other flags are their own kind."""
    kind = F.col(flag)
    for raw, k in FLAGS.items():
        kind = F.when(F.col(flag) == raw, k).otherwise(kind)
    return fields.groupBy(kind.alias("kind")).agg(F.concat_ws(",", F.array_sort(F.collect_list(name))).alias("fields"))


def all_finite(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Rows in which every channel is a finite number."""
    keep = F.lit(True)
    for c in channels:
        keep = keep & finite(F.col(c).cast("double")).isNotNull()
    return df.filter(keep)


def nest(df: DataFrame, **groups: Sequence[str]) -> DataFrame:
    """Columns gathered in structs by group, as a configuration's part for inference."""
    return df.select(*(F.struct(*cols).alias(name) for name, cols in groups.items()))


def cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.select(F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")).distinct()


def overlay(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Intersection or difference of two sets of grid cells, which stand for the areas."""
    return {"intersection": a.intersect, "difference": a.subtract}[how](b)


def dissolve(df: DataFrame, key: str, size: float) -> DataFrame:
    """(key, n_cells): the cells that a group of points covers, each counted once."""
    c = df.select(key, F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).distinct()
    return c.groupBy(key).agg(F.count("*").alias("n_cells"))


def compare_fields(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, status) of the fields (pos, name) of two tables that differ: missing, unexpected, or moved among those that both have. The
    windows hold the fields of one table."""
    both = found.alias("f").join(expected.alias("e"), "name", "full").select("name", F.col("f.pos").alias("a"), F.col("e.pos").alias("b"))
    common = both.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("i", F.row_number().over(W.orderBy("a"))).withColumn("j", F.row_number().over(W.orderBy("b")))
    one = both.filter("a IS NULL OR b IS NULL").select("name", F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("status"))
    return one.unionByName(common.filter("i <> j").select("name", F.lit("moved").alias("status")))


def bias_of(share: Column) -> Column:
    """The output bias that gives a share of positives before any training; a share outside 0 and 1 raises when read."""
    ok = (share > 0) & (share < 1)
    return F.when(ok, -F.ln((1 - share) / share)).otherwise(F.raise_error(F.lit("the prior must lie between 0 and 1")).cast("double"))


def grid_columns(stride: Column, tile: int, object_size: int) -> list[Column]:
    """Of strides of a grid of tiles: whether an object always lies whole in a tile, the overlap, and how many tiles more there are."""
    return [(stride <= tile - object_size).alias("fits"), F.round(1 - stride / tile, 9).alias("overlap"), F.round(F.pow(tile / stride, 2), 6).alias("multiplier")]


# --- queries -------------------------------------------------------------------------------------------------------


def _pts(s: SparkSession, d: str) -> DataFrame:
    from .spatial import _pts as points

    return points(s, d)


def _named(s: SparkSession, d: str, first: str, where: Column) -> DataFrame:
    return schema.table(s, d, "nation").filter(where).select((F.col(first) * (1 if first == "n_nationkey" else 100) + (0 if first == "n_nationkey" else F.col("n_nationkey"))).alias("pos"), F.col("n_name").alias("name"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    n = schema.table(s, d, "nation")
    return by_flag(n.select(F.col("n_name").alias("field"), F.when(F.col("n_nationkey") % 3 == 0, "True").when(F.col("n_nationkey") % 3 == 1, "Generated").otherwise("False").alias("required")))


def _first(s: SparkSession, d: str) -> DataFrame:
    o = schema.table(s, d, "orders")
    return o.groupBy(F.col(schema.first_present(o.columns, ["priority", "o_orderpriority", "o_orderstatus"])).alias("value")).agg(F.count("*").alias("n"))


QUERIES = {
    "p02_first_present": _first,
    "p07_finite_rows": lambda s, d: all_finite(schema.table(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 5 == 0, float("nan")).when(F.col("l_partkey") % 7 == 0, float("inf")).otherwise(F.col("l_tax")).alias("a"), "l_discount"), ["a", "l_discount"]).agg(F.count("*").alias("n"), F.round(F.sum("a"), 4).alias("total")),
    "p10_name_binding": lambda s, d: schema.table(s, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names")).select(F.concat_ws(",", check_names(F.col("names"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])).alias("names")),
    "p14_inference_projection": lambda s, d: nest(schema.table(s, d, "supplier"), model=["s_suppkey", "s_name"], data=["s_nationkey"]).select(F.col("model.s_name").alias("name"), F.col("data.s_nationkey").alias("key")),
    "p16_fields_by_flag": _flags,
    "p17_project_fields": lambda s, d: project_fields(schema.table(s, d, "supplier"), ["s_name", "s_missing", "s_suppkey"], ["note"]),
    "u08_cell_intersection": lambda s, d: overlay(cells(_pts(s, d).filter("cls = 0"), 2.0), cells(_pts(s, d).filter("cls = 1"), 2.0), "intersection"),
    "u08_cell_difference": lambda s, d: overlay(cells(_pts(s, d).filter("cls = 0"), 2.0), cells(_pts(s, d).filter("cls = 1"), 2.0), "difference"),
    "a30_dissolve_cells": lambda s, d: dissolve(_pts(s, d), "cls", 2.0),
    "u09_column_sets": lambda s, d: compare_fields(_named(s, d, "n_nationkey", F.col("n_regionkey") != 2), _named(s, d, "n_regionkey", F.col("n_nationkey") != 7)),
    "f36_bias_prior": lambda s, d: schema.catalog(s, d).groupBy("region").agg(F.avg((F.col("train_class") == "Positive").cast("int")).alias("prior")).filter("prior > 0 AND prior < 1").select("region", F.round("prior", 9).alias("prior"), F.round(bias_of(F.col("prior")), 9).alias("bias")),
    "f38_tile_grid": lambda s, d: schema.table(s, d, "part").select((F.col("p_size") * 10).cast("int").alias("stride")).distinct().select("stride", *grid_columns(F.col("stride"), 512, 128)),
}
PTS = "pts AS (SELECT floor((c_custkey * 7919) % 3600 / 100.0::DOUBLE / 2)::BIGINT AS cx, floor((c_custkey * 104729) % 2500 / 100.0::DOUBLE / 2)::BIGINT AS cy, c_custkey % 5 AS cls FROM customer)"
SQL = {
    "p02_first_present": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1",
    "p07_finite_rows": "SELECT count(*) AS n, round(sum(l_tax), 4) AS total FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey % 7 <> 0",
    "p10_name_binding": "SELECT string_agg(r_name, ',' ORDER BY r_name) AS names FROM region",
    "p14_inference_projection": "SELECT s_name AS name, s_nationkey AS key FROM supplier",
    "p16_fields_by_flag": "SELECT CASE n_nationkey % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'generated' ELSE 'optional' END AS kind, string_agg(n_name, ',' ORDER BY n_name) AS fields FROM nation GROUP BY 1",
    "p17_project_fields": "SELECT s_name, s_suppkey, NULL::VARCHAR AS note FROM supplier",
    "u08_cell_intersection": f"WITH {PTS} SELECT cx, cy FROM pts WHERE cls = 0 INTERSECT SELECT cx, cy FROM pts WHERE cls = 1",
    "u08_cell_difference": f"WITH {PTS} SELECT cx, cy FROM pts WHERE cls = 0 EXCEPT SELECT cx, cy FROM pts WHERE cls = 1",
    "a30_dissolve_cells": f"WITH {PTS} SELECT cls, count(DISTINCT (cx, cy)) AS n_cells FROM pts GROUP BY 1",
    "u09_column_sets": """WITH f AS (SELECT n_nationkey AS pos, n_name AS name FROM nation WHERE n_regionkey <> 2), e AS (SELECT n_regionkey * 100 + n_nationkey AS pos, n_name AS name FROM nation WHERE n_nationkey <> 7),
      c AS (SELECT name, row_number() OVER (ORDER BY f.pos) AS a, row_number() OVER (ORDER BY e.pos) AS b FROM f JOIN e USING (name))
      SELECT name, 'missing' AS status FROM e WHERE name NOT IN (SELECT name FROM f) UNION ALL SELECT name, 'unexpected' FROM f WHERE name NOT IN (SELECT name FROM e) UNION ALL SELECT name, 'moved' FROM c WHERE a <> b""",
    "f36_bias_prior": f"WITH {schema.CATALOG_SQL} SELECT region, round(p, 9) AS prior, round(-ln((1 - p) / p), 9) AS bias FROM (SELECT region, avg((train_class = 'Positive')::INT) AS p FROM cat GROUP BY 1) WHERE p > 0 AND p < 1",
    "f38_tile_grid": "SELECT DISTINCT p_size * 10 AS stride, p_size * 10 <= 384 AS fits, round(1 - p_size * 10 / 512, 9) AS overlap, round(pow(512 / (p_size * 10), 2), 6) AS multiplier FROM part",
}
