"""Catalog operators: membership, lookups, counts, set algebra and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema
from ..schema import ALIASES, CATALOG_SQL, CLASSES, SPLITS, SPLITS_SQL


def tiles_of(catalog: DataFrame, splits: DataFrame, split: str, cls: str | None = None) -> DataFrame:
    """Sorted ids of the tiles whose region belongs to the split, of one class if given. The split must be known."""
    if split not in {r.split for r in splits.select("split").distinct().collect()}:  # as long as the configuration
        raise ValueError(f"unknown split {split!r}")
    own = catalog if cls is None else catalog.filter(F.col("train_class") == cls)
    return own.join(splits.filter(F.col("split") == split).select("region"), "region", "left_semi").select("tile_id").orderBy("tile_id")


def enum_violations(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values that aren't allowed, with their counts."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(F.col(column).alias("value")).count().withColumnRenamed("count", "n")


def out_of_range(lat: Column, lon: Column) -> Column:
    """'error' outside the globe, 'warning' south of 50 degrees, else null."""
    return F.when(~lat.between(-90, 90) | ~lon.between(-180, 180), "error").when(lat < 50, "warning")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def is_large(edge: Column, least: float = 500.0) -> Column:
    """Whether a bounding-box edge, of any type, is at least `least` metres; missing or unreadable: false."""
    return F.coalesce(edge.try_cast("double") >= least, F.lit(False))


def lookup_class(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """ids with their class; an id that the catalog doesn't have, or with another class, raises when read."""
    found = ids.join(catalog.select("tile_id", "train_class"), "tile_id", "left")
    ok = F.coalesce(F.col("train_class").isin(*CLASSES), F.lit(False))
    return found.withColumn("train_class", F.when(ok, F.col("train_class")).otherwise(F.raise_error(F.concat(F.lit("no class for tile "), F.col("tile_id").cast("string")))))


def with_split(catalog: DataFrame, splits: DataFrame) -> DataFrame:
    """Each tile with each split of its region; tiles of unassigned regions keep a null split."""
    return catalog.join(splits, "region", "left")


def with_ecoregion(regions: DataFrame, eco: DataFrame) -> DataFrame:
    """regions (region) with their ecoregion; a region that eco doesn't name is its own."""
    return regions.join(eco, "region", "left").withColumn("ecoregion", F.coalesce("ecoregion", "region"))


GEOMETRY = ("transform", "epsg", "bounds")


def stack_modalities(rgb: DataFrame, extra: DataFrame | None, label: DataFrame, keys: Sequence[str] = ("tile_id", "row", "col")) -> DataFrame:
    """Pixels with all modalities side by side; where a column of GEOMETRY is given on several sides it must agree, else reading the rows
    raises.

    A missing label counts as background, as negative tiles have no label raster.
    """
    keys, out = list(keys), rgb
    for name, side, how in (("extra", extra, "inner"), ("label", label, "left")):
        if side is None:
            continue
        shared = [c for c in GEOMETRY if c in out.columns and c in side.columns]
        out = out.join(side.withColumnsRenamed({c: f"_{c}" for c in shared}), keys, how)
        for c in shared:
            agrees = F.col(f"_{c}").isNull() | F.col(c).eqNullSafe(F.col(f"_{c}"))
            out = out.withColumn(c, F.when(agrees, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} of {name} differs")).cast(out.schema[c].dataType))).drop(f"_{c}")
    return out.withColumn("label", F.coalesce("label", F.lit(0)))


def resume(todo: DataFrame, done: DataFrame, lat: str = "centroid_lat", lon: str = "centroid_lon", digits: int = 6) -> DataFrame:
    """Rows of todo whose rounded centroid isn't done yet, one for each centroid (the least id)."""
    key = lambda df: df.withColumn("_lat", F.round(lat, digits)).withColumn("_lon", F.round(lon, digits))
    left = key(todo).join(key(done).select("_lat", "_lon"), ["_lat", "_lon"], "left_anti")
    first = F.row_number().over(W.partitionBy("_lat", "_lon").orderBy("tile_id"))
    return left.withColumn("_n", first).filter("_n = 1").drop("_n", "_lat", "_lon")


def class_counts() -> list[Column]:
    return [F.count_if(F.col("train_class") == "Positive").alias("positive"), F.count_if(F.col("train_class") == "Negative").alias("negative"), F.count("tile_id").alias("total")]


def region_stats(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("region").agg(*class_counts())


def split_summary(catalog: DataFrame, splits: DataFrame) -> DataFrame:
    """Counts of each split, of empty ones too. Tiles are counted by region first, so the split map joins a short table."""
    per = region_stats(catalog)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "positive", "negative")]
    return splits.join(per, "region", "left").groupBy("split").agg(*sums, F.count_distinct("region").alias("n_regions"))


def split_ecoregions(catalog: DataFrame, splits: DataFrame) -> DataFrame:
    per = catalog.groupBy("region", "ecoregion").agg(*class_counts())
    return splits.join(per, "region", "left").groupBy("split").agg(
        F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"), F.count_distinct("ecoregion").alias("n_ecoregions"),
        F.concat_ws(",", F.sort_array(F.collect_set("region"))).alias("regions"), F.concat_ws(",", F.sort_array(F.collect_set("ecoregion"))).alias("ecoregions"))


def class_pivot(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("region").pivot("train_class", list(CLASSES)).count().na.fill(0)


def class_ratio(catalog: DataFrame) -> DataFrame:
    """Totals, share of positives in percent and the ratio 1:x, N/A without positives."""
    c = catalog.agg(*class_counts())
    ratio = F.when(F.col("positive") > 0, F.format_string("1:%.2f", F.col("negative") / F.col("positive"))).otherwise("N/A")
    return c.withColumn("positive_pct", F.round(F.coalesce(F.try_divide(F.col("positive") * 100.0, "total"), F.lit(0.0)), 6)).withColumn("ratio", ratio)


def coverage(shares: DataFrame, share: str) -> DataFrame:
    """Counts of shares up to 10, up to 50 and above 50 percent."""
    c = F.col(share)
    return shares.agg(F.count_if(c <= 10).alias("low"), F.count_if((c > 10) & (c <= 50)).alias("middle"), F.count_if(c > 50).alias("high"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("n", F.count("*").over(W.partitionBy(*keys))).filter("n > 1")


def compare_sets(a: DataFrame, b: DataFrame, key: str, first: int = 5) -> DataFrame:
    """What one side has and the other lacks: side, count and the first ids, in one full outer join."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, key, "full_outer").filter("_a is null or _b is null").select(F.when(F.col("_a").isNull(), "right_only").otherwise("left_only").alias("side"), key)
    top = both.withColumn("_n", F.row_number().over(W.partitionBy("side").orderBy(key))).filter(F.col("_n") <= first)  # limited before the shuffle
    top = top.groupBy("side").agg(F.concat_ws(",", F.array_sort(F.collect_list(key))).alias("first_ids"))
    return both.groupBy("side").agg(F.count("*").alias("n")).join(top, "side")


def leakage(splits: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Regions in more than one split, with intended copies of a split counting as that split."""
    s = F.col("split")
    for name, of in aliases.items():
        s = F.when(F.col("split") == name, of).otherwise(s)
    return splits.withColumn("_s", s).groupBy("region").agg(F.count_distinct("_s").alias("n_splits")).filter("n_splits > 1")


def compare_columns(columns: Sequence[str], expected: Sequence[str]) -> dict[str, list[str] | bool]:
    own = [c for c in columns if c in expected]
    return {"missing": [c for c in expected if c not in columns], "unexpected": [c for c in columns if c not in expected], "ordered": own == [c for c in expected if c in columns]}


def split_errors(splits: dict | None) -> list[str]:
    """What is wrong with the shape of a split map: every value has to be a list of strings under a known name."""
    if not isinstance(splits, dict):
        return ["the split map isn't a mapping"]
    out = [f"missing split {n}" for n in schema.SPLIT_NAMES if n not in splits]
    for name, regions in splits.items():
        if name not in schema.SPLIT_NAMES:
            out.append(f"unknown split {name}")
        if not isinstance(regions, list) or not all(isinstance(r, str) for r in regions):
            out.append(f"{name} isn't a list of names")
    return out


def split_shape(splits: DataFrame) -> DataFrame:
    """(error) of a split map as rows (split, value: JSON): the same rules where the map comes as a table."""
    names = splits.sparkSession.createDataFrame([(n,) for n in schema.SPLIT_NAMES], "split string")
    missing = names.join(splits, "split", "left_anti").select(F.concat(F.lit("missing split "), "split").alias("error"))
    regions = F.from_json("value", "array<string>")
    listed = F.trim("value").startswith("[") & regions.isNotNull() & ~F.exists(F.coalesce(regions, F.array().cast("array<string>")), lambda r: r.isNull())
    wrong = F.array(F.when(~F.col("split").isin(*schema.SPLIT_NAMES), F.concat(F.lit("unknown split "), "split")), F.when(~F.coalesce(listed, F.lit(False)), F.concat("split", F.lit(" isn't a list of names"))))
    return missing.unionByName(splits.select(F.explode(wrong).alias("error")).filter("error IS NOT NULL"))


def project_fields(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The fields in order: required ones that are there, optional ones as null where they are missing."""
    have = [F.col(c) for c in required if c in df.columns]
    return df.select(*have, *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional))


def append_merge(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True).select(*columns)


def merge_uids(main: DataFrame, edits: DataFrame, key: str = "tile_id") -> DataFrame:
    """main with the ids that edits assign; rows without an edit stay."""
    e = edits.select(key, F.col("uid").alias("_uid"))
    return main.join(e, key, "left").withColumn("uid", F.coalesce("_uid", "uid")).drop("_uid")


# --- queries -------------------------------------------------------------------------------------------------------


def _cat(f):
    return lambda spark, d: f(schema.catalog(spark, d), schema.split_map(spark))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return schema.table(spark, d, "events")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Market segments as splits of the nations whose customers are in them."""
    n = schema.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    return schema.table(spark, d, "customer").select("c_nationkey", F.col("c_mktsegment").alias("split")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("split", "region")


def _uids(spark, d):
    """Distinct words of the part names as ids."""
    p = schema.table(spark, d, "part").select(F.explode(schema.uid_list(F.regexp_replace("p_name", " ", ", "))).alias("uid"))
    return p.agg(F.count_distinct("uid").alias("n_uids"))


QUERIES = {
    "p01_split_members": _cat(lambda c, s: tiles_of(c, s, "train", "Positive")),
    "p03_enum_violation": lambda spark, d: enum_violations(schema.table(spark, d, "orders"), "o_orderstatus", ["F", "O"]),
    "p04_range_checks": lambda spark, d: schema.table(spark, d, "customer").select("c_custkey", out_of_range(F.col("c_acctbal") / 50, F.col("c_acctbal") / 40).alias("severity")).filter("severity is not null"),
    "p05_blank_strings": lambda spark, d: schema.table(spark, d, "part").select(F.nullif(F.substring("p_name", 1, 3), F.lit("red")).alias("x")).agg(F.count_if(is_blank(F.col("x"))).alias("n_blank"), F.count("*").alias("n")),
    "p11_recode": lambda spark, d: schema.table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderkey") % 4 == 0, -100.0).when(F.col("o_orderkey") % 4 == 1, 100.0).otherwise(F.lit(0.0)).alias("lon")),
    "p13_large_tiles": lambda spark, d: schema.table(spark, d, "customer").select("c_custkey", is_large(F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))).alias("large")),
    "p18_positive_flagged": lambda spark, d: schema.catalog(spark, d).filter((F.col("train_class") == "Positive") & (F.length("region") > 8)).select("tile_id"),
    "p19_select_arrange": lambda spark, d: schema.table(spark, d, "nation").filter(F.col("n_regionkey").isin(1, 3)).select("n_name", "n_regionkey").orderBy("n_name"),
    "j01_class_lookup": lambda spark, d: lookup_class(schema.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tile_id")).distinct(), schema.catalog(spark, d)),
    "j02_region_split": _cat(lambda c, s: with_split(c, s).groupBy("region", "split").agg(F.count("*").alias("n"))),
    "j03_ecoregion_default": lambda spark, d: with_ecoregion(schema.table(spark, d, "nation").select(F.col("n_name").alias("region")), schema.table(spark, d, "nation").filter("n_nationkey % 2 = 0").join(schema.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("region"), F.col("r_name").alias("ecoregion"))),
    "j04_modality_stack": lambda spark, d: _stack(spark, d),
    "j04_modality_stack_all_rows": lambda spark, d: _stack(spark, d),
    "a01_region_stats": _cat(lambda c, s: region_stats(c)),
    "a02_split_summary": _cat(split_summary),
    "a03_split_ecoregions": _cat(split_ecoregions),
    "a04_class_pivot": _cat(lambda c, s: class_pivot(c)),
    "a05_value_counts": lambda spark, d: schema.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5),
    "a06_class_ratio": _cat(lambda c, s: class_ratio(c)),
    "a07_distinct_uids": _uids,
    "a08_coverage_buckets": lambda spark, d: coverage(schema.table(spark, d, "lineitem"), "l_quantity"),
    "a31_group_shares": _cat(lambda c, s: _shares(c)),
    "a36_distinct_values": lambda spark, d: schema.table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_distinct("l_discount").alias("n_values"), F.concat_ws(",", F.sort_array(F.collect_set(F.format_number("l_discount", 2)))).alias("labels")),
    "w02_duplicates_all": lambda spark, d: duplicates(schema.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", "l_linenumber"),
    "w03_duplicates_beyond_first": lambda spark, d: schema.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("n_duplicates")),
    "u01_compare_sets": lambda spark, d: compare_sets(schema.table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey"), schema.table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select("o_orderkey"), "o_orderkey"),
    "u02_unassigned_regions": _cat(lambda c, s: c.select("region").distinct().join(s, "region", "left_anti").withColumn("kind", F.lit("unassigned")).union(s.select("region").distinct().join(c, "region", "left_anti").withColumn("kind", F.lit("unknown")))),
    "u03_intersections": lambda spark, d: schema.table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").intersect(schema.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))),
    "u04_without_held_out": lambda spark, d: schema.table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").subtract(schema.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))),
    "u05_append_merge": lambda spark, d: append_merge(schema.table(spark, d, "customer").select("c_custkey", "c_name"), schema.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal")), ["c_custkey", "c_name", "c_acctbal"]),
    "u06_leakage": lambda spark, d: leakage(_segments(spark, d), {}),
    "u06_leakage_with_aliases": lambda spark, d: leakage(_segments(spark, d), {"BUILDING": "MACHINERY"}),
    "u07_subset_test": lambda spark, d: schema.table(spark, d, "orders").groupBy("o_orderpriority").agg((F.size(F.array_except(F.collect_set("o_orderstatus"), F.array(F.lit("F"), F.lit("O")))) == 0).alias("ok")),
    "j15_uid_merge": lambda spark, d: merge_uids(schema.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.col("s_name").alias("uid")), schema.table(spark, d, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("tile_id"), F.concat(F.lit("new-"), F.col("s_name")).alias("uid"))),
}


def _stack(spark: SparkSession, d: str) -> DataFrame:
    li = schema.table(spark, d, "lineitem")
    per = lambda f, n: li.filter(f).groupBy(F.col("l_orderkey").alias("tile_id"), F.col("l_linenumber").alias("row")).agg(F.count("*").alias(n))
    return stack_modalities(per("l_tax <= 0.05", "r"), per("l_discount >= 0.03", "band"), per("l_returnflag = 'R'", "label"), ["tile_id", "row"])


def _shares(c: DataFrame) -> DataFrame:
    n = c.groupBy("region").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(total).select("region", "n", F.round(F.col("n") / F.col("t"), 8).alias("share"))  # one row of totals


WITH = f"WITH {CATALOG_SQL}, {SPLITS_SQL}"
COUNTS = "count(*) FILTER (train_class = 'Positive') AS positive, count(*) FILTER (train_class = 'Negative') AS negative, count(tile_id) AS total"
SQL = {
    "p01_split_members": f"{WITH} SELECT tile_id FROM cat WHERE train_class = 'Positive' AND region IN (SELECT region FROM splits WHERE split = 'train') ORDER BY 1",
    "p03_enum_violation": "SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O') GROUP BY 1",
    "p04_range_checks": "SELECT c_custkey, severity FROM (SELECT c_custkey, CASE WHEN NOT c_acctbal / 50 BETWEEN -90 AND 90 OR NOT c_acctbal / 40 BETWEEN -180 AND 180 THEN 'error' WHEN c_acctbal / 50 < 50 THEN 'warning' END AS severity FROM customer) WHERE severity IS NOT NULL",
    "p05_blank_strings": "SELECT count(*) FILTER (x IS NULL OR trim(x) = '') AS n_blank, count(*) AS n FROM (SELECT nullif(substr(p_name, 1, 3), 'red') AS x FROM part)",
    "p11_recode": "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE o_orderkey % 4 WHEN 0 THEN -100.0::DOUBLE WHEN 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS lon FROM orders",
    "p13_large_tiles": "SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE c_acctbal::VARCHAR END AS DOUBLE) >= 500, false) AS large FROM customer",
    "p18_positive_flagged": f"{WITH} SELECT tile_id FROM cat WHERE train_class = 'Positive' AND length(region) > 8",
    "p19_select_arrange": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3) ORDER BY n_name",
    "j01_class_lookup": f"{WITH} SELECT tile_id, train_class FROM (SELECT DISTINCT l_orderkey AS tile_id FROM lineitem) JOIN cat USING (tile_id)",
    "j02_region_split": f"{WITH} SELECT region, split, count(*) AS n FROM cat LEFT JOIN splits USING (region) GROUP BY 1, 2",
    "j03_ecoregion_default": "SELECT n_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE n_name END AS ecoregion FROM nation JOIN region ON n_regionkey = r_regionkey",
    "j04_modality_stack": """WITH li AS (SELECT l_orderkey AS tile_id, l_linenumber AS row, * FROM lineitem), a AS (SELECT tile_id, row, count(*) AS r FROM li WHERE l_tax <= 0.05 GROUP BY 1, 2),
      b AS (SELECT tile_id, row, count(*) AS band FROM li WHERE l_discount >= 0.03 GROUP BY 1, 2), l AS (SELECT tile_id, row, count(*) AS label FROM li WHERE l_returnflag = 'R' GROUP BY 1, 2)
      SELECT tile_id, row, r, band, coalesce(label, 0) AS label FROM a JOIN b USING (tile_id, row) LEFT JOIN l USING (tile_id, row)""",
    "a01_region_stats": f"{WITH} SELECT region, {COUNTS} FROM cat GROUP BY 1",
    "a02_split_summary": f"{WITH} SELECT split, count(tile_id) AS total, count(*) FILTER (train_class = 'Positive') AS positive, count(*) FILTER (train_class = 'Negative') AS negative, count(DISTINCT splits.region) AS n_regions FROM splits LEFT JOIN cat USING (region) GROUP BY 1",
    "a03_split_ecoregions": f"{WITH} SELECT split, count(*) FILTER (train_class = 'Positive') AS positive, count(DISTINCT ecoregion) AS n_ecoregions, string_agg(DISTINCT splits.region, ',' ORDER BY splits.region) AS regions, coalesce(string_agg(DISTINCT ecoregion, ',' ORDER BY ecoregion), '') AS ecoregions FROM splits LEFT JOIN cat USING (region) GROUP BY 1",
    "a04_class_pivot": f"{WITH} SELECT region, count(*) FILTER (train_class = 'Positive') AS Positive, count(*) FILTER (train_class = 'Negative') AS Negative FROM cat GROUP BY 1",
    "a05_value_counts": "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5",
    "a06_class_ratio": f"{WITH}, c AS (SELECT {COUNTS} FROM cat) SELECT *, round(positive * 100.0 / total, 6) AS positive_pct, CASE WHEN positive > 0 THEN printf('1:%.2f', negative / positive) ELSE 'N/A' END AS ratio FROM c",
    "a07_distinct_uids": "SELECT count(DISTINCT w) AS n_uids FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' AND w <> '9999'",
    "a08_coverage_buckets": "SELECT count(*) FILTER (l_quantity <= 10) AS low, count(*) FILTER (l_quantity > 10 AND l_quantity <= 50) AS middle, count(*) FILTER (l_quantity > 50) AS high FROM lineitem",
    "a31_group_shares": f"{WITH} SELECT region, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM cat GROUP BY 1",
    "a36_distinct_values": "SELECT l_linestatus, count(DISTINCT l_discount) AS n_values, string_agg(DISTINCT printf('%.2f', l_discount), ',' ORDER BY printf('%.2f', l_discount)) AS labels FROM lineitem GROUP BY 1",
    "w02_duplicates_all": "SELECT * FROM (SELECT l_orderkey, l_partkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
    "w03_duplicates_beyond_first": "SELECT sum(c - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "u01_compare_sets": """WITH a AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0),
      x AS (SELECT 'left_only' AS side, o_orderkey FROM a WHERE o_orderkey NOT IN (FROM b) UNION ALL SELECT 'right_only', o_orderkey FROM b WHERE o_orderkey NOT IN (FROM a)), y AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY o_orderkey) AS n FROM x)
      SELECT side, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (n <= 5) AS first_ids FROM y GROUP BY side""",
    "u02_unassigned_regions": f"{WITH} SELECT DISTINCT region, 'unassigned' AS kind FROM cat WHERE region NOT IN (SELECT region FROM splits) UNION ALL SELECT DISTINCT region, 'unknown' FROM splits WHERE region NOT IN (SELECT region FROM cat)",
    "u03_intersections": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
    "u04_without_held_out": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem",
    "u05_append_merge": "SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    "u06_leakage": "SELECT n_name AS region, count(DISTINCT c_mktsegment) AS n_splits FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1",
    "u06_leakage_with_aliases": "SELECT n_name AS region, count(DISTINCT CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY' ELSE c_mktsegment END) AS n_splits FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING n_splits > 1",
    "u07_subset_test": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 AS ok FROM orders GROUP BY 1",
    "j15_uid_merge": "SELECT s_suppkey AS tile_id, CASE WHEN s_suppkey % 4 = 0 THEN 'new-' || s_name ELSE s_name END AS uid FROM supplier",
}
assert len(SPLITS) == len(schema.SPLIT_NAMES)
SQL["j04_modality_stack_all_rows"] = SQL["j04_modality_stack"]
