"""Statistics of channels: mergeable moments, drift, percentiles, composites, histograms, correlation and ranks."""

from __future__ import annotations

from collections.abc import Sequence


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema
from .selection import percentiles
from .state_io import Kept

MEAN_DRIFT, STD_DRIFT = 0.5, 0.25


def finite(c: Column) -> Column:
    """c where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def unpivot(df: DataFrame, channels: Sequence[str], *keep: str) -> DataFrame:
    """Long form (keep..., channel, value); a row generator, no shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels)))
    return df.select(*keep, pairs.alias("_x")).select(*keep, "_x.channel", "_x.value")


def channel_stats(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(channel, n, mean, std): population moments in one pass; a single value has deviation 0, none has n = 0."""
    aggs = [F.struct(F.lit(c).alias("channel"), F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std")) for c, v in ((c, finite(F.col(c).cast("double"))) for c in channels)]
    return df.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_x")).select("_x.*")


def partial_stats(df: DataFrame, channels: Sequence[str], *by: str) -> DataFrame:
    """State that can be stored and merged: (by..., channel, n, mean, m2)."""
    long = unpivot(df, channels, *by)
    return long.groupBy(*by, "channel").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def merge_stats(parts: DataFrame, *by: str) -> DataFrame:
    """(by..., channel, n, mean, std) of merged partial states, by the parallel-variance identity."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    total = parts.groupBy(*by, "channel").agg(n.alias("n"), mean.alias("mean"), F.sum("m2").alias("_m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_s2"))
    between = F.greatest(F.col("_s2") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return total.select(*by, "channel", "n", "mean", F.sqrt((F.col("_m2") + between) / F.col("n")).alias("std"))


def clipped(df: DataFrame, column: str, low: float, high: float, *by: str) -> DataFrame:
    """df with the column clipped to its exact percentiles within each group."""
    p = percentiles(df, column, [low, high], Kept(df.sparkSession, "clipped"), *by).select(*by, F.col("q").alias("_p"))
    return df.join(p, list(by)).withColumn(column, F.least(F.greatest(F.col(column), F.col("_p")[0]), F.col("_p")[1])).drop("_p")


def drift(sample: DataFrame, training: DataFrame) -> DataFrame:
    """Per channel: absolute and relative shift of the mean, ratio of deviations less 1, and whether either is concerning."""
    s, t = sample.select("channel", F.col("mean").alias("m1"), F.col("std").alias("s1")), training.select("channel", F.col("mean").alias("m0"), F.col("std").alias("s0"))
    both = s.join(t, "channel")
    shift = F.abs(F.col("m1") - F.col("m0"))
    over = lambda a: F.when(F.col("s0") > 0, a / F.col("s0")).otherwise(float("inf"))
    both = both.withColumn("mean_delta", shift).withColumn("mean_drift", over(shift)).withColumn("std_drift", F.abs(over(F.col("s1")) - 1))
    return both.withColumn("concerning", (F.col("mean_drift") > MEAN_DRIFT) | (F.col("std_drift") > STD_DRIFT)).drop("m0", "m1", "s0", "s1")


def stats_document(rgb: DataFrame, extra: DataFrame | None, version: str, n_tiles: int) -> DataFrame:
    """One row: parallel vectors of names, means and deviations, in the order of pos."""
    ordered = lambda df: df.agg(F.array_sort(F.collect_list(F.struct("pos", "channel", "mean", "std"))).alias("_v")).select(F.struct(F.col("_v.channel").alias("channel_names"), F.col("_v.mean").alias("mean"), F.col("_v.std").alias("std")).alias("x"))
    out = ordered(rgb).select(F.lit(version).alias("dataset_version"), F.current_timestamp().alias("computed_date"), F.lit(n_tiles).alias("n_tiles_used"), F.col("x").alias("rgb"))
    return out if extra is None else out.crossJoin(ordered(extra).select(F.col("x").alias("extra")))  # one row each


def check_names(names: Column, expected: Sequence[str]) -> Column:
    """The names, if they are the expected ones in order; else reading them raises."""
    return F.when(names == F.array(*map(F.lit, expected)), names).otherwise(F.raise_error(F.lit("channel names differ from the expected ones")))


def cloud_free(qa: Column) -> Column:
    """Neither bit 10 (cloud) nor bit 11 (cirrus) is set."""
    return (qa.bitwiseAND(1 << 10) == 0) & (qa.bitwiseAND(1 << 11) == 0)


def median_composite(df: DataFrame, *by: str, value: str = "value", scale: float = 1e-4) -> DataFrame:
    return percentiles(df, value, [0.5], Kept(df.sparkSession, "median"), *by).select(*by, (F.col("q")[0] * scale).alias("composite"))


def exposure(df: DataFrame, key: str, kept: Kept) -> DataFrame:
    """(max, median, p99, n) of how often each key occurs."""
    counts = kept.put(df.groupBy(key).agg(F.count("*").alias("c")))
    q = percentiles(counts, "c", [0.5, 0.99, 1.0], kept)
    return q.select(F.col("q")[2].cast("long").alias("max"), F.col("q")[0].alias("median"), F.col("q")[1].alias("p99"), "n")


def to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def to_db(linear: Column) -> Column:
    return 10 * F.log10(linear)


def orbit_choice(df: DataFrame, orbit: str = "orbit", *by: str) -> DataFrame:
    """The orbit with most scenes; ties go to ASCENDING."""
    asc, desc = F.count_if(F.col(orbit) == "ASCENDING"), F.count_if(F.col(orbit) == "DESCENDING")
    return df.groupBy(*by).agg(asc.alias("n_asc"), desc.alias("n_desc"), F.when(asc >= desc, "ASCENDING").otherwise("DESCENDING").alias("orbit"))


def mode_choice(df: DataFrame, *by: str) -> DataFrame:
    """Best mode available: IW with VV and VH, else EW with HH and HV, else NONE. df: mode, pols (array)."""
    has = lambda m, a, b: F.max(F.when((F.col("mode") == m) & F.array_contains("pols", a) & F.array_contains("pols", b), 1).otherwise(0))
    return df.groupBy(*by).agg(F.when(has("IW", "VV", "VH") == 1, "IW").when(has("EW", "HH", "HV") == 1, "EW").otherwise("NONE").alias("mode"))


def season_shift(df: DataFrame, value: str, month: Column, *by: str) -> DataFrame:
    """Mean in dB of August and September less that of July, 0 where either has no scene."""
    mean = lambda c: F.avg(F.when(c, F.col(value)))
    return df.groupBy(*by).agg(F.coalesce(mean(month.isin(8, 9)) - mean(month == 7), F.lit(0.0)).alias("shift"))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """1 to bins; the upper bound belongs to the last bin, and a range without width is the first bin."""
    return F.when(low == high, 1).otherwise(F.least(F.floor((v - low) / (high - low) * bins) + 1, F.lit(bins))).cast("int")


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    v = F.col(value)
    return df.filter(v.between(low, high)).groupBy(bin_of(v, F.lit(low), F.lit(high), bins).alias("bin")).agg(F.count("*").alias("n"))


def histogram_mode(df: DataFrame, value: str, *by: str, bins: int = 200) -> DataFrame:
    """Midpoint of the fullest of equal bins over the range of each group, the first of several."""
    r = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    counts = df.join(r, list(by)).groupBy(*by, "_lo", "_hi", bin_of(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("_b")).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*by, "_lo", "_hi").agg(F.max(F.struct("_n", F.negative("_b").alias("b"))).alias("_x"))
    return best.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (-F.col("_x.b") - 0.5) / bins).alias("mode"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's correlation; null where either side is constant."""
    n, va, vb = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)), F.var_pop(a), F.var_pop(b)
    return F.when((n > 1) & (va > 0) & (vb > 0), F.try_divide(F.covar_pop(a, b), F.sqrt(va) * F.sqrt(vb)))


def pearson_matrix(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair a < b, in one aggregation over the data."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(F.col(a), F.col(b)).alias("r")) for a, b in pairs)).alias("_p"))
    return row.select(F.explode("_p").alias("_x")).select("_x.*")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, rank) for each distinct value: ranks count up over distinct values, whose rows are summed before.

    Distinct values are numbered in range partitions whose sizes are added up, so no task holds all of them.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, "value", {"_to": "n"}).select("value", "n", (F.col("_to") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def running(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, part_rows: int = 50_000, most_parts: int = 100_000) -> DataFrame:
    """df with running sums in the order of a distinct column, without a window over all rows.

    The rows are written once and dealt out by ranges, part_rows or so each; within a part a window sums up, and the parts before
    add their totals (a window over as many rows as there are parts).
    """
    kept = Kept(df.sparkSession, "running")
    rows = kept.put(df)
    parts = max(1, min(most_parts, -(-rows.count() // part_rows)))
    o = F.col(order).desc() if descending else F.col(order).asc()
    dealt = kept.put(rows.repartitionByRange(parts, o).withColumn("_part", F.spark_partition_id()))
    kept.drop(rows)
    totals = dealt.groupBy("_part").agg(*(F.sum(v).alias(f"_t{k}") for k, v in sums.items()))
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_part", *(F.coalesce(F.sum(f"_t{k}").over(w), F.lit(0)).alias(f"_b{k}") for k in sums))
    inner = W.partitionBy("_part").orderBy(o).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = dealt.select("*", *(F.sum(v).over(inner).alias(f"_i{k}") for k, v in sums.items())).join(F.broadcast(before), "_part")
    return out.select(*df.columns, *((F.col(f"_i{k}") + F.col(f"_b{k}")).alias(k) for k in sums))


def spearman_matrix(df: DataFrame, channels: Sequence[str], key: str) -> DataFrame:
    """(a, b, r): correlation of average ranks. key identifies a row; fewer than three rows give null."""
    ranked = df.select(key, *channels)
    for c in channels:
        ranks = average_ranks(df, c).select(F.col("value").alias(c), F.col("rank").alias(f"_r_{c}"))
        ranked = ranked.join(ranks, c, "left")
    m = pearson_matrix(ranked.select(*(F.col(f"_r_{c}").alias(c) for c in channels)), channels)
    n = df.agg(F.count("*").alias("_n"))
    return m.crossJoin(n).select("a", "b", F.when(F.col("_n") >= 3, F.col("r")).alias("r"))  # one row of counts


def z_score(v: Column, mean: Column, std: Column) -> Column:
    return (v - mean) / std


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """value stretched to 0..1 between its percentiles and clipped; a range without width gives 0."""
    p = percentiles(df.select(finite(F.col(value).cast("double")).alias("_v")), "_v", [low, high], Kept(df.sparkSession, "stretch")).select(F.col("q").alias("_p"))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    out = F.when(hi > lo, F.least(F.greatest((F.col(value) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return df.crossJoin(F.broadcast(p)).withColumn("stretched", out).drop("_p")  # one row of bounds


def error_kinds(errors: DataFrame, column: str = "error", first: int = 5) -> DataFrame:
    """Errors by what stands before ':' or '!=': count, and the first examples."""
    kind = F.trim(F.split(F.split(F.col(column), ":")[0], "!=")[0])
    tagged = errors.withColumn("kind", kind)
    top = tagged.withColumn("_n", F.row_number().over(W.partitionBy("kind").orderBy(column))).filter(F.col("_n") <= first)  # limited before the shuffle
    top = top.groupBy("kind").agg(F.concat_ws("|", F.array_sort(F.collect_list(column))).alias("examples"))
    return tagged.groupBy("kind").agg(F.count("*").alias("n")).join(top, "kind")


def weighted_mean(v: Column, n: Column) -> Column:
    return F.sum(v * n) / F.greatest(F.sum(n), F.lit(1))


# --- queries -------------------------------------------------------------------------------------------------------

CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
R6 = lambda c: F.round(c, 6)


def _li(spark: SparkSession, d: str) -> DataFrame:
    return schema.table(spark, d, "lineitem")


def _drift(spark, d):
    li = _li(spark, d)
    out = drift(channel_stats(li.filter("l_shipdate >= '1999-01-01'"), CHANNELS), channel_stats(li.filter("l_shipdate < '1999-01-01'"), CHANNELS))
    return out.select("channel", R6("mean_delta").alias("mean_delta"), R6("mean_drift").alias("mean_drift"), R6("std_drift").alias("std_drift"), "concerning")


def _rounded_stats(df):
    return df.select("channel", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def _scenes(spark, d):
    """Events as scenes: a pixel for each user, orbits and modes by type."""
    e = schema.table(spark, d, "events")
    return e.select(F.col("user_id").alias("pixel"), "ts", F.col("event_type").alias("band"), "value", (F.col("event_id") % 4096).cast("int").alias("qa"), F.when(F.col("event_id") % 3 == 0, "DESCENDING").otherwise("ASCENDING").alias("orbit"),
                    F.when(F.col("event_id") % 5 == 0, "EW").otherwise("IW").alias("mode"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit("HH"), F.lit("HV"))).when(F.col("event_id") % 7 == 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV"))).alias("pols"), F.when(F.dayofmonth("ts") < 11, 7).when(F.dayofmonth("ts") < 21, 8).otherwise(9).alias("month"))


SCENES_SQL = """scenes AS (SELECT user_id AS pixel, ts, event_type AS band, value, (event_id % 4096)::INT AS qa, CASE WHEN event_id % 3 = 0 THEN 'DESCENDING' ELSE 'ASCENDING' END AS orbit,
  CASE WHEN event_id % 5 = 0 THEN 'EW' ELSE 'IW' END AS mode, CASE WHEN event_id % 5 = 0 THEN ['HH', 'HV'] WHEN event_id % 7 = 0 THEN ['VV', 'VH'] ELSE ['VV'] END AS pols,
  CASE WHEN day(ts) < 11 THEN 7 WHEN day(ts) < 21 THEN 8 ELSE 9 END AS month FROM events)"""


def _prices(spark, d):
    """Parts with three channels, one of them a function of another."""
    return schema.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 97).cast("double").alias("code"))


# A logarithm needs a value above 0.
QUERIES = {
    "a09_channel_stats": lambda s, d: _rounded_stats(channel_stats(_li(s, d), CHANNELS)),
    "a10_clipped_stats": lambda s, d: clipped(_li(s, d), "l_extendedprice", 0.02, 0.98, "l_returnflag").groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("std")),
    "a11_stats_document": lambda s, d: channel_stats(_li(s, d), CHANNELS[:3]).withColumn("pos", F.expr("array_position(array('l_quantity', 'l_extendedprice', 'l_discount'), channel)")).transform(lambda x: stats_document(x, None, "v1", 1)).select("dataset_version", "n_tiles_used", F.concat_ws(",", "rgb.channel_names").alias("names"), F.round(F.element_at("rgb.mean", 2), 4).alias("mean_2")),
    "a12_drift_report": _drift,
    "a13_percentiles": lambda s, d: percentiles(_li(s, d), "l_extendedprice", (0.02, 0.5, 0.95, 0.98), Kept(s, "a13"), "l_returnflag").select("l_returnflag", *(R6(F.col("q")[k]).alias(n) for k, n in enumerate(("p02", "p50", "p95", "p98")))),
    "a14_median_composite": lambda s, d: median_composite(_scenes(s, d).filter(cloud_free(F.col("qa"))), "pixel", "band").select("pixel", "band", F.round("composite", 9).alias("composite")),
    "a15_linear_mean_db": lambda s, d: _scenes(s, d).filter("value > 0").groupBy("pixel").agg(R6(to_db(F.avg(to_linear(to_db(F.col("value")))))).alias("mean_db"), R6(F.stddev_pop(to_db(F.col("value")))).alias("std_db")),
    "a16_orbit_majority": lambda s, d: orbit_choice(_scenes(s, d), "orbit", "pixel"),
    "a17_mode_fallback": lambda s, d: mode_choice(_scenes(s, d), "pixel"),
    "a17_mode_fallback_all_scenes": lambda s, d: mode_choice(_scenes(s, d), "pixel"),
    "a18_season_shift": lambda s, d: season_shift(_scenes(s, d).filter("value > 0").withColumn("db", to_db(F.col("value"))), "db", F.col("month"), "pixel").select("pixel", R6("shift").alias("shift")),
    "a18b_single_pol_mean": lambda s, d: _scenes(s, d).filter("value > 0").groupBy("pixel").agg(R6(F.avg(F.when(F.col("band") == "click", to_db(F.col("value"))))).alias("mean_db")),
    "a23_histogram_mode": lambda s, d: histogram_mode(_li(s, d), "l_quantity", "l_returnflag", bins=7).select("l_returnflag", R6("mode").alias("mode")),
    "a24_fixed_histogram": lambda s, d: histogram(_li(s, d).withColumn("p", F.col("l_quantity") / 64), "p", 50, 0.0, 1.0),
    "a25_exposure": lambda s, d: exposure(_li(s, d), "l_partkey", Kept(s, "a25")).select("max", "median", R6("p99").alias("p99"), "n"),
    "a27_pearson": lambda s, d: pearson_matrix(_li(s, d), CHANNELS).select("a", "b", R6("r").alias("r")),
    "a28_spearman": lambda s, d: spearman_matrix(_prices(s, d), ["size", "price", "code"], "p_partkey").select("a", "b", R6("r").alias("r")),
    "a32_error_kinds": lambda s, d: error_kinds(schema.table(s, d, "events").select(F.concat_ws(": ", "event_type", F.col("event_id").cast("string")).alias("error"))),
    "a33_weighted_loss": lambda s, d: _li(s, d).groupBy("l_linestatus").agg(R6(weighted_mean(F.col("l_discount"), F.col("l_quantity"))).alias("loss")),
    "a34_seed_spread": lambda s, d: _li(s, d).groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("v")).groupBy("l_returnflag").agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v"), 9).alias("std")),
    "w06_average_ranks": lambda s, d: average_ranks(_li(s, d), "l_quantity"),
    "f14_z_score": lambda s, d: _li(s, d).crossJoin(_li(s, d).agg(F.avg("l_tax").alias("m"), F.stddev_pop("l_tax").alias("sd"))).select("l_orderkey", "l_linenumber", "l_partkey", F.round(z_score(F.col("l_tax"), F.col("m"), F.col("sd")), 6).alias("z")),
    "f15_stretch": lambda s, d: stretch(_prices(s, d), "price").select("p_partkey", R6("stretched").alias("stretched")),
    "t05_merged_stats": lambda s, d: _rounded_stats(merge_stats(partial_stats(_li(s, d), CHANNELS, "l_returnflag", "l_linestatus").drop("l_returnflag", "l_linestatus"))),
    "p08_cloud_mask": lambda s, d: _scenes(s, d).groupBy("band").agg(F.count_if(cloud_free(F.col("qa"))).alias("clear"), F.count("*").alias("n")),
    "p09_scene_filters": lambda s, d: _scenes(s, d).filter(F.array_contains("pols", "VH") & (F.col("orbit") == "ASCENDING") & (F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-20") & (F.col("value") < 60)).select("pixel", "band", "value"),
    "t09_season_windows": lambda s, d: _scenes(s, d).groupBy("pixel").agg(F.count_if(F.col("month") == 7).alias("july"), F.count_if(F.col("month").isin(8, 9)).alias("late")),
}

_each = lambda t: " UNION ALL ".join(t.format(c=c) for c in CHANNELS)
_pairs = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]]
SQL = {
    "a09_channel_stats": _each("SELECT '{c}' AS channel, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std FROM lineitem"),
    "a10_clipped_stats": """WITH p AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem GROUP BY 1)
      SELECT l_returnflag, round(avg(least(greatest(l_extendedprice, lo), hi)), 4) AS mean, round(stddev_pop(least(greatest(l_extendedprice, lo), hi)), 4) AS std FROM lineitem JOIN p USING (l_returnflag) GROUP BY 1""",
    "a11_stats_document": "SELECT 'v1' AS dataset_version, 1::INT AS n_tiles_used, 'l_quantity,l_extendedprice,l_discount' AS names, round(avg(l_extendedprice), 4) AS mean_2 FROM lineitem",
    "a12_drift_report": f"""WITH x AS ({_each("SELECT '{c}' AS channel, avg({c}) FILTER (l_shipdate >= '1999-01-01') AS m1, stddev_pop({c}) FILTER (l_shipdate >= '1999-01-01') AS s1, avg({c}) FILTER (l_shipdate < '1999-01-01') AS m0, stddev_pop({c}) FILTER (l_shipdate < '1999-01-01') AS s0 FROM lineitem")})
      SELECT channel, round(abs(m1 - m0), 6) AS mean_delta, round(abs(m1 - m0) / s0, 6) AS mean_drift, round(abs(s1 / s0 - 1), 6) AS std_drift, abs(m1 - m0) / s0 > 0.5 OR abs(s1 / s0 - 1) > 0.25 AS concerning FROM x""",
    "a13_percentiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(p * 100):02d}" for p in (0.02, 0.5, 0.95, 0.98)) + " FROM lineitem GROUP BY 1",
    "a14_median_composite": f"WITH {SCENES_SQL} SELECT pixel, band, round(median(value) * 1e-4, 9) AS composite FROM scenes WHERE qa & 1024 = 0 AND qa & 2048 = 0 GROUP BY 1, 2",
    "a15_linear_mean_db": f"WITH {SCENES_SQL} SELECT pixel, round(10 * log10(avg(value)), 6) AS mean_db, round(stddev_pop(10 * log10(value)), 6) AS std_db FROM scenes WHERE value > 0 GROUP BY 1",
    "a16_orbit_majority": f"WITH {SCENES_SQL} SELECT pixel, count(*) FILTER (orbit = 'ASCENDING') AS n_asc, count(*) FILTER (orbit = 'DESCENDING') AS n_desc, CASE WHEN count(*) FILTER (orbit = 'ASCENDING') >= count(*) FILTER (orbit = 'DESCENDING') THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit FROM scenes GROUP BY 1",
    "a17_mode_fallback": f"WITH {SCENES_SQL} SELECT pixel, CASE WHEN bool_or(mode = 'IW' AND list_contains(pols, 'VV') AND list_contains(pols, 'VH')) THEN 'IW' WHEN bool_or(mode = 'EW' AND list_contains(pols, 'HH') AND list_contains(pols, 'HV')) THEN 'EW' ELSE 'NONE' END AS mode FROM scenes GROUP BY 1",
    "a18_season_shift": f"WITH {SCENES_SQL} SELECT pixel, round(coalesce(avg(10 * log10(value)) FILTER (month IN (8, 9)) - avg(10 * log10(value)) FILTER (month = 7), 0), 6) AS shift FROM scenes WHERE value > 0 GROUP BY 1",
    "a18b_single_pol_mean": f"WITH {SCENES_SQL} SELECT pixel, round(avg(10 * log10(value)) FILTER (band = 'click'), 6) AS mean_db FROM scenes WHERE value > 0 GROUP BY 1",
    "a23_histogram_mode": """WITH r AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag, lo, hi, least(floor((l_quantity - lo) / (hi - lo) * 7) + 1, 7) AS b, count(*) AS n FROM lineitem JOIN r USING (l_returnflag) GROUP BY ALL)
      SELECT l_returnflag, round(arg_max(lo + (hi - lo) * (b - 0.5) / 7, n * 1000 - b), 6) AS mode FROM b GROUP BY 1""",
    "a24_fixed_histogram": "SELECT least(floor(l_quantity / 64 * 50) + 1, 50)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity / 64 BETWEEN 0 AND 1 GROUP BY 1",
    "a25_exposure": "SELECT max(c) AS max, median(c)::DOUBLE AS median, round(quantile_cont(c, 0.99), 6) AS p99, count(*) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey)",
    "a27_pearson": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _pairs),
    "a28_spearman": """WITH x AS (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price, (p_partkey % 97)::DOUBLE AS code FROM part),
      r AS (SELECT rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0 AS size, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS price, rank() OVER (ORDER BY code) + (count(*) OVER (PARTITION BY code) - 1) / 2.0 AS code FROM x)
      SELECT 'size' AS a, 'price' AS b, round(corr(size, price), 6) AS r FROM r UNION ALL SELECT 'size', 'code', round(corr(size, code), 6) FROM r UNION ALL SELECT 'price', 'code', round(corr(price, code), 6) FROM r""",
    "a32_error_kinds": "WITH e AS (SELECT event_type AS kind, event_type || ': ' || event_id AS error FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY error) AS i FROM e) SELECT kind, count(*) AS n, string_agg(error, '|' ORDER BY error) FILTER (i <= 5) AS examples FROM n GROUP BY 1",
    "a33_weighted_loss": "SELECT l_linestatus, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) AS loss FROM lineitem GROUP BY 1",
    "a34_seed_spread": "SELECT l_returnflag, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std FROM (SELECT l_returnflag, l_linestatus, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "w06_average_ranks": "SELECT value, n, sum(n) OVER (ORDER BY value)::DOUBLE - n + (n + 1) / 2.0 AS rank FROM (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1)",
    "f14_z_score": "SELECT l_orderkey, l_linenumber, l_partkey, round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) AS z FROM lineitem",
    "f15_stretch": "WITH p AS (SELECT quantile_cont(p_retailprice, 0.02) AS lo, quantile_cont(p_retailprice, 0.98) AS hi FROM part) SELECT p_partkey, round(least(greatest((p_retailprice - lo) / (hi - lo), 0), 1), 6) AS stretched FROM part, p",
    "p08_cloud_mask": f"WITH {SCENES_SQL} SELECT band, count(*) FILTER (qa & 1024 = 0 AND qa & 2048 = 0) AS clear, count(*) AS n FROM scenes GROUP BY 1",
    "p09_scene_filters": f"WITH {SCENES_SQL} SELECT pixel, band, value FROM scenes WHERE list_contains(pols, 'VH') AND orbit = 'ASCENDING' AND ts >= '2024-01-05' AND ts < '2024-01-20' AND value < 60",
    "t09_season_windows": f"WITH {SCENES_SQL} SELECT pixel, count(*) FILTER (month = 7) AS july, count(*) FILTER (month IN (8, 9)) AS late FROM scenes GROUP BY 1",
}
SQL["t05_merged_stats"] = SQL["a09_channel_stats"]
SQL["a17_mode_fallback_all_scenes"] = SQL["a17_mode_fallback"]
