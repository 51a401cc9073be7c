"""Decision rules over aggregates, split search, and schedules."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import metrics, stats
from ..operators.catalog import region_stats

# Split search: the regions' counts are one short table; the search itself is arithmetic on it.


def try_assignment(regions: list[tuple[str, str, int, int]], rng: random.Random, train: float = 0.7, val: float = 0.15, least_test: int = 100, least_eco: int = 2, slack: float = 0.1) -> dict[str, list[str]] | None:
    """regions: (name, ecoregion, positives, total). Shuffled regions go each to the split that lacks most of its share; None if the
    test split has too few positives, validation too few ecoregions, or a share drifts by more than slack."""
    order = regions[:]
    rng.shuffle(order)
    want = {"train": train, "val_realistic": val, "test_realistic": 1 - train - val}
    total = sum(r[3] for r in regions) or 1
    have: dict[str, list[tuple[str, str, int, int]]] = {k: [] for k in want}
    for r in order:
        gaps = {k: want[k] - sum(x[3] for x in v) / total for k, v in have.items()}
        have[max(gaps, key=lambda k: gaps[k])].append(r)
    share = {k: sum(x[3] for x in v) / total for k, v in have.items()}
    if sum(x[2] for x in have["test_realistic"]) < least_test or len({x[1] for x in have["val_realistic"]}) < least_eco:
        return None
    if any(abs(share[k] - want[k]) > slack for k in want):
        return None
    out = {k: sorted(x[0] for x in v) for k, v in have.items()}
    return out | {"val_balanced": out["val_realistic"]}


def find_splits(catalog: DataFrame, seed: int = 42, tries: int = 500, least_test: int = 100) -> tuple[dict[str, list[str]], int]:
    """The first feasible assignment and how many were tried. Regions are as many as the catalog names, not its tiles."""
    eco = catalog.groupBy("region").agg(F.min("ecoregion").alias("eco"))
    regions = [(r.region, r.eco, r.positive, r.total) for r in region_stats(catalog).join(eco, "region").orderBy("region").collect()]
    rng = random.Random(seed)
    for n in range(1, tries + 1):
        if (found := try_assignment(regions, rng, least_test=least_test)) is not None:
            return found, n
    raise ValueError(f"no feasible split in {tries} tries")


def split_report(catalog: DataFrame, splits: dict[str, list[str]], tries: int, least_train: float = 0.7) -> dict:
    """Counts and shares of each split, and warnings: validation and test may be met while training has too few of all positives."""
    counts = {r.region: r for r in region_stats(catalog).collect()}  # as many as there are regions
    total = sum(r.positive for r in counts.values())
    out = {}
    for name, regions in splits.items():
        own = [counts[r] for r in regions if r in counts]
        positive = sum(r.positive for r in own)
        out[name] = {"n_regions": len(regions), "total": sum(r.total for r in own), "positive": positive, "positive_share": positive / total if total else 0.0}
    short = total and out.get("train", {"positive_share": 0.0})["positive_share"] < least_train
    return {"splits": out, "tries": tries, "warnings": [f"training has {out['train']['positive_share']:.1%} of all positives, under {least_train:.0%}"] if short else []}


# Gates.


def multi_scale_gate(gain: Column, large_gain: Column, fp_before: Column, fp_after: Column, least_gain: float = 0.02, most_fp: float = 0.10) -> Column:
    """Whether the second scale pays: gain on large tiles (on all if there are none) and the false-positive rate it costs."""
    return (F.coalesce(large_gain, gain) >= least_gain) & (fp_after - fp_before <= most_fp)


def cheapest_passing(df: DataFrame, least_gain: float = 0.01, most_drop: float = 0.005) -> DataFrame:
    """(name) of the cheapest variant whose gain and precision drop pass; none: null. df: name, cost, gain, drop."""
    ok = df.filter((F.col("gain") >= least_gain) & (F.col("drop") <= most_drop))
    return ok.agg(F.min_by("name", F.struct("cost", "name")).alias("name"))


def winner_gate(gain: Column, sigma: Column, precision_delta: Column) -> Column:
    return (gain >= F.greatest(2 * sigma, F.lit(0.01))) & (precision_delta >= 0)


def sigma_band(delta: Column, sigma: Column) -> Column:
    r = F.abs(delta) / sigma
    return F.when(r < 1, "noise").when(r < 2, "weak").when(r < 3, "moderate").otherwise("strong")


def noise_floor(v: Column) -> Column:
    """Twice the deviation of repeated runs."""
    return 2 * F.stddev_samp(v)


def slope_band(auc: Column, n: Column, flat: float = 0.005, steep: float = 0.02) -> tuple[Column, Column]:
    slope = F.regr_slope(auc, F.ln(n))
    return slope, F.when(slope < flat, "saturated").when(slope < steep, "slowing").otherwise("growing")


def add_groups(gains: dict[frozenset, float], groups: Sequence[str], least: float) -> list[str]:
    """Greedy: the group that raises the score most joins, while it does by at least `least`; then groups that cost nothing to leave out go."""
    chosen: list[str] = []
    score = gains[frozenset()]
    while rest := [g for g in groups if g not in chosen]:
        best = max(rest, key=lambda g: (gains.get(frozenset([*chosen, g]), -math.inf), -groups.index(g)))
        new = gains.get(frozenset([*chosen, best]), -math.inf)
        if new - score < least:
            break
        chosen, score = [*chosen, best], new
    for g in list(chosen):
        without = frozenset(x for x in chosen if x != g)
        if len(chosen) > 1 and gains.get(without, -math.inf) >= score:  # a free rider
            chosen.remove(g)
            score = gains[without]
    return chosen


# Correlation rules.


def average_linkage(names: Sequence[str], r: np.ndarray) -> list[tuple[str, str, float]]:
    """Merges (a, b, distance) by mean distance 1 - |r|; clusters are named by their members. A handful of channels."""
    clusters = {n: [i] for i, n in enumerate(names)}
    d, out = 1 - np.abs(r), []
    while len(clusters) > 1:
        keys = sorted(clusters)
        a, b = min(((x, y) for i, x in enumerate(keys) for y in keys[i + 1 :]), key=lambda p: (float(d[np.ix_(clusters[p[0]], clusters[p[1]])].mean()), p))
        out.append((a, b, float(d[np.ix_(clusters[a], clusters[b])].mean())))
        clusters[f"{a}+{b}"] = clusters.pop(a) + clusters.pop(b)
    return out


def distance_ranking(matrix: DataFrame, channel: str) -> DataFrame:
    """(channel, distance) from one channel by 1 - |r|, farthest first. matrix: (a, b, r)."""
    own = matrix.filter((F.col("a") == channel) | (F.col("b") == channel))
    return own.select(F.when(F.col("a") == channel, F.col("b")).otherwise(F.col("a")).alias("channel"), (1 - F.abs("r")).alias("distance")).orderBy(F.desc("distance"), "channel")


def strong_pairs(matrices: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, regime, r): pairs with |r| > least in some regime, in the regime where it is greatest."""
    ok = matrices.filter(F.abs("r") > least)
    return ok.groupBy("a", "b").agg(F.max(F.struct(F.abs("r").alias("s"), "regime", "r")).alias("x")).select("a", "b", "x.regime", "x.r")


def independence_test(matrix: DataFrame, most: float = 0.5) -> DataFrame:
    return matrix.select("a", "b", "r", (F.abs("r") <= most).alias("passes"))


def sign_consistency(groups: DataFrame) -> DataFrame:
    """groups: (name, inside, background). How many have their inside mean at or under the background's mode."""
    return groups.agg(F.count_if(F.col("inside") <= F.col("background")).alias("inversions"), F.count("*").alias("n")).withColumn("consistent", F.col("inversions") <= 1)


# Schedules as functions of the epoch.


def cosine(t: Column, length: float, high: float, low: float) -> Column:
    return F.lit(low) + (high - low) * (1 + F.cos(F.lit(math.pi) * t / length)) / 2


def learning_rates(epochs: DataFrame, total: int, freeze: int = 10, warm_backbone: int = 3, warm: int = 5, frozen_lr: float = 1e-3, high: float = 1e-4, backbone_share: float = 0.1, low: float = 1e-6) -> DataFrame:
    """(epoch, grp, lr): all groups at frozen_lr while the backbone is frozen; then a linear warm-up, a plateau up to the end of the
    longer warm-up, and a cosine. The backbone's rates are a share of the decoder's and start from 0."""
    e = F.col("epoch")
    k = e - freeze  # epochs since the thaw, from 1

    def group(name: str, own_warm: int, share: float, start: float) -> Column:
        top, end = high * share, low * share
        up = F.lit(start) + (top - start) * (k - 1) / max(own_warm - 1, 1)
        lr = F.when(k <= 0, F.lit(frozen_lr)).when(k <= own_warm, up).when(k <= warm, F.lit(top)).otherwise(cosine(k - warm, max(total - freeze - warm, 1), top, end))
        return F.struct(F.lit(name).alias("grp"), lr.alias("lr"))

    return epochs.select("epoch", F.explode(F.array(group("backbone", warm_backbone, backbone_share, 0.0), group("decoder", warm, 1.0, low))).alias("x")).select("epoch", "x.grp", "x.lr")


def lr_range(steps: DataFrame, total: int, low: float = 1e-7, high: float = 1e-1) -> DataFrame:
    frac = F.col("step") / max(total - 1, 1)
    return steps.select("step", F.exp(F.lit(math.log(low)) + frac * (math.log(high) - math.log(low))).alias("lr"))


def bias_prior(share: float) -> float:
    if not 0 < share < 1:
        raise ValueError("the prior must lie between 0 and 1")
    return -math.log((1 - share) / share)


def grid_fits(size: int, tile: int, object_size: int) -> dict[str, float | bool]:
    """Stride arithmetic: whether an object always lies whole in a tile, the overlap and how many tiles more there are."""
    overlap = 1 - size / tile
    return {"fits": size <= tile - object_size, "overlap": overlap, "multiplier": (1 / (1 - overlap)) ** 2}


def calibration_guard(df: DataFrame) -> DataFrame:
    """df if threshold and temperature are set in each row, else reading it raises."""
    ok = F.col("threshold").isNotNull() & F.col("temperature").isNotNull()
    return df.withColumn("threshold", F.when(ok, F.col("threshold")).otherwise(F.raise_error(F.lit("calibration is incomplete")).cast("double")))


def packageable(runs: DataFrame, required: Sequence[str]) -> DataFrame:
    """(run_id, ok, missing): finished runs with all required files."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("files"))
    return runs.select("run_id", ((F.col("status") == "FINISHED") & (F.size(missing) == 0)).alias("ok"), F.concat_ws(",", missing).alias("missing"))


# --- queries -------------------------------------------------------------------------------------------------------


def _find(s: SparkSession, d: str) -> DataFrame:
    found, n = find_splits(schema.catalog(s, d), least_test=20)
    return schema.split_map(s, found).withColumn("tries", F.lit(n))


def _variants(s, d):
    c = metrics.pixel_counts(metrics._scored(s, d).withColumn("name", F.element_at(F.array(F.lit("none"), F.lit("minimal"), F.lit("standard"), F.lit("full")), (F.col("tile_id") % 4 + 1).cast("int"))), 0.5, "name")
    cost = F.when(F.col("name") == "none", 1).when(F.col("name") == "minimal", 2).when(F.col("name") == "standard", 4).otherwise(8)
    return c.select("name", cost.alias("cost"), (F.col("f1") - 0.3).alias("gain"), (0.36 - F.col("precision")).alias("drop"))


R = lambda c, n=6: F.round(c, n)
_m = lambda s, d: stats.pearson_matrix(schema.table(s, d, "lineitem"), stats.CHANNELS)


def _regimes(s, d):
    parts = schema.table(s, d, "part").withColumn("x", F.col("p_size").cast("double")).withColumn("y", F.col("p_retailprice") + F.when(F.col("p_type") == "PROMO", F.col("p_size") * 500).otherwise(0)).withColumn("z", F.col("p_size") * 2.0 + F.col("p_partkey") % 5)
    out = None
    for regime, where in (("all", "true"), ("promo", "p_type = 'PROMO'")):
        m = stats.pearson_matrix(parts.filter(where), ["x", "y", "z"]).withColumn("regime", F.lit(regime))
        out = m if out is None else out.union(m)
    return out


def _linkage(s, d):
    names = stats.CHANNELS
    r = np.eye(len(names))
    for row in _m(s, d).collect():  # as many rows as pairs of channels
        i, j = names.index(row.a), names.index(row.b)
        r[i, j] = r[j, i] = row.r or 0.0
    return s.createDataFrame([(a, b, round(x, 6)) for a, b, x in average_linkage(names, r)], "a string, b string, distance double")


QUERIES = {
    "m01_split_search": _find,
    "m07_average_linkage": _linkage,
    "m08_distance_ranking": lambda s, d: distance_ranking(_m(s, d), "l_quantity").select("channel", R("distance").alias("distance")),
    "m09_strong_pairs": lambda s, d: strong_pairs(_regimes(s, d)).select("a", "b", "regime", R("r").alias("r")),
    "m10_independence": lambda s, d: independence_test(_m(s, d)).select("a", "b", R("r").alias("r"), "passes"),
    "m11_sign_consistency": lambda s, d: sign_consistency(schema.table(s, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("inside")).join(stats.histogram_mode(schema.table(s, d, "lineitem"), "l_quantity", "l_returnflag", bins=7).withColumnRenamed("mode", "background"), "l_returnflag")),
    "m12_multi_scale_gate": lambda s, d: schema.table(s, d, "supplier").select("s_suppkey", multi_scale_gate(F.col("s_acctbal") / 200000, F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") / 400000), F.lit(0.1), F.lit(0.1) + F.col("s_nationkey") / 200).alias("passes")),
    "m13_cheapest_variant": lambda s, d: cheapest_passing(_variants(s, d)),
    "m14_winner_gate": lambda s, d: schema.table(s, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") - 0.05).alias("g"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("sd"), (F.avg("l_tax") - 0.04).alias("dp")).select("l_suppkey", winner_gate(F.col("g"), F.col("sd"), F.col("dp")).alias("wins")),
    "m15_bands": lambda s, d: schema.table(s, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") - 0.05).alias("g"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("sd")).select("l_suppkey", sigma_band(F.col("g"), F.col("sd")).alias("band")),
    "m15_slope": lambda s, d: schema.table(s, d, "lineitem").groupBy("l_linenumber").agg(F.avg("l_quantity").alias("auc")).agg(*(c.alias(n) for c, n in zip(slope_band(F.col("auc"), F.col("l_linenumber")), ("slope", "band"), strict=True))).select(R("slope").alias("slope"), "band"),
    "m18b_noise_floor": lambda s, d: schema.table(s, d, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("v")).agg(F.round(noise_floor(F.col("v")), 8).alias("min_delta")),
    "f34_learning_rates": lambda s, d: learning_rates(schema.table(s, d, "part").select("p_size").distinct().select(F.col("p_size").cast("int").alias("epoch")), 50).select("epoch", "grp", F.round("lr", 12).alias("lr")),
    "f35_lr_range": lambda s, d: lr_range(schema.table(s, d, "part").select((F.col("p_size") - 1).cast("long").alias("step")).distinct(), 50).select("step", F.round("lr", 10).alias("lr")),
    "p15_calibration_guard": lambda s, d: calibration_guard(schema.table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("threshold"), F.lit(1.5).alias("temperature"))).select("s_suppkey", R("threshold").alias("threshold")),
    "p20_packageable": lambda s, d: packageable(schema.table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("RUNNING").alias("status"), F.split("o_orderpriority", "-").alias("files")), ["1", "HIGH"]).filter("ok or missing = '1'"),
}
MAT = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in stats._pairs)
PARTS = "parts AS (SELECT *, p_size::DOUBLE AS x, p_retailprice + CASE WHEN p_type = 'PROMO' THEN p_size * 500 ELSE 0 END AS y, p_size * 2.0 + p_partkey % 5 AS z FROM part)"
REG = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, '{g}' AS regime, corr({a}, {b}) AS r FROM parts WHERE {w}" for g, w in (("all", "true"), ("promo", "p_type = 'PROMO'")) for a, b in (("x", "y"), ("x", "z"), ("y", "z")))
BAND = "avg(l_discount) - 0.05 AS g, stddev_samp(l_discount) / sqrt(count(*)) AS sd"
SQL = {
    "m08_distance_ranking": f"WITH m AS ({MAT}) SELECT CASE WHEN a = 'l_quantity' THEN b ELSE a END AS channel, round(1 - abs(r), 6) AS distance FROM m WHERE a = 'l_quantity' OR b = 'l_quantity'",
    "m09_strong_pairs": f"WITH {PARTS}, m AS ({REG}) SELECT a, b, regime, round(r, 6) AS r FROM m WHERE abs(r) > 0.7 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY abs(r) DESC, regime DESC) = 1",
    "m10_independence": f"WITH m AS ({MAT}) SELECT a, b, round(r, 6) AS r, abs(r) <= 0.5 AS passes FROM m",
    "m11_sign_consistency": f"WITH h AS ({stats.SQL['a23_histogram_mode']}), i AS (SELECT l_returnflag, avg(l_quantity) AS inside FROM lineitem GROUP BY 1) SELECT count(*) FILTER (inside <= mode) AS inversions, count(*) AS n, count(*) FILTER (inside <= mode) <= 1 AS consistent FROM h JOIN i USING (l_returnflag)",
    "m12_multi_scale_gate": "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal / 400000 END, s_acctbal / 200000) >= 0.02 AND 0.1::DOUBLE + s_nationkey / 200 - 0.1::DOUBLE <= 0.1 AS passes FROM supplier",
    "m13_cheapest_variant": f"""WITH {metrics.PIX}, c AS (SELECT ['none', 'minimal', 'standard', 'full'][tile_id % 4 + 1] AS name, {metrics.COUNTS} FROM val GROUP BY 1), v AS (SELECT name, CASE name WHEN 'none' THEN 1 WHEN 'minimal' THEN 2 WHEN 'standard' THEN 4 ELSE 8 END AS cost, 2 * tp / (2 * tp + fp + fn) - 0.3 AS gain, 0.36 - tp / (tp + fp) AS drop FROM c)
      SELECT min_by(name, cost) AS name FROM v WHERE gain >= 0.01 AND drop <= 0.005""",
    "m14_winner_gate": f"SELECT l_suppkey, g >= greatest(2 * sd, 0.01) AND dp >= 0 AS wins FROM (SELECT l_suppkey, {BAND}, avg(l_tax) - 0.04 AS dp FROM lineitem GROUP BY 1)",
    "m15_bands": f"SELECT l_suppkey, CASE WHEN abs(g) / sd < 1 THEN 'noise' WHEN abs(g) / sd < 2 THEN 'weak' WHEN abs(g) / sd < 3 THEN 'moderate' ELSE 'strong' END AS band FROM (SELECT l_suppkey, {BAND} FROM lineitem GROUP BY 1)",
    "m15_slope": "WITH a AS (SELECT l_linenumber AS n, avg(l_quantity) AS auc FROM lineitem GROUP BY 1), s AS (SELECT regr_slope(auc, ln(n)) AS slope FROM a) SELECT round(slope, 6) AS slope, CASE WHEN slope < 0.005 THEN 'saturated' WHEN slope < 0.02 THEN 'slowing' ELSE 'growing' END AS band FROM s",
    "m18b_noise_floor": "SELECT round(2 * stddev_samp(v), 8) AS min_delta FROM (SELECT avg(l_discount) AS v FROM lineitem GROUP BY l_linenumber)",
    "f34_learning_rates": """WITH e AS (SELECT DISTINCT p_size::INT AS epoch FROM part)
      SELECT epoch, 'backbone' AS grp, round(CASE WHEN epoch <= 10 THEN 1e-3 WHEN epoch - 11 < 3 THEN 1e-5 * (epoch - 11) / 2 WHEN epoch <= 15 THEN 1e-5 ELSE 1e-7 + (1e-5 - 1e-7) * (1 + cos(pi() * (epoch - 15) / 35)) / 2 END, 12) AS lr FROM e
      UNION ALL SELECT epoch, 'decoder', round(CASE WHEN epoch <= 10 THEN 1e-3 WHEN epoch - 11 < 5 THEN 1e-6 + (1e-4 - 1e-6) * (epoch - 11) / 4 ELSE 1e-6 + (1e-4 - 1e-6) * (1 + cos(pi() * (epoch - 15) / 35)) / 2 END, 12) FROM e""",
    "f35_lr_range": "SELECT DISTINCT p_size - 1 AS step, round(exp(ln(1e-7) + (p_size - 1) / 49 * (ln(1e-1) - ln(1e-7))), 10) AS lr FROM part",
    "p15_calibration_guard": "SELECT s_suppkey, round(s_acctbal / 10000, 6) AS threshold FROM supplier",
    "p20_packageable": "WITH x AS (SELECT o_orderkey AS run_id, o_orderstatus = 'F' AS fin, list_filter(['1', 'HIGH'], lambda f: NOT list_contains(string_split(o_orderpriority, '-'), f)) AS m FROM orders), y AS (SELECT run_id, fin AND len(m) = 0 AS ok, array_to_string(m, ',') AS missing FROM x) FROM y WHERE ok OR missing = '1'",
}
