"""Exact percentiles of many groups at once by distributed selection, and samples of fixed size by group.

Both look for positions in an order without sorting a group in one task or holding it in one buffer: rows are counted by ranges, and only
the range that holds a position is looked at again, until what is left is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .state_io import Kept

HELD = 1000  # distinct values of a range that one task may hold
PIVOTS = 63


def _same(by: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def percentiles(df: DataFrame, value: str, ps: Sequence[float], kept: Kept, *by: str, held: int = HELD, pivots: int = PIVOTS) -> DataFrame:
    """(by..., n, q): the exact percentiles ps of each group with linear interpolation, as an array. Nulls don't count; a group without values has
    n = 0 and a null q. NaN comes last, null keys are a group, and without `by` there is one row.

    Distinct values are counted first. A position lies in a range (first value, last value, rows before); a range of more than `held` distinct
    values is divided by `pivots` of its own values, those with the least hashes, and the counts between them tell which part
    goes on. The ranges of all groups and positions are divided in the same pass, so passes are the logarithm of the largest
    group. What is left of a range is at most `held` rows.
    """
    by, pivots = list(by), max(2, pivots)  # of two values one always divides a range
    key = by or ["_g"]
    v = F.col(value).cast("double").alias("v")
    rows = df.select(*by, v) if by else df.select(F.lit(0).alias("_g"), v)
    counts = kept.put(rows.filter("v IS NOT NULL").groupBy(*key, "v").agg(F.count("*").alias("n")))
    groups = rows.groupBy(*key).agg(F.count("v").alias("total"))
    groups = kept.put(groups if by else groups.unionByName(df.sparkSession.createDataFrame([(0, 0)], "_g int, total long")).groupBy("_g").agg(F.sum("total").alias("total")))
    # the neighbours of each position p * (n - 1), from 0
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    whole = counts.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("n"))
    ks = F.array_distinct(F.array(*(f(at(p)).cast("long") for p in ps for f in (F.floor, F.ceil))))
    state = kept.put(whole.select(*key, "lo", "hi", F.lit(0).cast("long").alias("before"), "m", ks.alias("ks")))
    small = []
    while True:
        small.append(state.filter(F.col("m") <= held))
        live = state.filter(F.col("m") > held)
        if not live.limit(1).count():
            break
        state = kept.put(_divided(counts, kept.put(live), key, pivots))
    ranges = small[0]
    for s in small[1:]:
        ranges = ranges.unionByName(s)
    inside = counts.alias("c").join(ranges.alias("r"), _same(key, "c", "r") & F.col("c.v").between(F.col("r.lo"), F.col("r.hi")))
    lists = inside.groupBy(*(F.col(f"r.{c}").alias(c) for c in key), "lo", "before", "ks").agg(F.array_sort(F.collect_list(F.struct(F.col("c.v").alias("v"), F.col("c.n").alias("n")))).alias("vs"))
    # the value at each place: the first whose rows reach beyond it
    step = lambda k: F.aggregate("vs", F.struct(F.col("before").alias("n"), F.lit(None).cast("double").alias("v")), lambda s, x: F.when(s["n"] > k, s).otherwise(F.struct((s["n"] + x["n"]).alias("n"), x["v"].alias("v"))), lambda s: s["v"])
    found = lists.select(*key, F.explode(F.transform("ks", lambda k: F.struct(k.alias("k"), step(k).alias("v")))).alias("x"))
    values = found.groupBy(*key).agg(F.map_from_entries(F.collect_list("x")).alias("at"))
    out = groups.alias("g").join(values.alias("x"), _same(key, "g", "x"), "left").select(*(F.col(f"g.{c}").alias(c) for c in key), F.col("total").alias("n"), "at")

    def one(p: float) -> Column:
        low, high = F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(low == high, a).otherwise((high - at(p)) * a + (at(p) - low) * b)

    return out.select(*by, "n", F.when(F.col("n") > 0, F.array(*(one(p) for p in ps))).alias("q"))


def _divided(counts: DataFrame, live: DataFrame, key: Sequence[str], pivots: int) -> DataFrame:
    """The parts of the ranges `live` (key..., lo, hi, before, m, ks) that hold a place of ks."""
    rows = counts.alias("c").join(live.alias("r"), _same(key, "c", "r") & F.col("c.v").between(F.col("r.lo"), F.col("r.hi")))
    rows = rows.select(*(F.col(f"r.{c}").alias(c) for c in key), "lo", "before", "ks", F.col("c.v").alias("v"), F.col("c.n").alias("n"))
    first = W.partitionBy(*key, "lo").orderBy(F.xxhash64("v", "before"), "v")
    chosen = rows.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= pivots)  # limited in each task before it is dealt out
    cuts = chosen.groupBy(*key, "lo").agg(F.array_sort(F.collect_list("v")).alias("cuts"))
    cut = rows.alias("a").join(cuts.alias("b"), _same([*key, "lo"], "a", "b")).select("a.*", "cuts")
    part = cut.withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
    sums = part.groupBy(*key, "lo", "before", "ks", "part").agg(F.min("v").alias("new_lo"), F.max("v").alias("new_hi"), F.count("*").alias("m"), F.sum("n").alias("n"))
    run = W.partitionBy(*key, "lo").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)  # as many rows as a range has parts
    sums = sums.withColumn("after", F.col("before") + F.sum("n").over(run))
    ks = F.filter("ks", lambda k: (k >= F.col("after") - F.col("n")) & (k < F.col("after")))
    return sums.select(*key, F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), (F.col("after") - F.col("n")).alias("before"), "m", ks.alias("ks")).filter(F.size("ks") > 0)


def group_sample(df: DataFrame, by: Sequence[str], order: Sequence[Column], quota: Column, kept: Kept, held: int = HELD) -> DataFrame:
    """The first rows of each group in an order by its quota (a column that is equal in a group; null or less than 1: none).

    order: a hash from 0 to 2^48 - 1 first, so that ranges of it hold about as many rows each, then what settles ties. Groups of which at most
    `held` rows are wanted are limited in each task before they are dealt out. Of the others the rows are counted by 4,096 ranges of the hash:
    ranges below the quota are taken whole, where they lie; only the range in which it ends is sorted, and it is divided as often
    as it holds more than that itself.
    """
    by = list(by)
    rows = df.withColumn("_h", order[0]).withColumn("_q", F.coalesce(quota, F.lit(0)).cast("long")).filter("_q > 0")
    few = W.partitionBy(*by).orderBy("_h", *order[1:])
    head = rows.filter(F.col("_q") <= held).withColumn("_i", F.row_number().over(few)).filter((F.col("_i") <= held) & (F.col("_i") <= F.col("_q"))).drop("_i")
    large = rows.filter(F.col("_q") > held)
    state = large.groupBy(*by).agg(F.max("_q").alias("_left"), F.count("*").alias("_n")).select(*by, F.lit(0.0).alias("_lo"), F.lit(2.0**48).alias("_w"), "_left", "_n")
    state = kept.put(state)
    slot = F.floor((F.col("_h").cast("double") - F.col("_lo")) / F.col("_w") * 4096)
    done = []
    while True:
        # a range that is wanted whole, or is small, or can't be divided any more
        end = (F.col("_n") <= F.greatest(F.col("_left"), F.lit(held))) | (F.col("_w") <= 1)
        done.append(state.filter(end))
        live = state.filter(~end)
        if not live.limit(1).count():
            break
        at = large.alias("a").join(live.alias("s"), _same(by, "a", "s")).select(*(F.col(f"s.{c}").alias(c) for c in by), "_h", "_lo", "_w", "_left")
        sums = at.withColumn("_b", slot).filter("_b >= 0 AND _b < 4096").groupBy(*by, "_lo", "_w", "_left", "_b").agg(F.count("*").alias("_n"))
        run = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = sums.withColumn("_to", F.sum("_n").over(run)).filter(F.col("_to") - F.col("_n") < F.col("_left")).withColumn("_last", F.max("_b").over(W.partitionBy(*by)))
        last = sums.filter(F.col("_b") == F.col("_last"))
        part = F.col("_w") / 4096
        state = kept.put(last.select(*by, (F.col("_lo") + F.col("_b") * part).alias("_lo"), part.alias("_w"), (F.col("_left") - F.col("_to") + F.col("_n")).alias("_left"), "_n"))
    bounds = done[0]
    for s in done[1:]:
        bounds = bounds.unionByName(s)
    at = large.alias("a").join(bounds.alias("s"), _same(by, "a", "s")).select("a.*", "s._lo", "s._w", "s._left", "s._n")
    h = F.col("_h").cast("double")
    below = at.filter(h < F.col("_lo"))
    inside = at.filter((h >= F.col("_lo")) & (h < F.col("_lo") + F.col("_w")))
    whole = inside.filter(F.col("_n") <= F.col("_left"))
    cut = inside.filter(F.col("_n") > F.col("_left")).withColumn("_i", F.row_number().over(few)).filter(F.col("_i") <= F.col("_left"))
    out = head.select(*df.columns)
    for x in (below, whole, cut):
        out = out.unionByName(x.select(*df.columns))
    return out
