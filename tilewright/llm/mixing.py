"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Of all document rates between 0 and MOST, those nearest in entropy to a rate of 1 that meet the sources' token targets are
exponentially tilted: rate = 2 / (1 + exp(-lambda * tokens)), with one multiplier per source, found as the maximum of the convex
dual by Newton steps. A step sums the gradient and the curvature over a table of (source, size, count), which stands
for all documents exactly; steps that leave the bracket known so far are replaced by its middle. The rates are rounded
to copies at a random offset by a hash of the id, and a shift of that offset for each source, found in three passes over
sums by bucket, brings the words taken up to the target. Where the next document is too long for what is missing, shorter
ones fill the gap in the same way.

Targets: sources by code point, null last, take the weights in turn; a source gets its share of all tokens, at most MOST
times what it has, and what is above that is shared by weight among the others until none is above.

Defined results: a null text has 0 words and rate 1 before the shift; a source without words has target 0; a null source is
a source of its own; repeated rows of an id take the same copies; an empty table gives an empty result. Only id, text and source
are read; other columns, whatever their names, are carried along, but for those with the name of an output. Multipliers that
don't converge raise RuntimeError.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
STEPS = 80  # the bracket alone would do in fewer
NEAR = 1e-7  # of a source's tokens
BUCKETS, PASSES = 4096, 3
ROUNDS, CLOSE = 5, 1e-3


def n_words(text: Column) -> Column:
    """Runs outside ASCII white space; the words aren't built: ends of words are counted."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(flat, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: a row (source, size) for each. Adds weight and target.

    Filled like vessels: with the sources by size over weight, the level at which the next isn't full gives all targets.
    The windows hold one row for each source, not its documents, so their number has to fit a task (millions do).
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = sources.withColumn("weight", w).withColumn("_cap", F.lit(float(most)) * F.col("size"))
    total = F.sum(F.col("size").cast("double")).over(W.partitionBy()) * share
    filling = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(1, W.unboundedFollowing)
    full = full.withColumn("_total", total).withColumn("_filled", F.sum("_cap").over(filling)).withColumn("_open", F.coalesce(F.sum("weight").over(rest), F.lit(0.0)))
    # a source is full if the level at which it is, filled so for all, takes no more than the total
    level = F.col("_cap") / F.col("weight")
    full = full.withColumn("_full", F.col("_filled") + level * F.col("_open") <= F.col("_total"))
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(W.partitionBy()), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(W.partitionBy())
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), (F.col("_total") - taken) * F.col("weight") / open_weight))
    return full.withColumn("target", target).drop("_cap", "_total", "_filled", "_open", "_full")


def rate(lam: Column, size: Column, mean: Column) -> Column:
    """MOST / (1 + exp(-lambda * size / mean)), in a form that doesn't overflow."""
    z = F.greatest(F.least(lam * size / mean, F.lit(500.0)), F.lit(-500.0))
    return F.lit(float(MOST)) / (F.lit(1.0) + F.exp(-z))


def multipliers(sizes: DataFrame, goals: DataFrame, stages: common.Stages) -> DataFrame:
    """goals with lambda for each source. sizes: (source, size, n), written; goals: (source, size, n_docs, weight, target).

    Sources whose target is all or nothing keep lambda 0 and are flagged by _edge; their rate is the bound itself.
    """
    share = F.when(F.col("size") > 0, F.col("target") / (F.lit(float(MOST)) * F.col("size"))).otherwise(0.0)
    edge = F.when(share >= 1.0, 1).when((share <= 0.0) & (F.col("size") > 0), -1).otherwise(0)
    state = goals.withColumn("_mean", F.greatest(F.col("size") / F.col("n_docs"), F.lit(1.0))).withColumn("_edge", edge)
    inner = F.greatest(F.least(share, F.lit(1 - 1e-12)), F.lit(1e-12))
    state = state.withColumn("lam", F.when(F.col("_edge") == 0, F.ln(inner / (1 - inner))).otherwise(0.0))
    state = state.withColumn("_lo", F.lit(-1e12)).withColumn("_hi", F.lit(1e12)).withColumn("_off", F.lit(1.0))
    state = stages.put(state)
    for _ in range(STEPS):
        before, state = state, stages.put(_newton(sizes, state))
        stages.drop(before)
        if not state.filter(F.col("_off") > NEAR).limit(1).count():
            return state
    raise RuntimeError("the multipliers didn't converge")


def _newton(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """A step for each source: one join, whose rows are summed by source at once."""
    names = state.columns
    mine = state.select(F.struct(*names).alias("_state"))
    # few rows a source, and none without; the state's size is known, as it is written
    at = sizes.select(F.col("source").alias("_s"), F.col("size").alias("_x"), "n").join(mine, F.col("_s").eqNullSafe(F.col("_state.source")))
    x = F.col("_x").cast("double")
    r = rate(F.col("_state.lam"), x, F.col("_state._mean"))
    sums = at.groupBy("_state").agg(F.sum(F.col("n") * x * r).alias("_f"), F.sum(F.col("n") * x * x / F.col("_state._mean") * r * (1 - r / MOST)).alias("_g"))
    both = sums.select("_state.*", "_f", "_g")
    gap = F.col("_f") - F.col("target")
    both = both.withColumn("_lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("_lo"))).withColumn("_hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("_hi")))
    step = F.col("lam") - F.when(F.col("_g") > 0, gap / F.col("_g"))
    wide = (F.col("_lo") <= -1e12) | (F.col("_hi") >= 1e12)
    # outside the bracket: its middle, or twice as far while it is open
    other = F.when(wide, F.col("lam") * 2 - F.signum(gap)).otherwise((F.col("_lo") + F.col("_hi")) / 2)
    step = F.when((step > F.col("_lo")) & (step < F.col("_hi")) & (F.abs(step - F.col("lam")) <= 1 + 2 * F.abs(F.col("lam"))), step).otherwise(other)
    off = F.abs(gap) / F.greatest(F.col("size"), F.lit(1))
    still = (F.col("_edge") == 0) & (off > NEAR) & F.col("_f").isNotNull()
    both = both.withColumn("_off", F.when(still, off).otherwise(0.0)).withColumn("lam", F.when(still, step).otherwise(F.col("lam")))
    return both.select(*names)


def solve(df: DataFrame, stages: common.Stages, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target, lam, _mean, _edge, _steps) for each source of df (doc_id, text, source)."""
    before = set(stages.live)
    rows = stages.put(df.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")))
    sizes = stages.put(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("n_docs"))
    goals = multipliers(sizes, targets(per, weights, share), stages).withColumnRenamed("size", "source_size").select("source", "source_size", "target", "lam", "_mean", "_edge")
    rows = stages.put(placed(rows, goals).select("source", "size", "_at"))
    steps = _shifts(rows, goals, stages).select(F.col("source").alias("_s"), "_steps")
    # written, so that its size is known where the documents are joined to it
    out = stages.put(goals.join(steps, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    stages.clear(out, before=before)
    return out


def placed(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with their source's columns of goals, their rate and their place _at on the scale of copies."""
    rows = rows.join(goals.withColumnRenamed("source", "_s"), F.col("source").cast("string").eqNullSafe(F.col("_s"))).drop("_s")
    r = F.when(F.col("_edge") == 1, F.lit(float(MOST))).when(F.col("_edge") == -1, 0.0).otherwise(rate(F.col("lam"), F.col("size"), F.col("_mean")))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") / float(1 << 53)
    return rows.withColumn("rate", r).withColumn("_at", F.col("rate") + unit)


OUTPUTS = ("size", "source_size", "target", "rate", "copies", "taken")


def mix(df: DataFrame, stages: common.Stages, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """df (doc_id, text, source, ...) with size, source_size, target, rate, copies and taken; the texts aren't dealt out, only
    the table of sources is joined to them. Columns of df with these names are replaced; others may have any name."""
    keep = [c for c in df.columns if c not in OUTPUTS]
    work = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = placed(work, solve(df, stages, weights, share))
    flips = sum((F.when(_taken(_breaks(k)), 1).otherwise(0) for k in range(1, MOST + 1)), F.lit(0))
    rows = rows.withColumn("copies", flips.cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return rows.select("row.*", *OUTPUTS)


def _breaks(k: int) -> Column:
    """The shift from which a row takes k copies."""
    return F.lit(float(k)) - F.col("_at")


def _taken(at: Column) -> Column:
    """Whether a copy that starts at the shift `at` is taken: by one of the source's steps (shift, greatest size)."""
    return F.exists("_steps", lambda t: (at <= t["d"]) & (F.col("size") <= t["most"]))


def _shifts(rows: DataFrame, goals: DataFrame, stages: common.Stages) -> DataFrame:
    """(source, _steps). The first step shifts all documents up to the target; while more than CLOSE of a target is missing,
    as the next document is too long, another goes on with those of a quarter of the gap at most."""
    none = F.array().cast("array<struct<d:double,most:double>>")
    state = goals.select("source", "target", F.lit(0.0).alias("got"), none.alias("_steps"))
    flips = rows.filter(F.col("size") > 0).select(F.col("source").alias("_s"), "size", F.explode(F.array(*(_breaks(k) for k in range(1, MOST + 1)))).alias("_x"))
    for step in range(ROUNDS):
        most = F.lit(float("inf")) if not step else (F.col("target") - F.col("got")) / 4
        new = _shift(flips, state.select("source", "_steps", (F.col("target") - F.col("got")).alias("target"), most.alias("_most")))
        new = new.select(F.col("source").alias("_s"), F.col("_a").alias("d"), "_most", "_base")
        state = state.join(new, F.col("source").eqNullSafe(F.col("_s"))).select("source", "target", (F.col("got") + F.col("_base")).alias("got"), F.concat("_steps", F.array(F.struct("d", F.col("_most").alias("most")))).alias("_steps"))
        state = stages.put(state)
        if not state.filter(F.col("target") - F.col("got") > CLOSE * F.col("target")).limit(1).count():
            break
    # the shortest copy left, where passing the target by it comes nearer
    gap = F.col("target") - F.col("got")
    left = flips.join(state, F.col("source").eqNullSafe(F.col("_s"))).filter(~_taken(F.col("_x")) & (F.col("size") < 2 * gap))
    one = left.groupBy("source").agg(F.min(F.struct(F.col("size").cast("double").alias("most"), F.col("_x").alias("d"))).alias("m")).select(F.col("source").alias("_s"), "m")
    state = state.join(one, F.col("source").eqNullSafe(F.col("_s")), "left")
    more = F.when(F.col("m").isNotNull(), F.array(F.struct("m.d", "m.most"))).otherwise(none)
    return state.select("source", F.concat("_steps", more).alias("_steps"))


def _shift(flips: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, _a, _most, _base): the greatest shift at which the words of copies not yet taken stay under the target, and those words.

    Each pass sums the words of the copies that start in each of BUCKETS equal parts of the range left and keeps the part
    where the target is passed; a window holds BUCKETS rows of a source at most.
    """
    state = goals.select("source", "target", "_most", "_steps", F.lit(-2.0 - 1e-9).alias("_a"), F.lit(MOST + 4e-9 + 2.0).alias("_w"), F.lit(0.0).alias("_base"))
    for _ in range(PASSES):
        at = F.floor((F.col("_x") - F.col("_a")) / F.col("_w") * BUCKETS)
        inside = flips.join(state, F.col("source").eqNullSafe(F.col("_s"))).filter((F.col("_x") >= F.col("_a")) & (at < BUCKETS) & (at >= 0) & (F.col("size") <= F.col("_most")) & ~_taken(F.col("_x")))
        parts = inside.groupBy("source", at.alias("_b")).agg(F.sum("size").cast("double").alias("_v"))
        w = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
        parts = parts.withColumn("_sum", F.sum("_v").over(w)).select(F.col("source").alias("_s"), "_b", "_sum")
        found = state.join(parts, F.col("source").eqNullSafe(F.col("_s")), "left")
        under = F.col("_base") + F.col("_sum") <= F.col("target") + 1e-6
        found = found.groupBy("source", "target", "_most", "_steps", "_a", "_w", "_base").agg(F.min(F.when(~under, F.col("_b"))).alias("_b"), F.max(F.when(under, F.col("_sum"))).alias("_below"))
        part = F.col("_w") / BUCKETS
        state = found.select("source", "target", "_most", "_steps", F.when(F.col("_b").isNull(), F.col("_a") + F.col("_w")).otherwise(F.col("_a") + F.col("_b") * part).alias("_a"), part.alias("_w"), (F.col("_base") + F.coalesce("_below", F.lit(0.0))).alias("_base"))
    return state.select("source", "_a", "_most", "_base")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, common.Stages(spark, "op1")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


QUERIES = {"op1_source_mixing": op1_source_mixing}
SQL: dict[str, str] = {}
