"""Evaluation metrics of scored pixels: counts, precision-recall curves, losses, calibration.

Predictions are a long table with a score (probability), a label (0, 1, 255 = ignore) and a tile. Curves are built over
distinct scores: rows are first summed by score, so no window or task ever holds all pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..schema import IGNORE
from .state_io import Kept
from .stats import running

FLOOR = 1e-12
CLIP = 1e-7
#: Tile ratios at which average precision is given.
RATIOS = (200, 500, 1000)


def valid(label: Column) -> Column:
    return label != IGNORE


def binary(score: Column, threshold: float | Column) -> Column:
    return (score >= threshold).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return F.ln(q / (1 - q))


def fuse_logits(a: Column, b: Column) -> Column:
    """Mean in probability space, back as a logit."""
    return logit((sigmoid(a) + sigmoid(b)) / 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pixel_counts(df: DataFrame, threshold: float, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn, iou, f1, precision and recall over valid pixels."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    c = df.filter(valid(F.col(label))).groupBy(*by).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumn("iou", ratio(tp, tp + fp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))


def by_score(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """(score, pos, neg) for each distinct score."""
    w = F.lit(1) if weight is None else F.col(weight)
    true = F.col(label) == 1
    return df.filter(valid(F.col(label))).groupBy(F.col(score).alias("score")).agg(F.sum(F.when(true, w).otherwise(0)).alias("pos"), F.sum(F.when(~true, w).otherwise(0)).alias("neg"))


def pr_curve(scores: DataFrame) -> DataFrame:
    """scores: (score, pos, neg). Precision and recall of taking everything from each score on; ties are one point."""
    total = scores.agg(F.sum("pos").alias("_p"))
    c = running(scores, "score", {"tp": "pos", "fp": "neg"}, descending=True).crossJoin(F.broadcast(total))  # one row
    return c.select(F.col("score").alias("threshold"), "tp", "fp", "pos", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("_p")).alias("recall"), "_p")


def average_precision(scores: DataFrame) -> DataFrame:
    """One row: ap, the sum over points of the gain in recall times precision; 0 without positives."""
    return pr_curve(scores).agg(F.coalesce(F.sum(ratio(F.col("pos"), F.col("_p")) * F.col("precision")), F.lit(0.0)).alias("ap"))


def geomean(v: Column) -> Column:
    return F.exp(F.avg(F.ln(F.greatest(v, F.lit(FLOOR)))))


def ap_at_ratios(pixels: DataFrame, tiles: DataFrame, ratios: tuple[int, ...] = RATIOS, seed: int = 42) -> DataFrame:
    """(ratio, ap, n_neg, bootstrapped): average precision with ratio negative tiles for each positive one.

    tiles: (tile_id, is_pos). Too few negatives are drawn again with replacement: each tile then weighs as often as it is drawn.
    """
    from .sampling import hash_order, take

    kept = Kept(tiles.sparkSession, "ratios")
    tiles = kept.put(tiles.select("tile_id", "is_pos"))  # each ratio reads them again
    n = tiles.agg(F.count_if("is_pos").alias("p"), F.count_if(~F.col("is_pos")).alias("n")).first()
    negatives, needs = tiles.filter(~F.col("is_pos")).select("tile_id"), {k: n.p * r for k, r in enumerate(ratios)}
    weights = lambda df, own: df.select("tile_id", *(own.get(k, F.lit(0)).cast("long").alias(f"_w{k}") for k in needs))
    chosen = weights(tiles.filter("is_pos"), dict.fromkeys(needs, F.lit(1)))
    for k, need in needs.items():
        if need <= n.n:
            chosen = chosen.union(weights(take(negatives, need, hash_order(F.col("tile_id"), seed), "tile_id"), {k: F.lit(1)}))
    if more := {k: need for k, need in needs.items() if need > n.n}:  # the draws of a lesser ratio are the first ones of a greater one
        drawn = F.conv(F.substring(hash_order(F.col("id"), seed).cast("string"), 1, 12), 16, 10).cast("long")
        picks = tiles.sparkSession.range(max(more.values())).groupBy(F.pmod(drawn, F.lit(max(n.n, 1))).alias("_i")).agg(*(F.count_if(F.col("id") < need).alias(f"_d{k}") for k, need in more.items()))
        numbered = running(negatives.select("tile_id", F.lit(1).alias("_one")), "tile_id", {"_i": "_one"}).select("tile_id", (F.col("_i") - 1).alias("_i"))
        chosen = chosen.union(weights(numbered.join(picks, "_i"), {k: F.col(f"_d{k}") for k in more}))
    chosen = chosen.groupBy("tile_id").agg(*(F.sum(f"_w{k}").alias(f"_w{k}") for k in needs))
    true = F.col("label") == 1
    # generated pixels look few to the optimizer; neither side is broadcast
    met = pixels.select("tile_id", "score", "label").filter(valid(F.col("label"))).join(chosen.hint("merge"), "tile_id")
    sums = [F.sum(F.when(c, F.col(f"_w{k}")).otherwise(0)).alias(f"{s}{k}") for k in needs for s, c in (("_pos", true), ("_neg", ~true))]
    scores = kept.put(met.groupBy("score").agg(*sums))
    out = None
    for k, r in enumerate(ratios):
        own = scores.select("score", F.col(f"_pos{k}").alias("pos"), F.col(f"_neg{k}").alias("neg")).filter("pos + neg > 0")
        ap = average_precision(own).select(F.lit(r).alias("ratio"), "ap", F.lit(needs[k]).cast("long").alias("n_neg"), F.lit(needs[k] > n.n).alias("bootstrapped"))
        out = ap if out is None else out.union(ap)
    return out


def threshold_at_precision(curve: DataFrame, target: float) -> DataFrame:
    """The point of most recall, then least threshold, with at least the target precision."""
    return curve.filter(F.col("precision") >= target).agg(F.max_by(F.struct("threshold", "precision", "recall"), F.struct("recall", F.negative("threshold"))).alias("x")).select("x.*")


def fit_temperature(df: DataFrame, grid: list[float], logit_col: str = "logit", label: str = "label") -> DataFrame:
    """(temperature, nll) of the least negative log-likelihood; one aggregation over all grid points, ties to the lowest."""
    x, y = F.col(logit_col), (F.col(label) == 1).cast("double")
    row = df.filter(valid(F.col(label))).agg(F.array(*(F.struct(F.avg(stable_bce(x / t, y)).alias("nll"), F.lit(float(t)).alias("temperature")) for t in grid)).alias("g"))
    return row.select(F.array_min("g").alias("x")).select("x.temperature", "x.nll")


# Losses: per-pixel expressions, and means over tiles.


def stable_bce(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal_pixel(x: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = sigmoid(x)
    pt = F.when(y == 1, p).otherwise(1 - p)
    return F.when(y == 1, F.lit(alpha)).otherwise(1 - alpha) * F.pow(1 - pt, F.lit(gamma)) * stable_bce(x, y)


def focal_loss(df: DataFrame, *by: str, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """Mean over valid pixels, with a denominator of at least 1."""
    x, y = F.col("logit"), F.col("label").cast("double")
    v = F.when(valid(F.col("label")), focal_pixel(x, y, gamma, alpha))
    return df.groupBy(*by).agg((F.coalesce(F.sum(v), F.lit(0.0)) / F.greatest(F.count(v), F.lit(1))).alias("focal"))


def tversky_by_tile(df: DataFrame, alpha: float = 0.5, beta: float = 0.5, eps: float = 1.0) -> DataFrame:
    p, y = sigmoid(F.col("logit")), F.col("label").cast("double")
    s = lambda c: F.coalesce(F.sum(F.when(valid(F.col("label")), c)), F.lit(0.0))
    tp, fn, fp = s(p * y), s((1 - p) * y), s(p * (1 - y))
    return df.groupBy("tile_id").agg((1 - (tp + eps) / (tp + alpha * fn + beta * fp + eps)).alias("loss"))


def tversky_loss(df: DataFrame, alpha: float = 0.5, beta: float = 0.5, eps: float = 1.0) -> DataFrame:
    """alpha weighs false negatives, beta false positives; mean of the tiles' losses."""
    return tversky_by_tile(df, alpha, beta, eps).agg(F.avg("loss").alias("tversky"))


def dice_loss(df: DataFrame, eps: float = 1.0) -> DataFrame:
    """Tversky's loss of one half each with half the smoothing is Dice's."""
    return tversky_by_tile(df, 0.5, 0.5, eps / 2).agg(F.avg("loss").alias("dice"))


def compound_loss(df: DataFrame, focal_weight: float = 1.0, dice_weight: float = 1.0) -> DataFrame:
    both = focal_loss(df).crossJoin(dice_loss(df))  # one row each
    return both.select((focal_weight * F.col("focal") + dice_weight * F.col("dice")).alias("compound"))


#: Losses by name.
LOSSES: dict[str, Callable[..., DataFrame]] = {"focal": focal_loss, "dice": dice_loss, "tversky": tversky_loss, "compound": compound_loss}


def build_loss(name: str) -> Callable[..., DataFrame]:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}")
    return LOSSES[name]


def class_weight(bg: Column, fg: Column, kind: str = "linear") -> Column:
    r = bg / fg
    return {"linear": r, "sqrt": F.sqrt(r), "log": F.log1p(r)}[kind]


def scaled_confusion(counts: DataFrame, per: int = 500) -> DataFrame:
    """The counts with negatives scaled down to per for each positive, rounded half to even."""
    scale = F.least(F.lit(1.0), per * (F.col("tp") + F.col("fn")) / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)))
    return counts.select("tp", "fn", F.bround(F.col("fp") * scale).cast("long").alias("fp"), F.bround(F.col("tn") * scale).cast("long").alias("tn"))


# --- queries -------------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as pixels: tile = order, score from the price, label from the return flag, a fifth ignored."""
    li = schema.table(spark, d, "lineitem")
    label = F.when(F.col("l_linenumber") == 7, IGNORE).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return li.select(F.col("l_orderkey").alias("tile_id"), (F.floor(F.col("l_extendedprice") / 100) / 1000).alias("score"), label.alias("label"), ((F.col("l_quantity") - 25) / 10).alias("logit"), "l_linestatus")


PIX = """pix AS (SELECT l_orderkey AS tile_id, floor(l_extendedprice / 100) / 1000 AS score, CASE WHEN l_linenumber = 7 THEN 255 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, (l_quantity - 25) / 10 AS logit, l_linestatus FROM lineitem),
  val AS (SELECT *, label::DOUBLE AS y, 1 / (1 + exp(-logit)) AS p FROM pix WHERE label <> 255)"""
CURVE = f"""WITH {PIX}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM val GROUP BY 1),
  c AS (SELECT score AS threshold, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS allp FROM g)"""
BCE = "greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))"
R = lambda c, n=6: F.round(c, n)


def _quality(spark, d):
    """Documents by length as scores of the quality label."""
    return schema.table(spark, d, "documents").join(schema.table(spark, d, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))


def _ap_by_ratio(s, d):
    px = _scored(s, d)
    tiles = px.groupBy("tile_id").agg(F.max(F.col("label") == 1).alias("is_pos"))
    return ap_at_ratios(px, tiles, (1, 5, 20)).select("ratio", R("ap").alias("ap"), "n_neg", "bootstrapped")


GRID = [i / 4 for i in range(2, 21)]
QUERIES = {
    "p06_valid_target_mask": lambda s, d: _scored(s, d).agg(F.count_if(valid(F.col("label"))).alias("n_valid"), F.count_if(F.col("label") == 1).alias("n_target")),
    "p12_threshold": lambda s, d: _scored(s, d).groupBy(binary(F.col("score"), 0.5).alias("hit")).agg(F.count("*").alias("n")),
    "a19_pixel_counts": lambda s, d: pixel_counts(_scored(s, d), 0.5, "l_linestatus").select("l_linestatus", "tp", "fp", "fn", "tn", *(R(c).alias(c) for c in ("iou", "f1", "precision", "recall"))),
    "a20_average_precision": lambda s, d: average_precision(by_score(_scored(s, d))).select(R("ap").alias("ap")),
    "a20_quality_precision": lambda s, d: average_precision(by_score(_quality(s, d))).select(R("ap").alias("ap")),
    "a21_geomean": lambda s, d: pixel_counts(_scored(s, d), 0.5, "l_linestatus").agg(R(geomean(F.col("precision"))).alias("geomean")),
    "a35_rates": lambda s, d: pixel_counts(_scored(s, d), 0.5).select((F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))).alias("a"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("b")).select(R("a").alias("fp_rate"), R("b").alias("precision")),
    "w05_precision_recall_gain": lambda s, d: pr_curve(by_score(_scored(s, d))).select("threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp")),
    "w07_pr_curve": lambda s, d: pr_curve(by_score(_scored(s, d))).select("threshold", R("precision").alias("precision"), R("recall").alias("recall")),
    "m03_ap_at_ratios": _ap_by_ratio,
    "m17_temperature": lambda s, d: fit_temperature(_scored(s, d), GRID).select("temperature", R("nll").alias("nll")),
    "m18_threshold_at_precision": lambda s, d: threshold_at_precision(pr_curve(by_score(_scored(s, d))), 0.33).select("threshold", R("precision").alias("precision"), R("recall").alias("recall")),
    "f12_logit_fusion": lambda s, d: _scored(s, d).groupBy("tile_id").agg(F.min("logit").alias("a"), F.max("logit").alias("b")).select("tile_id", R(fuse_logits(F.col("a"), F.col("b"))).alias("fused")),
    "f13_temperature_scaling": lambda s, d: _scored(s, d).groupBy("tile_id").agg(R(F.avg(sigmoid(F.col("logit") / 1.5))).alias("p")),
    "f29_focal_loss": lambda s, d: focal_loss(_scored(s, d), "l_linestatus").select("l_linestatus", R("focal").alias("focal")),
    "f30_dice_loss": lambda s, d: dice_loss(_scored(s, d)).select(R("dice").alias("dice")),
    "f31_tversky_loss": lambda s, d: tversky_loss(_scored(s, d), 0.7, 0.3).select(R("tversky").alias("tversky")),
    "f32_compound_loss": lambda s, d: compound_loss(_scored(s, d)).select(R("compound").alias("compound")),
    "f33_class_weights": lambda s, d: _scored(s, d).groupBy("l_linestatus").agg(F.count_if(F.col("label") == 0).alias("bg"), F.count_if(F.col("label") == 1).alias("fg")).select("l_linestatus", *(R(class_weight(F.col("bg"), F.col("fg"), k)).alias(k) for k in ("linear", "sqrt", "log"))),
    "f37_scaled_confusion": lambda s, d: scaled_confusion(pixel_counts(_scored(s, d), 0.5), 1),
}
COUNTS = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn"
TVERSKY = "avg(1 - (tp + {e}) / (tp + {a} * fn + {b} * fp + {e}))"
SUMS = f"WITH {PIX}, s AS (SELECT tile_id, coalesce(sum(p * y), 0) AS tp, coalesce(sum((1 - p) * y), 0) AS fn, coalesce(sum(p * (1 - y)), 0) AS fp FROM (SELECT DISTINCT tile_id FROM pix) LEFT JOIN val USING (tile_id) GROUP BY 1)"
FOCAL = f"sum(CASE WHEN y = 1 THEN 0.25 * pow(1 - p, 2) ELSE 0.75 * pow(p, 2) END * ({BCE})) / count(*)"
SQL = {
    "p06_valid_target_mask": f"WITH {PIX} SELECT count(*) FILTER (label <> 255) AS n_valid, count(*) FILTER (label = 1) AS n_target FROM pix",
    "p12_threshold": f"WITH {PIX} SELECT (score >= 0.5)::INT AS hit, count(*) AS n FROM pix GROUP BY 1",
    "a19_pixel_counts": f"WITH {PIX}, c AS (SELECT l_linestatus, {COUNTS} FROM val GROUP BY 1) SELECT *, round(tp / (tp + fp + fn), 6) AS iou, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c",
    "a20_average_precision": f"{CURVE} SELECT round(sum(pos / allp * (tp / (tp + fp))), 6) AS ap FROM c",
    "a20_quality_precision": """WITH g AS (SELECT n_chars AS score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY 1),
      c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS allp FROM g) SELECT round(sum(pos / allp * (tp / (tp + fp))), 6) AS ap FROM c""",
    "a21_geomean": f"WITH {PIX}, c AS (SELECT l_linestatus, {COUNTS} FROM val GROUP BY 1) SELECT round(exp(avg(ln(greatest(tp / (tp + fp), 1e-12)))), 6) AS geomean FROM c",
    "a35_rates": f"WITH {PIX}, c AS (SELECT {COUNTS} FROM val) SELECT round(fp / greatest(fp + tn, 1), 6) AS fp_rate, round(tp / greatest(tp + fp, 1), 6) AS precision FROM c",
    "w05_precision_recall_gain": f"{CURVE} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c",
    "w07_pr_curve": f"{CURVE} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / allp, 6) AS recall FROM c",
    "m17_temperature": f"WITH {PIX}, t AS (SELECT unnest({GRID})::DOUBLE AS temperature), n AS (SELECT temperature, avg(greatest(logit / temperature, 0) - logit / temperature * y + ln(1 + exp(-abs(logit / temperature)))) AS nll FROM val, t GROUP BY 1) SELECT temperature, round(nll, 6) AS nll FROM n ORDER BY n.nll, temperature LIMIT 1",
    "m18_threshold_at_precision": f"{CURVE} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / allp, 6) AS recall FROM c WHERE tp / (tp + fp) >= 0.33 ORDER BY tp DESC, threshold LIMIT 1",
    "f12_logit_fusion": f"WITH {PIX}, x AS (SELECT tile_id, (1 / (1 + exp(-min(logit))) + 1 / (1 + exp(-max(logit)))) / 2 AS p FROM pix GROUP BY 1) SELECT tile_id, round(ln(p / (1 - p)), 6) AS fused FROM x",
    "f13_temperature_scaling": f"WITH {PIX} SELECT tile_id, round(avg(1 / (1 + exp(-logit / 1.5))), 6) AS p FROM pix GROUP BY 1",
    "f29_focal_loss": f"WITH {PIX} SELECT l_linestatus, round({FOCAL}, 6) AS focal FROM val GROUP BY 1",
    "f30_dice_loss": f"{SUMS} SELECT round({TVERSKY.format(a=0.5, b=0.5, e=0.5)}, 6) AS dice FROM s",
    "f31_tversky_loss": f"{SUMS} SELECT round({TVERSKY.format(a=0.7, b=0.3, e=1.0)}, 6) AS tversky FROM s",
    "f32_compound_loss": f"{SUMS} SELECT round((SELECT {FOCAL} FROM val) + (SELECT {TVERSKY.format(a=0.5, b=0.5, e=0.5)} FROM s), 6) AS compound",
    "f33_class_weights": f"WITH {PIX}, c AS (SELECT l_linestatus, count(*) FILTER (label = 0) / count(*) FILTER (label = 1) AS r FROM pix GROUP BY 1) SELECT l_linestatus, round(r, 6) AS linear, round(sqrt(r), 6) AS sqrt, round(ln(1 + r), 6) AS log FROM c",
    "f37_scaled_confusion": f"WITH {PIX}, c AS (SELECT {COUNTS} FROM val), k AS (SELECT *, least(1.0::DOUBLE, 1.0::DOUBLE * (tp + fn) / greatest(fp + tn, 1)) AS k FROM c) SELECT tp, fn, round_even(fp * k, 0)::BIGINT AS fp, round_even(tn * k, 0)::BIGINT AS tn FROM k",
}


def ratio_sql(r: int, digits: int = 6) -> str:
    """Average precision at one ratio: the first negatives in hash order, or as many draws with replacement."""
    return f"""SELECT {r} AS ratio, (SELECT round(sum(pos / allp * (tp / (tp + fp))), {digits}) FROM (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS allp
      FROM (SELECT score, coalesce(sum(w) FILTER (label = 1), 0)::DOUBLE AS pos, coalesce(sum(w) FILTER (label <> 1), 0)::DOUBLE AS neg FROM val JOIN (
        SELECT tile_id, 1 AS w FROM t WHERE is_pos UNION ALL
        SELECT tile_id, 1 FROM neg, k WHERE k.p * {r} <= k.n AND h <= k.p * {r} UNION ALL
        SELECT tile_id, d.w FROM neg, k, (SELECT ('0x' || substr(md5(range || '|42'), 1, 12))::BIGINT % (SELECT greatest(n, 1) FROM k) AS i, count(*) AS w FROM range((SELECT p * {r} FROM k)) GROUP BY 1) d WHERE k.p * {r} > k.n AND d.i = neg.i) USING (tile_id) GROUP BY 1))) AS ap,
      (p * {r})::BIGINT AS n_neg, p * {r} > n AS bootstrapped FROM k"""


#: Tiles of a table t(tile_id, is_pos): their counts, and the negatives in hash order and by id.
DRAWS = """k AS (SELECT count(*) FILTER (is_pos) AS p, count(*) FILTER (NOT is_pos) AS n FROM t),
  neg AS (SELECT tile_id, row_number() OVER (ORDER BY md5(tile_id::VARCHAR || '|42'), tile_id) AS h, row_number() OVER (ORDER BY tile_id) - 1 AS i FROM t WHERE NOT is_pos)"""
SQL["m03_ap_at_ratios"] = f"WITH {PIX}, t AS (SELECT tile_id, bool_or(label = 1) AS is_pos FROM pix GROUP BY 1), {DRAWS} " + " UNION ALL ".join(map(ratio_sql, (1, 5, 20)))
