"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over text statistics give paths; each path is a conjunctive rule. A logistic model with lasso
penalty over the rules keeps few of them, and the kept ones compile into one Spark column expression over the statistics.

Labels are learned only from rows outside the held-out fifth, at most MAX_TRAIN of them, chosen by a hash of the id
(the bound of the fit). Every row is scored. Inputs of a score are statistics of the whole text and nothing else.

Defined results: a null text counts as the empty text and is scored like one; several labels of an id count as their
greatest, null labels are left out; without labels the score is 0.5 everywhere, with labels of one kind their smoothed
share. Repeated rows are scored alike; an empty table gives an empty result. Columns named like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS = 30, 3, 32
LASSO = 0.002
NAMES = (
    "n_words", "word_bytes", "distinct_share", "repeat_share", "upper_share", "symbol_share", "digit_share", "bar_share",
    "bang_share", "line_words", "line_repeat_share", "packed_share", "space_share", "wide_share", "stop_share",
)
UPPER, LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS, SPACES = b"0123456789", b" \t\n\r\x0b\x0c"
SYMBOLS = bytes(c for c in range(33, 127) if c not in LETTERS and c not in DIGITS and c not in b".,'-")
WIDE = bytes(range(128, 256))
FEATURE_TYPE = ", ".join(f"{n} double" for n in NAMES)


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics NAMES of a whole text."""
    n, words = len(text), text.split()
    count = lambda chars: n - len(text.translate(None, chars))
    w, letters, upper, symbols = len(words), count(LETTERS), count(UPPER), count(SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct, repeats = len(set(words)), sum(map(bytes.__eq__, words, words[1:]))
    one, k = 1 / max(n, 1), max(w, 1)
    return (
        float(np.log1p(w)), min(sum(map(len, words)) / k, 1e3), distinct / k, repeats / k, upper / max(letters, 1), symbols * one, count(DIGITS) * one,
        count(b"|") * one, count(b"!") * one, float(np.log1p(w / max(len(lines), 1))), 1 - len(set(lines)) / max(len(lines), 1),
        min(len(zlib.compress(text, 1)) * one, 2.0), count(SPACES) * one, count(WIDE) * one, count(b".,") / k,
    )


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the statistics; one Arrow pass, no shuffle."""
    keep = [c for c in df.columns if c != text and c not in NAMES]
    own = common.unused("__text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, own):
            values = np.array([statistics(t or b"") for t in common.as_bytes(b.column(len(keep)))], np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v) for v in values.T)], names=[*keep, *NAMES])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(own)).mapInArrow(run, ", ".join([*fields, FEATURE_TYPE]))


Rule = tuple[tuple[int, bool, float], ...]  # of (statistic, above, cut)


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    offset: float = 0.0  # moves the calibrated cut to the threshold in use

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + self.offset + fires(self.rules, x) @ np.array(self.weights) if self.rules else np.full(len(x), self.intercept + self.offset)

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(float(self.intercept + self.offset))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = reduce(Column.__and__, [(F.col(NAMES[j]) > cut) if above else (F.col(NAMES[j]) <= cut) for j, above, cut in rule])
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))


def fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, cut in rule:
            out[:, k] *= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: Rule, least: int, rules: set[Rule], step: np.ndarray) -> None:
    """A tree over binned values by second-order gain; every node but the root gives a rule."""
    if path:
        rules.add(path)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        g, h = grad[rows], hess[rows]
        score = lambda a, b: a * a / (b + 1.0)
        for j, c in enumerate(cuts):
            if len(c):
                b = codes[rows, j]
                gs, hs, ns = (np.bincount(b, w, len(c) + 1).cumsum()[:-1] for w in (g, h, np.ones(len(rows))))
                gain = np.where((ns >= least) & (len(rows) - ns >= least), score(gs, hs) + score(g.sum() - gs, h.sum() - hs) - score(g.sum(), h.sum()), -1)
                if gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
    if best[1] is None:
        step[rows] = grad[rows].sum() / (hess[rows].sum() + 1.0)
        return
    j, k = best[1]
    for above in (False, True):
        grow(x, codes, cuts, grad, hess, rows[(codes[rows, j] > k) == above], depth - 1, tuple(sorted({*path, (j, above, float(cuts[j][k]))})), least, rules, step)


def lasso(f: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient; the intercept isn't penalised."""
    f1 = np.hstack([np.ones((len(f), 1)), f])
    rate = 4 / np.linalg.norm(f1, 2) ** 2 * len(f)
    w = v = np.zeros(f1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f1 @ v, -30, 30)))
        new = v - rate * (f1.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO, threshold: float = THRESHOLD) -> RuleModel:
    """threshold: the score from which a row counts as 1 is moved to where the training rows are best told apart."""
    n, ones = len(y), float(y.sum())
    if not n:
        return RuleModel()
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return RuleModel(prior)
    cuts = []
    for column in x.T:
        values = np.unique(column)
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) <= BINS else np.unique(np.quantile(middles, np.linspace(0, 1, BINS))))
    codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    rules: set[Rule] = set()
    margin, least = np.full(n, prior), max(3, n // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(n)
        grow(x, codes, cuts, y - p, p * (1 - p), np.arange(n), depth, (), least, rules, step)
        margin = margin + 0.3 * step
    order = sorted(rules)
    f = fires(order, x)
    intercept, w = lasso(f, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    model = RuleModel(intercept, [order[i] for i in keep], [float(w[i]) for i in keep])
    m = model.margin(x)
    edges = np.unique(m)
    mids = np.concatenate([(edges[1:] + edges[:-1]) / 2, [0.0]])
    mids = mids if len(mids) <= 2000 else np.quantile(mids, np.linspace(0, 1, 2000))
    right = np.array([((m > c) & (y == 1)).sum() / ones + ((m <= c) & (y == 0)).sum() / (n - ones) for c in mids])
    top = np.flatnonzero(right >= right.max() - 1e-12)
    cut = float(mids[top[len(top) // 2]])
    model.offset = float(np.log(threshold / (1 - threshold))) - cut
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """text and y of the labelled rows outside the held-out fifth, limit at most, in the order of a hash of the id."""
    picked = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # limit rows at most


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> RuleModel:
    rows = with_statistics(training_rows(docs, labels, "quality", limit)).toPandas().sort_values(["doc_id", "y", *NAMES])
    return fit(rows[list(NAMES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score(df: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df's other columns, the statistics, score and predicted."""
    out = with_statistics(df.drop("score", "predicted"), text).withColumn("score", model.column())
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
