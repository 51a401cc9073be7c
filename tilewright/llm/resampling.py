"""Importance resampling towards a target: bucket gains as one array, Gumbel keys, and the k best of them by distributed quickselect.

A text's features are its runs of 1 to N_GRAM words; a feature's bucket is a checksum modulo BUCKETS. How often each bucket occurs in
the documents and in the target is counted by every task first, so that at most BUCKETS rows of each are dealt out; from these two arrays
comes the gain of each bucket, an array that goes to all tasks. A document's weight is the floored mean of its features' gains, and its
score the weight plus Gumbel noise from a hash of its id: the highest scores are a draw without replacement by weight.

The draw is a selection, not a sort of all rows. Keys are composite and unique: (score descending, id, features, row). Each round
PIVOTS random keys of those still in question become pivots; one pass counts exactly the rows before, at and after each of them, and the
interval that holds the k-th key remains, written down for the next round. So a round leaves about a PIVOTS-th of the rows. The rows
up to the k-th key alone are sorted, by ranges with their counts summed, and ranked.

Defined results: null and empty texts have no features, weight 0 and are never drawn. A null id is hashed as the empty text and comes last among
equal scores. Repeated rows are documents of their own, with equal scores; which of two equal rows has the lesser rank is arbitrary. A
document without features in an empty corpus or with an empty target has what the formula gives with counts of 0. Columns in `keep` are
carried along under any name but those of the outputs, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common

N_GRAM, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
PIVOTS = 15
RANGE_ROWS = 1_000_000  # of the winners that one task sorts
MAX_RANGES = 4096
PIECE = 4 << 20  # bytes of a text that are split at once
MAX_CACHE = 300_000
OUTPUTS = ("n_features", "weight", "score", "rank")
#: A-Z lower-cased, other ASCII but digits and letters to spaces, all else as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Buckets(dict):
    """Feature to bucket; forgets all when it holds too many."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > MAX_CACHE:
            self.clear()
        self[feature] = k = crc32(feature) % self.n
        return k

    def of(self, text: bytes | None, n_gram: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of features) of the text, piece by piece; runs across pieces belong to the later one."""
        flat, start, before = (text or b"").translate(FOLD), 0, []
        while start < len(flat):
            end = flat.find(b" ", start + PIECE)
            end = len(flat) if end < 0 else end
            words = flat[start:end].split()
            found = [*map(self.__getitem__, words)]
            both = before + words
            for n in range(2, n_gram + 1):
                found += [self[b" ".join(both[i : i + n])] for i in range(max(0, len(before) - n + 1), len(both) - n + 1)]
            before = both[len(both) - n_gram + 1 :] if n_gram > 1 else []
            yield len(words), np.array(found, np.int64)
            start = end


def counts(df: DataFrame, n_gram: int = N_GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts of df (text) in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = np.zeros(buckets, np.int64), Buckets(buckets)
        for b in common.chunks(batches):
            for text in common.as_bytes(b.column(0)):
                for _, found in known.of(text, n_gram):
                    n += np.bincount(found, minlength=buckets)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], names=["bucket", "n"])

    rows = df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as there are buckets at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighted(df: DataFrame, gain: np.ndarray, n_gram: int = N_GRAM) -> DataFrame:
    """(row, text) as (row, n_words, n_features, weight): an Arrow pass without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        known = Buckets(len(gain))
        for b in common.chunks(batches):
            words, features, sums = np.zeros((3, b.num_rows), np.int64)
            for k, text in enumerate(common.as_bytes(b.column(1))):
                for n, found in known.of(text, n_gram):
                    words[k] += n
                    features[k] += len(found)
                    sums[k] += gain[found].sum()
            columns = [pa.array(x) for x in (words, features, sums // np.maximum(features, 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["row", "n_words", "n_features", "weight"])

    return df.mapInArrow(run, T.StructType([df.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of an id, from the first 32 bits of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


#: Columns of the composite key, all ascending. No two rows have the same key.
KEY = ("_score", "_null", "_id", "_n", "_u")


def _key(score: Column, doc_id: Column, n: Column) -> list[Column]:
    plain = F.coalesce(doc_id, F.lit(0))
    return [(-score).alias("_score"), doc_id.isNull().cast("int").alias("_null"), plain.alias("_id"), n.alias("_n"), F.monotonically_increasing_id().alias("_u")]


def _at(key: Sequence) -> Column:
    return F.struct(*(F.lit(v).cast("int" if c == "_null" else "long").alias(c) for c, v in zip(KEY, key, strict=True)))


def before(at: Sequence, equal: bool) -> Column:
    """Whether a row's key comes before a given one, or equals it; the first column also by itself, as that reaches the scan."""
    key = F.struct(*KEY)
    return (F.col(KEY[0]) <= at[0]) & ((key <= _at(at)) if equal else (key < _at(at)))


def select(rows: DataFrame, k: int, stages: common.Stages, pivots: int = PIVOTS) -> tuple | None:
    """The k-th key (from 1) of written rows with KEY, or None if there are fewer; three-way counts around random pivots."""
    n, active = rows.count(), rows
    if not 1 <= k <= n:
        return None
    for seed in range(10_000):
        drawn = active.select(*KEY).orderBy(F.xxhash64("_u", F.lit(seed)), "_u").limit(pivots)
        at = sorted(tuple(r) for r in drawn.collect())
        # 2i: before the i-th pivot and after the one before it; 2i + 1: the pivot itself
        key = F.struct(*KEY)
        place = sum((F.when(key > _at(p), 2).when(key == _at(p), 1).otherwise(0) for p in at), F.lit(0))
        sizes = {r.place: r.n for r in active.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
        for p in range(2 * len(at) + 1):
            if k <= sizes.get(p, 0):
                break
            k -= sizes.get(p, 0)
        if p % 2:
            if active is not rows:
                stages.drop(active)
            return at[p // 2]
        lo, hi = p // 2 - 1, p // 2
        inside = active.select(*KEY)
        if lo >= 0:
            inside = inside.filter(~before(at[lo], True) & (F.col(KEY[0]) >= at[lo][0]))
        if hi < len(at):
            inside = inside.filter(before(at[hi], False))
        old, active = active, stages.put(inside)
        if old is not rows:
            stages.drop(old)
    raise RuntimeError("no pivot was the key that is sought")


def numbered(rows: DataFrame, n: int, stages: common.Stages) -> DataFrame:
    """rows with rank 1, 2, 3, ... in the order of KEY: ranges are sorted each by itself and start after those before them."""
    parts = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    cut = stages.put(rows.repartitionByRange(parts, *KEY).withColumn("_part", F.spark_partition_id()))
    start, total = {}, 0
    for r in sorted(cut.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):
        start[r["_part"]], total = total, total + r.n
    offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for p in start.items() for x in p)), F.col("_part").cast("long")) if start else F.lit(0)
    return cut.withColumn("rank", F.row_number().over(W.partitionBy("_part").orderBy(*KEY)) + offset)


def resample(
    docs: DataFrame, target: DataFrame, stages: common.Stages, keep: Sequence[str] | None = None, n_gram: int = N_GRAM, buckets: int = BUCKETS,
    seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """The columns in keep (all) with n_features, weight, score and rank, which is null for what isn't drawn. docs: (doc_id, text,
    ...); target: (text). The draw is floor(percent * N / 100) of the N documents with at least `least` words."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUTS]
    gain = gains(counts(docs, n_gram, buckets), counts(target, n_gram, buckets))
    packed = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")).alias("row"), F.col("text").cast("string").alias("text"))
    rows = weighted(packed, gain, n_gram).withColumn("score", F.col("weight") + noise(F.col("row.id"), seed))
    rows = stages.put(rows.select("row.kept", "n_words", "n_features", "weight", "score", *_key(F.col("score"), F.col("row.id"), F.col("n_features"))))
    able = rows.filter(F.col("n_words") >= least)
    k = percent * able.count() // 100
    out = ["kept.*", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long")
    if not k:
        return rows.withColumn("rank", none).select(*out)
    last = select(stages.put(able.select(*KEY)), k, stages)
    won = (F.col("n_words") >= least) & before(last, True)
    winners = numbered(rows.filter(won), k, stages).withColumn("rank", F.col("rank").cast("long"))
    return winners.select(*out).unionByName(rows.filter(~won).withColumn("rank", none).select(*out))


def op13_importance_quickselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return resample(docs, target, common.Stages(spark, "op13"), keep=["doc_id"])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The checksum of a word from its bytes, by a table of 256 that is itself made by rule.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, octet_length(encode(w)) + 1), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i - 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i, 1)) - 17)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"""
QUERIES = {"op13_importance_quickselect": op13_importance_quickselect}
SQL: dict[str, str] = {
    "op13_importance_quickselect": f"""WITH tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n::UBIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(n))),
d AS (SELECT row_number() OVER () AS u, doc_id, {_WORDS} AS words FROM documents),
dw AS (SELECT u, unnest(words) AS w FROM d), bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
bucket AS (SELECT w, ({_CRC} % {BUCKETS})::BIGINT AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), tab),
s AS (SELECT b, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY b), g AS (SELECT b, count(*) AS n FROM bw JOIN bucket USING (w) GROUP BY b),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS}) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN g USING (b)),
sums AS (SELECT u, sum(gain)::BIGINT AS total FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY u),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE floor(total / len(words))::BIGINT END AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN sums USING (u)),
placed AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= {LEAST_WORDS} AS able FROM scored),
ranks AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= {PERCENT} * (SELECT count(*) FROM placed WHERE able) // 100 THEN r END AS rank FROM ranks""",
}
