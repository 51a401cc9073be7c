"""Suffix-array dedup of long repeated byte strings by bucket-pointer refinement.

The suffixes that share their first SPAN = 400 bytes with another one are those whose buckets still hold several members when the
array is refined to depth 400. A suffix's bucket at depth 2h is the pair of its bucket at h and the bucket of the suffix
h later; the identifiers are 64-bit mixtures of such pairs, so doubling needs no sort and the pointers of later offsets are reused
at every depth. Only what stays in a bucket with others is refined further, in three rounds of the same step over ever finer pieces of
neighbouring suffixes:

1. Runs. Initial buckets are q-grams of 200 bytes. Of each 400-byte string only its least q-gram counts (equal strings have
   the same one); the suffixes that share it make a run.
2. Blocks of 32 suffixes at fixed distances from that q-gram. Their bucket is the string that all suffixes of the block
   share within their first 400 bytes.
3. Single suffixes, with their first 400 bytes as bucket.

A step sorts pieces into buckets and, within them, by the pointers at the later offsets that cover all of the piece's
bytes. A bucket with one place is finished: none of its suffixes is repeated. Pieces that agree in all pointers are
repeated as a whole. Of a bucket with different pieces one of each kind goes on to the next round.

Equal texts form a class that takes part once; a class with several members of at least 400 bytes is repeated as a whole.

A passage of many short words may be shorter than 400 bytes. So the same refinement runs over words too, A-Z lower-cased: its q-grams
are GRAM words long, its depth is PASSAGE = 51 words, and runs go to single suffixes at once. It removes nothing; it marks the
documents of which over 50 words in a row stand in another document as well.

Defined results: a null text is the empty text; texts under 400 bytes keep all bytes; rows that repeat, and rows with
null ids, are documents of their own, so a repeated row of at least 400 bytes loses all bytes in each. Empty tables give
empty results. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN, Q, DEEP = 400, 200, 256
TABLE = np.random.default_rng(4).integers(0, 1 << 64, 256, np.uint64)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
GROUP = 1 << 17  # bytes that are refined together
PIECE = 1 << 20  # suffixes of a text that are refined together
PASSAGE, GRAM = 51, 20  # words
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
ODD = 0x9E3779B97F4A7C15
POWER = np.append(np.uint64(1), np.cumprod(np.full((1 << 18) - 1, ODD, np.uint64)))
INVERSE = np.append(np.uint64(1), np.cumprod(np.full((1 << 18) - 1, pow(ODD, -1, 1 << 64), np.uint64)))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of (bucket, bucket at the later offset)."""
    h = a * M1
    h += b
    h ^= h >> np.uint64(32)
    h *= M2
    h ^= h >> np.uint64(29)
    return h


def refine(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets at depth Q and at depth DEEP of every suffix that is long enough."""
    b = TABLE[text]
    for h in (1, 2, 4, 8, 16, 32, 64):
        b = pair(b[:-h], b[h:])
    return pair(b[: -(Q - 128)], b[Q - 128 :]), pair(b[:-128], b[128:])


def least_bucket(q: np.ndarray) -> np.ndarray:
    """The least q-gram bucket within each string of SPAN bytes."""
    n = SPAN - Q + 1
    m, h = q, 1
    while 2 * h <= n:
        m = np.minimum(m[:-h], m[h:])
        h *= 2
    return np.minimum(m[: len(m) - (n - h)], m[n - h :])


def runs(text: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """(bucket, pointers, first, last) of the runs in texts that are laid end to end; first and last count in text, last included."""
    q, deep = refine(text)
    m = least_bucket(q)
    valid = np.ones(len(m), bool)
    for e in ends[:-1]:
        valid[max(0, e - SPAN + 1) : e] = False
    at = np.flatnonzero(valid)
    new = np.ones(len(at), bool)
    # a run has one least q-gram: the next suffix starts a run if its predecessor began with it
    new[1:] = (m[at[1:]] != m[at[:-1]]) | (q[at[:-1]] == m[at[:-1]]) | (np.diff(at) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    x, y = at[first], at[last]
    end = y + SPAN - DEEP
    middle = (x + end) // 2
    pointers = pair(pair(deep[x], deep[middle]), deep[end] + (y - x).astype(np.uint64))
    return m[x], pointers, x, y


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[int], np.ndarray]]:
    """Groups of (number of the text, offset, end in the group) and their bytes. Long texts come in pieces that overlap, so that
    each suffix is in one piece with SPAN bytes."""
    number, offset, ends, parts, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(0, len(t) - SPAN + 1), PIECE):
            p = t[s : s + PIECE + SPAN - 1]
            if size and size + len(p) > GROUP:
                yield number, offset, ends, np.frombuffer(b"".join(parts), np.uint8)
                number, offset, ends, parts, size = [], [], [], [], 0
            number.append(i), offset.append(s), parts.append(p)
            size += len(p)
            ends.append(size)
    if size:
        yield number, offset, ends, np.frombuffer(b"".join(parts), np.uint8)



def batch_of(c1: np.ndarray, c2: np.ndarray, bucket: np.ndarray, pointers: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    i64 = lambda a: pa.array(np.ascontiguousarray(a).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), i64(bucket), i64(pointers), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], names=NAMES)


PIECES = "c1 long, c2 long, bucket long, pointers long, x int, y int"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
SUFFIXES = 32  # of a block


def all_runs(docs: DataFrame) -> DataFrame:
    """The runs of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            texts = [t or b"" for t in common.as_bytes(b.column(2))]
            c1, c2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for number, offset, ends, text in pieces(texts):
                bucket, pointers, x, y = runs(text, np.array(ends))
                which = np.searchsorted(ends, x, side="right")
                shift = (np.array(offset) - np.append(0, ends[:-1]))[which]
                doc = np.array(number)[which]
                x, y = x + shift, y + shift
                yield batch_of(c1[doc], c2[doc], bucket, pointers, x, y)

    return docs.filter(F.octet_length("text") >= SPAN).select("c1", "c2", "text").mapInArrow(run, PIECES)


def blocks(text: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, pointers, first, last) of the blocks that hold the runs (x, y) of a text."""
    q, deep = refine(text)
    n = len(text) - SPAN  # the last suffix
    anchor = np.array([b + int(q[b : a + SPAN - Q + 1].argmin()) for a, b in zip(x, y, strict=True)])
    near, far = (anchor - y) // SUFFIXES, (anchor - x) // SUFFIXES
    count = far - near + 1
    which = np.repeat(np.arange(len(x)), count)
    j = near[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    last = anchor[which] - SUFFIXES * j
    first = last - SUFFIXES + 1
    size = SPAN - SUFFIXES + 1  # bytes that the suffixes of a block share
    bucket = pair(deep[last], deep[last + size - DEEP] + j.astype(np.uint64))
    f, e = np.maximum(first, 0), np.minimum(last, n)  # at an end of the text a block has fewer suffixes, and equals such blocks only
    pointers = pair(deep[f], deep[e + SPAN - DEEP] + ((f - first) * SUFFIXES + (e - f)).astype(np.uint64))
    return bucket, pointers, f, e


def single(text: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of each suffix of the blocks (x, y)."""
    deep = refine(text)[1]
    at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(x, y, strict=True)]))
    return deep[at], deep[at + SPAN - DEEP], at, at


def parts(lists: pa.ListArray) -> list[pa.Array]:
    """The list of each row, as long as it may be, without an object for each entry."""
    values, at = lists.flatten(), np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return [values.slice(a, z - a) for a, z in zip(at, at[1:], strict=False)]


def finer(texts: DataFrame, split: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """texts: c1, c2, text and todo, a list of pieces (x, y) of it. The finer pieces, as PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            todo = parts(b.column(3))
            for i, text in enumerate(common.as_bytes(b.column(2))):
                c1, c2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                t = todo[i]
                x, y = np.unique(np.stack([t.field(k).to_numpy() for k in (0, 1)], 1), axis=0).T
                data, at = np.frombuffer(text, np.uint8), 0
                while at < len(x):  # in parts of a long text, with all bytes around that a piece may need
                    to = max(at + 1, int(np.searchsorted(x, x[at] + PIECE)))
                    lo, hi = max(0, int(x[at]) - SPAN), int(y[at:to].max()) + 3 * SPAN
                    bucket, pointers, f, e = split(data[lo:hi], x[at:to] - lo, y[at:to] - lo)
                    n = len(f)
                    yield batch_of(np.full(n, c1), np.full(n, c2), bucket, pointers, f + lo, e + lo)
                    at = to

    return texts.select("c1", "c2", "text", "todo").mapInArrow(run, PIECES)


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where it starts; in parts that end between words."""
    gap = np.flatnonzero(SPACE[text])
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        to = len(text)
        if to - at > GROUP:
            k = int(np.searchsorted(gap, at + GROUP, side="right"))
            to = int(gap[k - 1]) + 1 if k and gap[k - 1] >= at else int(gap[k]) + 1 if k < len(gap) else to
        part = text[at:to]
        black = ~SPACE[part]
        s = np.flatnonzero(black & ~np.append(False, black[:-1]))
        e = np.flatnonzero(black & ~np.append(black[1:], False))
        long = e - s + 1 >= GROUP  # such a word fills a part
        h = np.zeros(len(s), np.uint64)
        if not long.all():
            v = TABLE[FOLD[part]] * POWER[: to - at]
            total = np.cumsum(v)
            h = (total[e] - total[s] + v[s]) * INVERSE[s]
        for i in np.flatnonzero(long):
            h[i] = hash64(FOLD[part[s[i] : e[i] + 1]].tobytes())
        hashes.append(pair(h, (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = to
    return np.concatenate(hashes), np.concatenate(starts)


def hash64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets at a depth of n words of every suffix that is long enough."""
    size = 1
    while 2 * size <= n:
        h, size = pair(h[:-size], h[size:]), 2 * size
    return pair(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


WORD_RUNS = "c1 long, bucket long, x int, y int"


def word_runs(docs: DataFrame) -> DataFrame:
    """The runs of suffixes with one least q-gram of words, of every text of PASSAGE words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            texts, c1 = [t or b"" for t in common.as_bytes(b.column(1))], b.column(0).to_numpy(zero_copy_only=False)
            group, size = [], 0
            for i, t in enumerate([*texts, None]):
                if group and (t is None or size + len(t) > GROUP):
                    ends = np.cumsum([len(texts[k]) + 1 for k in group])
                    h, at = words_of(np.frombuffer(b" ".join(texts[k] for k in group), np.uint8))
                    doc = np.searchsorted(ends, at, side="right")
                    first = np.searchsorted(doc, np.arange(len(group)))
                    if len(h) >= PASSAGE:
                        yield _word_runs(h, doc, first, c1[group])
                    group, size = [], 0
                if t is not None:
                    group.append(i)
                    size += len(t)

    return docs.filter(F.octet_length("text") > 2 * (PASSAGE - 1)).select("c1", "text").mapInArrow(run, WORD_RUNS)


def _word_runs(h: np.ndarray, doc: np.ndarray, first: np.ndarray, c1: np.ndarray) -> pa.RecordBatch:
    q, n = grams(h, GRAM), PASSAGE - GRAM + 1
    m, k = q, 1
    while 2 * k <= n:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    m = np.minimum(m[: len(m) - (n - k)], m[n - k :])
    at = np.flatnonzero(doc[: len(m)] == doc[PASSAGE - 1 : PASSAGE - 1 + len(m)])
    new = np.ones(len(at), bool)
    new[1:] = (m[at[1:]] != m[at[:-1]]) | (q[at[:-1]] == m[at[:-1]]) | (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])
    x = at[np.flatnonzero(new)]
    y = at[np.append(np.flatnonzero(new)[1:], len(at))[: len(x)] - 1]
    own = doc[x]
    return pa.RecordBatch.from_arrays([pa.array(c1[own]), pa.array(m[x].view(np.int64)), pa.array((x - first[own]).astype(np.int32)), pa.array((y - first[own]).astype(np.int32))], names=["c1", "bucket", "x", "y"])


def shared_passages(docs: DataFrame, classes: DataFrame, stages: common.Stages) -> DataFrame:
    """(c1, c2) of the classes that share PASSAGE words in a row with another document. docs: c1, c2, rep, text; classes: c1, c2, rep, c."""

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            todo = parts(b.column(2))
            for i, text in enumerate(common.as_bytes(b.column(1))):
                deep = grams(words_of(np.frombuffer(text, np.uint8))[0], PASSAGE)
                x, y = (todo[i].field(k).to_numpy() for k in (0, 1))
                n = y - x + 1
                at = np.unique(np.repeat(x - np.cumsum(n) + n, n) + np.arange(n.sum()))
                found = np.unique(deep[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b.column(0)[i].as_py())), pa.array(found.view(np.int64))], names=["c1", "bucket"])

    def of_several(rows: DataFrame) -> DataFrame:
        """The rows in buckets with several texts; what is joined is written, so that a hot bucket can be split."""
        shared = rows.groupBy("bucket").agg(F.min("c1").alias("a"), F.max("c1").alias("z")).filter("a != z").select("bucket")
        return rows.join(stages.put(shared), "bucket")

    runs_ = stages.put(word_runs(docs.select("c1", "text")))
    todo = of_several(runs_).groupBy("c1").agg(F.collect_list(F.struct("x", "y")).alias("todo"))
    copies = stages.put(classes.filter("c > 1").select("c1", "c2").join(runs_, "c1", "left_semi"))
    texts = texts_of(docs, stages.put(todo.join(classes, "c1").select("c1", "c2", "rep", "todo")))
    found = stages.put(texts.select("c1", "text", "todo").mapInArrow(singles, "c1 long, bucket long"))
    alike = of_several(found).select("c1").distinct().join(classes, "c1").select("c1", "c2")
    return alike.union(copies).distinct()


def spans(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered runs of starts and ends; runs that touch are one."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.append(True, s[1:] > e[:-1])
    first = np.flatnonzero(new)
    return list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist(), strict=True))


CUT = "c1 long, c2 long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"


def cut(texts: DataFrame, with_bytes: bool) -> DataFrame:
    """texts: c1, c2, text, starts and ends of covered strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches):
            rows, starts, ends = [], parts(b.column(3)), parts(b.column(4))
            for i, text in enumerate(common.as_bytes(b.column(2))):
                c1, c2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                found = spans(starts[i].to_numpy(), ends[i].to_numpy())
                kept = b"".join(text[a:z] for a, z in zip([0, *(f[1] for f in found)], [*(f[0] for f in found), len(text)], strict=True))
                rows.append((c1, c2, len(text) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None, [{"start": s, "end": e} for s, e in found] if with_bytes else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["c1", "c2", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return texts.select("c1", "c2", "text", "starts", "ends").mapInArrow(run, CUT)


def step(pieces: DataFrame, stages: common.Stages) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of written pieces: those in buckets with several places; the strings repeated as a whole; and (c1, c2, todo), what goes on."""
    pieces = pieces.withColumn("place", F.xxhash64("c1", "c2", "x"))
    buckets = pieces.groupBy("bucket").agg(F.min("place").alias("p1"), F.max("place").alias("p2"), F.min("pointers").alias("r1"), F.max("pointers").alias("r2")).filter("p1 != p2")
    # what is joined by bucket is written before, so that the join with a bucket of very many pieces can be split
    buckets = stages.put(buckets.select("bucket", (F.col("r1") != F.col("r2")).alias("mixed")))
    left = stages.put(pieces.join(buckets, "bucket"))
    stages.drop(buckets)
    mixed = left.filter("mixed")
    kinds = mixed.groupBy("bucket", "pointers").agg(F.min(F.struct("place", "c1", "c2", "x", "y")).alias("one"), F.max("place").alias("p2"))
    kinds = stages.put(kinds.select("bucket", "pointers", "one", (F.col("one.place") != F.col("p2")).alias("whole")))
    columns = ["c1", "c2", F.col("x").alias("s"), (F.col("y") + SPAN).alias("e")]
    whole = left.filter("not mixed").select(*columns).union(mixed.join(kinds.filter("whole").select("bucket", "pointers"), ["bucket", "pointers"]).select(*columns))
    # buckets whose pieces are all of repeated kinds need nothing more
    open_ = stages.put(kinds.groupBy("bucket").agg(F.every("whole").alias("done")).filter("not done").select("bucket"))
    todo = kinds.join(open_, "bucket").groupBy("one.c1", "one.c2").agg(F.collect_list(F.struct("one.x", "one.y")).alias("todo"))
    return left, whole, todo


def remove_repeats(docs: DataFrame, stages: common.Stages, with_bytes: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and shortened; with_bytes: also kept and spans.

    shortened: whether any byte is removed, which n_bytes, the length before, doesn't show. shared: whether over 50 words in a row
    stand in another document too, however few bytes these are.
    """
    before = set(stages.live)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", "text", *content_key(F.col("text")), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rep"))
    rows = stages.put(docs.select("doc_id", "rep", "c1", "c2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    own = ["c1", "c2"]
    classes = stages.put(rows.filter(F.col("n_bytes") > 2 * (PASSAGE - 1)).groupBy(*own).agg(F.min("rep").alias("rep"), F.count("*").alias("c"), F.max("n_bytes").alias("n")))
    shared = stages.put(shared_passages(docs, classes, stages).withColumn("shared", F.lit(True)))
    stages.clear(rows, classes, shared, before=before)
    pieces = stages.put(all_runs(docs))
    left, whole, todo = step(pieces, stages)
    stages.drop(pieces)
    # texts are dealt out once: those of one row of each class that has a repeated q-gram
    texts = stages.put(texts_of(docs, left.select(*own).distinct().join(classes, own)))
    covered = [whole]
    for split in (blocks, single):
        finer_pieces = stages.put(finer(texts.join(todo, own), split))
        left, whole, todo = step(finer_pieces, stages)
        stages.drop(finer_pieces)
        covered.append(whole)
    # a class with several members goes as a whole, so its own pieces don't matter
    alone = reduce(DataFrame.union, covered).distinct().join(classes.filter("c = 1"), own, "left_semi")
    alone = alone.groupBy(*own).agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends"))
    done = stages.put(cut(texts.join(alone, own), with_bytes))
    stages.clear(rows, done, classes, shared, before=before)
    out = rows.join(done, own, "left").join(classes.filter((F.col("c") > 1) & (F.col("n") >= SPAN)).select(*own, F.lit(True).alias("gone")), own, "left").join(shared, own, "left")
    none = hashlib.sha256(b"").hexdigest()
    result = ["doc_id", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(F.col("gone"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(F.col("gone"), none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")]
    result.append(F.coalesce("shared", F.lit(False)).alias("shared"))
    return out.select(*result, *(["kept", "spans"] if with_bytes else [])).withColumn("shortened", F.col("n_removed") > 0)


def content_key(text) -> tuple:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(5), text).alias("c2")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (c1, c2, rep, ...) with the text of each class, read from one of its rows with the least id."""
    key = ["c1", "c2", "rep"]  # dropDuplicates() then needs no further shuffle
    return docs.select(*key, "text").join(wanted.drop("c"), key).dropDuplicates(key)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), common.Stages(spark, "op4"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
SQL = {"op4_suffix_dedup": f"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
  p AS (SELECT doc_id, h, unnest(range(0, n - {SPAN - 1})) AS p FROM h WHERE n >= {SPAN}),
  k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * SPAN})) AS k FROM p),
  r AS (SELECT doc_id, p FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
  f AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {SPAN} THEN 0 ELSE 1 END AS f FROM r),
  g AS (SELECT doc_id, p, sum(f) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM f),
  s AS (SELECT doc_id, min(p) AS s, max(p) + {SPAN} AS e FROM g GROUP BY doc_id, g),
  t AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM s),
  c AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept, max(e) AS e FROM t JOIN h USING (doc_id) GROUP BY 1),
  w AS (SELECT doc_id, {common.SQL_WORDS} AS w FROM documents),
  q AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + {PASSAGE}], ' ')) AS q FROM (SELECT doc_id, w, unnest(range(0, len(w) - {PASSAGE - 1})) AS i FROM w WHERE len(w) >= {PASSAGE})),
  z AS (SELECT DISTINCT doc_id FROM q WHERE q IN (SELECT q FROM q GROUP BY q HAVING count(*) > 1))
  SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substr(h.h, 2 * e + 1), h.h))) AS kept_sha256, z.doc_id IS NOT NULL AS shared, coalesce(n_removed, 0) > 0 AS shortened
  FROM h LEFT JOIN c USING (doc_id) LEFT JOIN z ON z.doc_id = h.doc_id"""}
