"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of three hashed embeddings (the word, its first four and first three characters). Filters of several
widths run over the words, each filter keeps its greatest response over the whole text, and a logistic layer scores
those. Cuts are calibrated by language on rows that the training leaves out; the language is guessed from the text's own
function words, never from a column, and the cut of a language is moved to 0.5.

Labels are learned only from rows outside the held-out fifth, from all of them: a fifth of these makes the cuts, the others the first
counts and the weights. Rows are dealt to blocks by a hash of the id; every epoch starts at all blocks from the same weights and
ends with the mean of what the blocks changed, so the driver holds one model whatever the number of rows. Sums are of integers:
the model doesn't depend on the division of the input. Fit and scoring read whole texts, block by block.

Defined results: a null text is the empty text, whose score comes from no response at all; several labels of an id count
as their greatest, null labels are left out; without labels of both kinds the score is the smoothed share of ones (0.5
without labels). Equal texts score alike; an empty table gives an empty result. Columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

THRESHOLD = 0.5
SLOTS, DIM, WIDTHS, FILTERS, EPOCHS, BATCH, RATE = 1 << 15, 16, (1, 2, 3), 16, 3, 64, 0.15
#: Labelled rows and their bytes in a block, of which all are learned; most bytes of a block in one row.
BLOCK_ROWS, BLOCK_BYTES, PART_BYTES = 2048, 8 << 20, 32 << 20
PACKED = ("words", "ids", "sizes", "y", "fold")
#: Parts of a unit in which changes are added up; numbers in a piece of a sum, and tasks that merge pieces.
POINT, PIECE, MERGERS = float(1 << 32), 1 << 15, 8
CUT_STEPS, CUT_BINS = 256, 1 << 14
MAX_CACHE = 200_000
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
#: Frequent function words, to guess a text's language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "this", "from"),
    "fr": ("le", "la", "les", "des", "et", "une", "est", "dans", "pour", "du", "qui", "sur", "au"),
    "de": ("der", "die", "und", "das", "von", "zu", "mit", "den", "ist", "dem", "sich", "nicht", "im"),
    "es": ("el", "los", "las", "y", "que", "del", "con", "por", "para", "una", "se", "su", "no"),
}
LANGS = ("other", *FUNCTION_WORDS)
LANG_OF = {w: k for k, v in enumerate(FUNCTION_WORDS.values(), 1) for w in v}


class Vocabulary(dict):
    """Raw word to a number that counts up; rows holds the embedding slots and the language vote of each number."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int, int]] = []

    def __missing__(self, raw: str) -> int:
        w = EDGE.sub("", raw.lower()) or raw[:1]
        slot = lambda s: xxhash.xxh32_intdigest(s) % SLOTS
        self.rows.append((slot("w" + w), slot("4" + w[:4]), slot("3" + w[:3]), LANG_OF.get(w, 0)))
        self[raw] = n = len(self.rows) - 1
        return n

    def ids(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text.split()), np.int64)


@dataclass
class Cnn:
    emb: np.ndarray  # SLOTS x DIM
    conv: list[np.ndarray]  # per width: width x DIM x FILTERS
    out: np.ndarray  # WIDTHS * FILTERS
    bias: float
    cuts: np.ndarray  # of the margin, by language
    prior: float | None = None

    def tables(self, rows: np.ndarray) -> list[list[np.ndarray]]:
        """What each word adds to each filter at each of its places."""
        v = self.emb[rows[:, 0]] + self.emb[rows[:, 1]] + self.emb[rows[:, 2]]
        return [[v @ c[k] for k in range(len(c))] for c in self.conv]

    def margins(self, texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        each = [vocabulary.ids(t) for t in texts]
        return self.margins_of(np.array(vocabulary.rows or [(0, 0, 0, 0)], np.int64), each)

    def margins_of(self, rows: np.ndarray, each: list[np.ndarray]) -> np.ndarray:
        used = np.unique(np.concatenate(each)) if each else np.zeros(0, np.int64)
        local = np.zeros(len(rows), np.int64)
        local[used] = np.arange(len(used))
        tables = self.tables(rows[used])
        votes = rows[:, 3]
        x = np.zeros((len(each), len(self.out)), np.float32)
        langs = np.zeros(len(each), np.int64)
        for i, e in enumerate(each):
            if len(e):
                langs[i] = guess(votes[e])
                x[i] = _one(local[e], tables)
        return x @ self.out + self.bias - self.cuts[langs]


def guess(votes: np.ndarray) -> int:
    """The language with most function words; ties go to the first, none to other."""
    n = np.bincount(votes, minlength=len(LANGS))
    return int(n[1:].argmax()) + 1 if n[1:].any() else 0


BLOCK = 8192


def _one(ids: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Pooled responses of one text, block by block; windows that reach past its end count with the words that they have."""
    out = []
    for parts in tables:
        best = np.zeros(parts[0].shape[1], np.float32)
        for s in range(0, len(ids), BLOCK):
            e = ids[s : s + BLOCK + len(parts) - 1]
            r = parts[0][e[:BLOCK]]
            for k in range(1, len(parts)):
                r[: max(0, len(e) - k)] += parts[k][e[k : k + len(r)]]
            best = np.maximum(best, r.max(0))
        out.append(best)
    return np.concatenate(out)


def _pool(ids: np.ndarray, starts: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For training: greatest responses per text and the place of each, block by block; texts are laid end to end in ids and each
    ends with pads (0), whose table rows are zero."""
    values, places = [], []
    for parts in tables:
        f = np.arange(parts[0].shape[1])
        best, where = np.full((len(starts), len(f)), -np.inf, np.float32), np.zeros((len(starts), len(f)), np.int64)
        for i, (a, z) in enumerate(zip(starts, np.append(starts[1:], len(ids)), strict=True)):
            for s in range(a, z, BLOCK):
                e = min(z, s + BLOCK)
                r = parts[0][ids[s:e]]
                for k in range(1, len(parts)):
                    more = ids[s + k : min(z, e + k)]
                    r[: len(more)] += parts[k][more]
                at = r.argmax(0)
                above = r[at, f] > best[i]
                best[i, above], where[i, above] = r[at, f][above], s + at[above]
        values.append(best)
        places.append(where)
    return np.hstack(values), np.hstack(places)


@dataclass
class Block:
    """Labelled rows in arrays, whole texts."""

    rows: np.ndarray  # of the distinct words, as in Vocabulary
    ids: list[np.ndarray]  # the words of each text
    y: np.ndarray
    fold: np.ndarray  # the rows left to the cuts

    @classmethod
    def of(cls, texts: list[str], y: np.ndarray, fold: np.ndarray) -> Block:
        vocabulary = Vocabulary()
        ids = [vocabulary.ids(t) for t in texts]
        return cls(np.array(vocabulary.rows, np.int64).reshape(-1, 4), ids, y, fold)

    def pack(self) -> list[bytes]:
        sizes, flat = [len(i) for i in self.ids], np.concatenate(self.ids)
        return [zlib.compress(np.asarray(a, t).tobytes(), 1) for a, t in zip((self.rows, flat, sizes, self.y, self.fold), BLOCK_TYPES, strict=True)]

    @classmethod
    def unpack(cls, columns: list[bytes]) -> Block:
        rows, flat, sizes, y, fold = (np.frombuffer(zlib.decompress(c), t).astype(to) for c, t, to in zip(columns, BLOCK_TYPES, (np.int64, np.int64, np.int64, np.float64, bool), strict=True))
        return cls(rows.reshape(-1, 4), np.split(flat, sizes.cumsum()[:-1]), y, fold)


BLOCK_TYPES = (np.uint16, np.int32, np.int64, np.uint8, np.uint8)  # SLOTS and LANGS fit the first


def slot_counts(block: Block) -> np.ndarray:
    """By label: the texts to learn from that hold each slot, then the number of those texts."""
    counts = np.zeros((2, SLOTS + 1), np.int64)
    for i in np.flatnonzero(~block.fold):
        counts[int(block.y[i]), np.append(np.unique(block.rows[block.ids[i], :3]), SLOTS)] += 1
    return counts.ravel()


@dataclass
class State:
    """A model in training and the sums of its squared gradients: one of each embedding, of all else one each."""

    model: Cnn
    square: list[np.ndarray]
    bias_square: float = 0.0

    @classmethod
    def begin(cls, counts: np.ndarray, seed: int) -> State:
        """The first dimension starts from the log-odds of each slot's document counts, which the first filter of each width reads."""
        rng = np.random.default_rng(seed)
        f32 = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
        model = Cnn(f32(SLOTS, DIM, scale=0.3), [f32(w, DIM, FILTERS, scale=0.5 / np.sqrt(w * DIM)) for w in WIDTHS], f32(len(WIDTHS) * FILTERS, scale=0.1), 0.0, np.zeros(len(LANGS)))
        counts = counts.reshape(2, -1)
        n, counts = counts[:, -1], counts[:, :-1]
        odds = np.log((counts[1] + 0.3) / (n[1] + 0.6)) - np.log((counts[0] + 0.3) / (n[0] + 0.6))
        seen = counts.sum(0)
        model.emb[:, 0] = odds * seen / (seen + 4) / 4  # rare slots stay near 0
        for j, c in enumerate(model.conv):
            c[:, 0, 0] = 1.0
            c[:, 1:, 0] = 0.0
            model.out[j * FILTERS] = 1.0 / len(c)
        return cls(model, [np.zeros(SLOTS, np.float32), *map(np.zeros_like, (*model.conv, model.out))])

    def flat(self) -> np.ndarray:
        """Embeddings and their squares first: what slots have, then the rest."""
        m = self.model
        return np.concatenate([a.ravel() for a in (m.emb, *self.square, *m.conv, m.out)] + [[m.bias, self.bias_square]]).astype(np.float64)

    @classmethod
    def of(cls, flat: np.ndarray, like: State) -> State:
        m, parts, at = like.model, [], 0
        for a in (m.emb, *like.square, *m.conv, m.out):
            parts.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        k = 1 + len(like.square)
        return cls(Cnn(parts[0], parts[k:-1], parts[-1], float(flat[-2]), m.cuts.copy()), parts[1:k], float(flat[-1]))

    def change(self, block: Block, balance: tuple[float, float], step: float, seed: list[int]) -> np.ndarray:
        """What an epoch over the block changes in fixed point, so that sums don't depend on their order; then the slots that it
        holds and 1."""
        before = self.flat()
        own = State.of(before, self)
        own.learn(block, balance, step, np.random.default_rng(seed))
        held = np.zeros(SLOTS, np.int64)
        for i in np.flatnonzero(~block.fold):
            held[block.rows[block.ids[i], :3]] = 1
        return np.concatenate([np.rint((own.flat() - before) * POINT).astype(np.int64), held, [1]])

    def changed(self, total: np.ndarray) -> State:
        """The mean of the blocks' changes; a slot's is over the blocks that hold it."""
        total, held, n = total[: -SLOTS - 1] / POINT, np.maximum(total[-SLOTS - 1 : -1], 1), total[-1]
        slots = np.concatenate([np.repeat(held, DIM), held])
        return State.of(self.flat() + total / np.concatenate([slots, np.full(len(total) - len(slots), n)]), self)

    def learn(self, block: Block, balance: tuple[float, float], step: float, rng: np.random.Generator) -> None:
        """One epoch over the block's rows, in place."""
        model, rows, ids, y = self.model, block.rows, block.ids, block.y
        order = rng.permutation(np.flatnonzero(~block.fold))
        for s in range(0, len(order), BATCH):
            b = order[s : s + BATCH]
            flat = np.concatenate([x for i in b for x in (ids[i], [-1] * max(WIDTHS))])
            starts = np.cumsum([0, *(len(ids[i]) + max(WIDTHS) for i in b[:-1])])
            used, local = np.unique(flat, return_inverse=True)  # the pad -1 comes first
            r = rows[used[1:]]
            v = np.vstack([np.zeros((1, DIM), np.float32), model.emb[r[:, 0]] + model.emb[r[:, 1]] + model.emb[r[:, 2]]])
            x, at = _pool(local, starts, [[v @ c[k] for k in range(len(c))] for c in model.conv])
            h = np.maximum(x, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.bias, -30, 30)))
            d = ((p - y[b]) * np.take(balance, y[b].astype(int)) / len(b)).astype(np.float32)
            dx = (d[:, None] * model.out) * (x > 0)
            grads, dv = [], np.zeros_like(v)
            padded = np.append(local, [0] * max(WIDTHS))
            for j, c in enumerate(model.conv):
                g, a = dx[:, j * FILTERS : (j + 1) * FILTERS], at[:, j * FILTERS : (j + 1) * FILTERS]
                gc = np.empty_like(c)
                for k in range(len(c)):
                    w = padded[a + k]
                    gc[k] = np.einsum("bfd,bf->df", v[w], g)
                    np.add.at(dv, w.ravel(), (g[:, :, None] * c[k].T[None]).reshape(-1, DIM))
                grads.append(gc)
            grads.append(h.T @ d)
            slots, where = np.unique(r[:, :3], return_inverse=True)
            de = np.zeros((len(slots), DIM), np.float32)
            np.add.at(de, where.reshape(-1), np.repeat(dv[1:], 3, 0))
            self.square[0][slots] += (de * de).mean(1)
            model.emb[slots] -= step * de / (np.sqrt(self.square[0][slots])[:, None] + 1e-6)
            for q, g, z in zip([*model.conv, model.out], grads, self.square[1:], strict=True):
                z += g * g
                q -= step * 0.3 * g / (np.sqrt(z) + 1e-6)
            self.bias_square += float(d.sum()) ** 2
            model.bias -= step * 0.3 * float(d.sum()) / (self.bias_square**0.5 + 1e-6)


def cut_counts(model: Cnn, block: Block) -> np.ndarray:
    """The rows left to the cuts, by language, label and margin in steps of 1 / CUT_STEPS."""
    counts = np.zeros((len(LANGS), 2, CUT_BINS), np.int64)
    own = np.flatnonzero(block.fold)
    ids = [block.ids[i] for i in own]
    langs = np.array([guess(block.rows[i, 3]) for i in ids], np.int64)
    at = np.clip(np.floor(model.margins_of(block.rows, ids) * CUT_STEPS) + CUT_BINS // 2, 0, CUT_BINS - 1).astype(np.int64)
    np.add.at(counts, (langs, block.y[own].astype(int), at), 1)
    return counts.ravel()


def calibrate(model: Cnn, counts: np.ndarray, least: int = 5) -> None:
    """The cut of each language in the middle of the cuts that make fewest errors; few rows: the cut over all languages."""
    counts = counts.reshape(len(LANGS), 2, CUT_BINS)

    def best(zeros: np.ndarray, ones: np.ndarray) -> float:
        wrong = np.append(0, ones.cumsum()) + zeros.sum() - np.append(0, zeros.cumsum())  # with the cut below each bin
        seen = np.flatnonzero(zeros + ones)
        low, high = seen[0], seen[-1] + 1
        top = low + np.flatnonzero(wrong[low : high + 1] == wrong[low : high + 1].min())
        return float((top[0] + top[-1]) / 2 - CUT_BINS // 2) / CUT_STEPS

    model.cuts[:] = best(*counts.sum(0)) if counts.sum((0, 2)).all() else 0.0
    for k in range(1, len(LANGS)):
        n = counts[k].sum(1)
        if n.min() >= least:
            share = n[1] / (n[1] + 20)  # few toxic rows: nearer to the common cut
            model.cuts[k] = share * best(*counts[k]) + (1 - share) * model.cuts[0]


Sum = Callable[[Callable[[Block, int], np.ndarray]], np.ndarray]


def fit_blocks(zeros: int, ones: int, total: Sum, seed: int = 7) -> Cnn:
    """The model of all blocks; total(f) is the sum of f(block, its number) over them. Every epoch starts at all blocks from the same
    state and ends with the mean of their changes."""
    if not zeros or not ones:
        return Cnn(np.zeros((1, DIM), np.float32), [], np.zeros(0, np.float32), 0.0, np.zeros(len(LANGS)), prior=float(np.log((ones + 1) / (zeros + 1))))
    balance = ((zeros + ones) / (2 * zeros), (zeros + ones) / (2 * ones))
    state = State.begin(total(lambda block, _: slot_counts(block)), seed)
    for epoch in range(EPOCHS):
        step = RATE * (1 - epoch / EPOCHS) + 0.01
        state = state.changed(total(lambda block, k, s=state, e=epoch, r=step: s.change(block, balance, r, [seed, e, k])))
    model = state.model
    calibrate(model, total(lambda block, _: cut_counts(model, block)))
    return model


def fit(texts: list[str], y: np.ndarray, seed: int = 7) -> Cnn:
    """The same from one block in memory."""
    block = Block.of(texts, y, np.random.default_rng(seed).permutation(len(y)) % 5 == 0)
    return fit_blocks(int((y == 0).sum()), int((y != 0).sum()), lambda f: f(block, 0), seed)


def wanted(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels to learn from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))


def nearly(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with a label to learn from, and of a few others; equal ids of unequal types have unequal hashes."""
    docs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return common.among(docs, wanted(labels), "doc_id") if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType else docs


def training_rows(docs: DataFrame, labels: DataFrame, limit: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y) of the rows to learn from: all, or at most limit of each label and most_bytes of texts. Only lengths are read
    before that choice, 2 * limit of them on the driver."""
    picked = wanted(labels)
    if limit is None and most_bytes is None:
        return nearly(docs, labels).join(picked, "doc_id")
    halves = [picked.filter(c) for c in (F.col("y") == 1, F.col("y") != 1)]
    if limit is not None:
        halves = [h.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for h in halves]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(halves[0].unionByName(halves[1]), "doc_id")
    found = sizes.groupBy("doc_id", "y").agg(F.sum("size").alias("size")).collect()
    chosen, left = [], {y: float("inf") if most_bytes is None else most_bytes // 2 for y in (0, 1)}
    for r in sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        if r["size"] <= left[min(r.y, 1)]:
            left[min(r.y, 1)] -= r["size"]
            chosen.append((r.doc_id, r.y))
    rows = docs.sparkSession.createDataFrame(chosen, T.StructType([docs.schema["doc_id"], T.StructField("y", T.IntegerType())]))
    return docs.join(F.broadcast(rows), "doc_id")


def blocks(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """All rows to learn from in n blocks by a hash of the id, each a row of packed arrays; the rows of a block beyond PART_BYTES of texts
    make further rows. A fifth of the ids, by another hash, is left to the cuts. Texts are shuffled once: labels go to the blocks as
    rows of their own and meet the texts there."""
    kind = docs.schema["doc_id"].dataType
    both = nearly(docs, labels).withColumn("y", F.lit(None).cast("int")).unionByName(wanted(labels).select(F.col("doc_id").try_cast(kind), F.lit(None).cast("string").alias("text"), "y"))
    dealt = both.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(n, "block")
    keyed = (
        dealt.withColumn("y", F.max("y").over(Window.partitionBy("block", "doc_id"))).filter(F.col("text").isNotNull() & F.col("y").isNotNull())
        .sortWithinPartitions("block", "doc_id", "text")
        .select("block", "text", (F.col("y") > 0).cast("int").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit("cuts")), F.lit(5)) == 0).cast("int").alias("fold"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, fold, held, size = [], [], [], None, 0

        def done() -> pa.RecordBatch:
            columns = Block.of(texts, np.array(y, np.float64), np.array(fold, bool)).pack()
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], names=["block", *PACKED])

        for b in batches:
            for block, text, label, cut in zip(*(b.column(c).to_pylist() for c in ("block", "text", "y", "fold")), strict=True):
                if texts and (block != held or size >= PART_BYTES):
                    yield done()
                    texts, y, fold, size = [], [], [], 0
                held, size = block, size + len(text)
                texts.append(text)
                y.append(label)
                fold.append(cut)
        if texts:
            yield done()

    return keyed.mapInArrow(pack, "block long, " + ", ".join(f"{c} binary" for c in PACKED))


def total(packed: DataFrame, f: Callable[[Block, int], np.ndarray]) -> np.ndarray:
    """The sum of f's integers over all blocks. Tasks add their blocks up, pieces of these sums are shuffled; the driver gets one sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for r in b.to_pylist():
                x = f(Block.unpack([r[c] for c in PACKED]), r["block"])
                out = x if out is None else out + x
        if out is not None:
            yield from map(pieces, range(0, len(out), PIECE), (out[i : i + PIECE] for i in range(0, len(out), PIECE)))

    def pieces(at: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["at", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b.column("at").to_pylist(), b.column("sums").to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(x, np.int64)
        yield from map(pieces, sums, sums.values())

    found = packed.mapInArrow(add, "at long, sums binary").repartition(MERGERS, "at").mapInArrow(merge, "at long, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums, np.int64) for r in sorted(found, key=lambda r: r["at"])])


def train(docs: DataFrame, labels: DataFrame) -> Cnn:
    """The model of all labelled rows outside the held-out fifth."""
    y = F.col("y") > 0
    sizes = nearly(docs, labels).select("doc_id", F.octet_length("text").cast("long").alias("size")).join(wanted(labels), "doc_id")
    n = sizes.agg(F.count_if(~y).alias("zeros"), F.count_if(y).alias("ones"), F.sum("size").alias("bytes")).first()
    if not n.zeros or not n.ones:
        return fit_blocks(n.zeros, n.ones, None)
    stages = common.Stages(docs.sparkSession, "toxicity")
    try:
        packed = stages.put(blocks(docs, labels, max(-(-(n.zeros + n.ones) // BLOCK_ROWS), -(-n.bytes // BLOCK_BYTES))))
        return fit_blocks(n.zeros, n.ones, lambda f: total(packed, f))
    finally:
        stages.clear()


def score(df: DataFrame, model: Cnn, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df's other columns, score and predicted; one Arrow pass without a shuffle. The model's size doesn't depend on the data."""
    keep = [c for c in df.columns if c not in (text, "score", "predicted")]
    shared, own = df.sparkSession.sparkContext.broadcast(model), common.unused("__text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in common.chunks(batches, own):
            if len(vocabulary) > MAX_CACHE:
                vocabulary = Vocabulary()
            m = shared.value.margins([t or "" for t in b.column(len(keep)).to_pylist()], vocabulary)
            s = 1 / (1 + np.exp(-np.clip(m.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(own)).mapInArrow(run, ", ".join([*fields, "score double, predicted int"]))


def op6_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity_cnn": op6_toxicity_cnn}
SQL: dict[str, str] = {}
