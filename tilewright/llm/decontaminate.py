"""Benchmark decontamination: a BM25 inverted index of the test items, searched for every training passage by block-max WAND.

The index keeps for each term the blocks of ITEM_BLOCK neighbouring items that hold it, with the term's greatest impact in
each block, and below them its postings (item, impact). Impacts are divided by the item's own threshold, so every item is found
at a sum of 1 or more. Items with the same frequent terms are neighbours, which makes the blocks' bounds tight.

A query's cursors stand on the blocks of its terms. The pivot is the first block at which the greatest impacts of all
terms up to there can add up to 1: what lies before it can't, and is skipped. At the pivot the greatest impacts in this block are
added; only where these reach 1 are its postings read. All queries of a batch advance at once, one pivot each. A query's
terms count once, so what a stretch of text doesn't reach none of its passages reaches: stretches are searched first, and the
passages only for the items that their stretch reaches. So every passage is searched and all items above it are found.

The passages for an item overlap by half and are twice the least power of two of words that hold it (64 at least), so each item
is whole in one. A found item counts as a leak if its question and its answer, taken as shingles of five words, both occur in the
passage to 80 % or more. The answer is what follows the last inner question mark, else the last sentence, else the last third
of the words.

Numbers of items, mean length and document frequencies are those of all items, whatever index holds an item. An index holds at
most MAX_INDEX_BYTES of item texts, which bounds what is broadcast; more items make more indexes of the same statistics, each
with a pass of its own over the documents.

Defined results: null or empty texts hold no leak; null items and items without words are skipped; items that repeat are
searched once for each id; a row of the documents that repeats gives its results again, one with a null id gives them under null;
empty tables give empty results. Only ids and texts are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of the score that an item reaches against itself
OVERLAP = 0.8
SHINGLE = 5
ITEM_BLOCK = 16
MAX_INDEX_BYTES = 16 << 20
SHORTEST = 64  # words of a passage
STRETCH = 512  # words that are searched at once before their passages are
QUERIES_AT_ONCE = 2048
MAX_CACHE = 300_000
EPS = 1e-6
EDGE = re.compile(r"^\W+|\W+$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
OUT = "doc_id long, item_id long, score double, self_score double, question_overlap double, answer_overlap double, word_at long"


def norm(raw: str) -> str:
    """Lower case without what isn't a letter, digit or underscore at either end."""
    return EDGE.sub("", raw.lower())


def terms(text: str) -> list[str]:
    return [w for w in map(norm, text.split()) if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    at = text.rstrip().rfind("?", 0, len(text.rstrip()) - 1)
    cut = at + 1 if at >= 0 else next((m.end() for m in reversed(list(SENTENCE.finditer(text.rstrip())))), 0)
    q, a = terms(text[:cut]), terms(text[cut:])
    if not q or not a:
        w = q or a
        k = len(w) - max(1, len(w) // 3) if len(w) > 1 else 0
        q, a = w[:k], w[k:]
    return q, a


@dataclass
class Index:
    """Postings in three levels: terms, their blocks, the items of each."""

    vocabulary: dict[str, int]
    ids: list[int]
    top: np.ndarray  # greatest impact of each term
    key: np.ndarray  # term * (n_blocks + 1) + block of each block posting, sorted; a term's last one is its end
    first: np.ndarray  # where each term's block postings begin
    block: np.ndarray
    block_top: np.ndarray
    post: np.ndarray  # where the item postings of each block posting begin
    item: np.ndarray
    impact: np.ndarray
    own: np.ndarray  # an item's score against itself
    words: np.ndarray  # of the passages for an item
    bags: list[tuple[np.ndarray, np.ndarray]]  # an item's terms and their impacts
    parts: list[tuple[list[tuple[int, ...]], list[tuple[int, ...]]]]  # shingles of question and answer

    @property
    def n_blocks(self) -> int:
        return -(-len(self.ids) // ITEM_BLOCK)

    def wand(self, queries: list[np.ndarray]) -> list[tuple[int, int]]:
        """(query, item) for every item whose impacts over a query's distinct terms add up to 1 or more."""
        out: list[tuple[int, int]] = []
        order = sorted(range(len(queries)), key=lambda i: len(queries[i]))  # alike in length, so that little is padded
        for s in range(0, len(order), QUERIES_AT_ONCE):
            rows = [i for i in order[s : s + QUERIES_AT_ONCE] if len(queries[i])]
            if rows:
                out += [(rows[q], i) for q, i in self._advance([queries[i] for i in rows])]
        return sorted(out)

    def _advance(self, queries: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        end, wide = self.n_blocks, self.n_blocks + 1
        term = np.full((len(queries), max(map(len, queries))), len(self.top) - 1)  # the last term has no postings
        for i, q in enumerate(queries):
            term[i, : len(q)] = q
        top, at, row = self.top[term], self.first[term], np.arange(len(queries))
        while len(row):
            here = self.block[at]
            by = np.argsort(here, axis=1, kind="stable")
            reach = np.cumsum(np.take_along_axis(np.where(here < end, top, 0), by, 1), 1) >= 1 - EPS
            pivot = np.take_along_axis(here, np.take_along_axis(by, reach.argmax(1)[:, None], 1), 1)
            live = reach[:, -1]  # the others have no pivot left
            row, term, top, at, here, pivot = row[live], term[live], top[live], at[live], here[live], pivot[live]
            if not len(row):
                return
            behind = here < pivot
            at[behind] = np.searchsorted(self.key, (term * wide + pivot)[behind])
            on = self.block[at] == pivot
            rich = np.where(on, self.block_top[at], 0).sum(1) >= 1 - EPS
            if rich.any():
                q, _ = np.nonzero(on[rich])
                yield from self._read(np.flatnonzero(rich), q, at[rich][on[rich]], row)
            at[on] += 1

    def _read(self, rich: np.ndarray, q: np.ndarray, postings: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """The items of the pivots' blocks, by their own impacts."""
        n = self.post[postings + 1] - self.post[postings]
        at = np.repeat(self.post[postings] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(q, n) * ITEM_BLOCK + self.item[at] % ITEM_BLOCK
        total = np.bincount(cell, self.impact[at], len(rich) * ITEM_BLOCK)
        block = np.zeros(len(rich), np.int64)
        block[q] = self.block[postings]
        for c in np.flatnonzero(total >= 1 - EPS):
            yield int(row[rich[c // ITEM_BLOCK]]), int(block[c // ITEM_BLOCK] * ITEM_BLOCK + c % ITEM_BLOCK)

    def leaks(self, texts: list[np.ndarray]) -> list[dict[int, tuple[float, float, float, int]]]:
        """For each text (term numbers in order), by item: score, overlap of question and answer and the passage's first word, of the
        best passage."""
        queries, place = [], []
        rest = len(self.top) - 1
        lap = int(self.words.max())
        for k, ids in enumerate(texts):
            step = max(STRETCH, lap)
            for s in range(0, max(1, len(ids) - lap), step):  # stretches overlap by a passage
                d = np.unique(ids[s : s + step + lap])
                queries.append(d[d < rest])
                place.append((k, s, s + step + lap))
        near: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for q, i in self.wand(queries):
            k, a, z = place[q]
            near[k, i].append((a, z))
        found: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        for (k, i), stretches in sorted(near.items()):
            if best := self._best(texts[k], i, stretches):
                found[k][i] = best
        return found

    def _best(self, ids: np.ndarray, item: int, stretches: list[tuple[int, int]]) -> tuple[float, float, float, int] | None:
        length, (terms_, impacts) = int(self.words[item]), self.bags[item]
        best = None
        last = max(0, len(ids) - length)
        for at in sorted({min(x, last) for a, z in stretches for x in range(a // (length // 2) * (length // 2), max(a + 1, z), length // 2)}):
            part = ids[at : at + length]
            score = float(impacts[np.isin(terms_, part)].sum())
            if score >= 1 - EPS and (best is None or score > best[0] + EPS):
                q, a = (overlap(p, part) for p in self.parts[item])
                if min(q, a) >= OVERLAP:
                    best = (score, q, a, at)
        return best and (best[0] * THRESHOLD * float(self.own[item]), *best[1:])


def overlap(shingles: list[tuple[int, ...]], ids: np.ndarray) -> float:
    """Share of the shingles that occur in the words; 1 if there are none."""
    if not shingles:
        return 1.0
    n = len(shingles[0])
    text = ids.tolist()
    have = set(zip(*(text[i:] for i in range(n)), strict=False))
    return sum(s in have for s in shingles) / len(shingles)


@dataclass
class Statistics:
    n: int
    mean: float
    df: dict[str, int]


def build(items: list[tuple[int, str]], stats: Statistics) -> Index:
    bags = [Counter(terms(t)) for _, t in items]
    # neighbours share their frequent terms
    order = sorted(range(len(items)), key=lambda i: (sorted(((-stats.df[w], w) for w in bags[i]))[:8], items[i][0], items[i][1]))
    items, bags = [items[i] for i in order], [bags[i] for i in order]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
    term, item, impact, own, of = [], [], [], [], []
    for i, b in enumerate(bags):
        n = sum(b.values())
        t = np.array([vocabulary[w] for w in b])
        idf = np.array([math.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) for w in b])
        tf = np.array(list(b.values()), float)
        x = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / stats.mean))
        own.append(float(x.sum()))
        x = x / (THRESHOLD * own[-1])
        term.append(t), item.append(np.full(len(t), i)), impact.append(x), of.append((t, x))
    term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
    by = np.lexsort((item, term))
    term, item, impact = term[by], item[by], impact[by]
    rest, wide = len(vocabulary), -(-len(items) // ITEM_BLOCK) + 1
    key = term * wide + item // ITEM_BLOCK
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    # after its blocks each term, and the one that stands for all other words, has an end without postings
    ends = np.arange(rest + 1) * wide + wide - 1
    keys = np.append(key[new], ends)
    tops = np.append(np.maximum.reduceat(impact, new), np.zeros(rest + 1))
    starts = np.append(new, np.full(rest + 1, len(item)))
    counts = np.append(np.diff(np.append(new, len(item))), np.zeros(rest + 1, np.int64))
    by = np.argsort(keys, kind="stable")
    keys, tops, counts = keys[by], tops[by], counts[by]
    post = np.append(0, np.cumsum(counts))
    first = np.searchsorted(keys, np.arange(rest + 1) * wide)
    top = np.maximum.reduceat(tops, first)
    parts = [tuple(_shingles([vocabulary[w] for w in p]) for p in question_answer(t)) for _, t in items]
    words = np.array([2 * max(SHORTEST // 2, 1 << (sum(b.values()) - 1).bit_length()) for b in bags])
    return Index(vocabulary, [i for i, _ in items], top, keys, first, keys % wide, tops, post, item, impact, np.array(own), words, of, parts)


def _shingles(ids: list[int]) -> list[tuple[int, ...]]:
    k = min(SHINGLE, len(ids))
    return sorted({tuple(ids[i : i + k]) for i in range(len(ids) - k + 1)}) if ids else []


def bags(items: DataFrame) -> DataFrame:
    """(item_id, text, n, words) of the distinct items with words: n counts all words, words holds each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, w) for i, t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(terms, b.column(1).to_pylist()), strict=True) if w]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([sorted(set(r[2])) for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "n", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    return rows.mapInArrow(run, "item_id long, text string, n long, words array<string>")


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of at most about MAX_INDEX_BYTES of item texts each; the statistics are those of all items."""
    rows = bags(items)
    total = rows.agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.sum(F.octet_length("text")).alias("size")).first()
    if not total.n:
        return
    n_parts = -(-total["size"] // MAX_INDEX_BYTES)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)))
    words = rows.select("_part", F.explode("words").alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    for k in range(n_parts):
        own = rows.filter(F.col("_part") == k).select("item_id", "text").collect()  # bounded by MAX_INDEX_BYTES
        if own:
            found = df if n_parts == 1 else df.join(words.filter(F.col("_part") == k).select("w").distinct(), "w", "left_semi")
            yield build([tuple(r) for r in own], Statistics(total.n, total.mean, {r.w: r.df for r in found.toLocalIterator()}))


class Ids(dict):
    """Raw word to term; -1: nothing is left of it; the number after the last term: a word of no item."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        w = norm(raw)
        self[raw] = i = self.vocabulary.get(w, len(self.vocabulary)) if w else -1
        return i

    def of(self, text: str | None) -> np.ndarray:
        x = np.fromiter(map(self.__getitem__, (text or "").split()), np.int64)
        return x[x >= 0]


def searched(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Batches of bounded size and what each of their rows leaks."""
    ids = Ids(index.vocabulary)
    for b in common.chunks(batches):
        if len(ids) > MAX_CACHE:
            ids.clear()
        yield b, index.leaks([ids.of(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()])


def search(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b, found in searched(batches, index):
            rows = [(doc_id, index.ids[i], s, float(index.own[i]), q, a, at) for doc_id, f in zip(b.column(0).to_pylist(), found, strict=True) for i, (s, q, a, at) in sorted(f.items())]
            if rows:
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks, with the best passage. No shuffle."""
    out = None
    for index in indexes(items):
        part = search(docs, index)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], OUT) if out is None else out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a leak, all columns kept; a pass for each index, no shuffle."""
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b, found in searched(batches, shared.value):
                yield b.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_bm25_decontamination": op10_bm25_decontamination}
SQL: dict[str, str] = {}
