"""Ranked lexical search: each item's best documents by integer BM25 scores, as products of dense tiles in float64.

The texts are read once for each index and become vectors of those terms that some item holds: (doc_id, n, terms, counts). Document
frequencies, the number of documents and their length are sums over these vectors. A second pass over the vectors multiplies tiles: rows of items
by a tile of the vocabulary (the terms' weights times their repeats in the item) times the same tile of TILE_DOCS documents'
impacts. Tiles are compact: only terms that occur in these documents have a column, only items that hold one of them a row.
All entries are integers, and a tile ends before an item's weights, times the greatest impact, could reach 2^53; so each product is exact in
float64, and the products are added as 64-bit integers. A weight too large for one tile is split over several.

Each task keeps its best TOP documents of every item: of a tile what is below the item's TOP-th best score, here or before, is left
out, but nothing that equals it, so ties are settled by id as if all rows had been sorted. What the tasks kept, TOP rows of an item
each, is ranked at last.

An index holds items of at most MAX_INDEX_BYTES and MAX_ITEMS; more items make more indexes, each with a pass over the texts,
under the same statistics of documents.

Defined results: a null or empty text has no terms; such documents aren't counted and never found, such items find nothing. Equal scores go by
ascending id, null ids last; repeated rows of a document are documents of their own, repeated rows of an item are one, and
different texts under one item id are ranked each for itself. Extra columns aren't read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

TOP = 10
B_PERCENT = 75
MOST_IMPACT = 10**6  # no term's impact is greater
EXACT = (2**53 - 1) // MOST_IMPACT  # what an item's weights in a tile add up to at most
TILE_TERMS, TILE_DOCS, TILE_ITEMS = 512, 256, 2048
MAX_INDEX_BYTES, MAX_ITEMS = 8 << 20, 16_384
PIECE = 4 << 20  # bytes of a text that are split at once
#: A-Z lower-cased, other ASCII but digits and letters to spaces, all else as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"
OUT = "item_id long, rank int, doc_id long, score long"


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    flat, start = (text or b"").translate(FOLD), 0
    while start < len(flat):
        end = flat.find(b" ", start + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


@dataclass
class Tile:
    """Weights of a part of the vocabulary: those of term[k] are item, weight[first[k] : first[k + 1]]."""

    term: np.ndarray
    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray


@dataclass
class Index:
    """Items whose vocabulary is numbered, terms of many items first."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    held: list[list[tuple[int, int]]]  # (item, repeats) of each term


def index(items: Sequence[tuple[int | None, str | None]]) -> Index:
    found: dict[bytes, list[tuple[int, int]]] = {}
    for k, (_, text) in enumerate(items):
        for t, n in Counter(w for ws in terms((text or "").encode()) for w in ws).items():
            found.setdefault(t, []).append((k, n))
    order = sorted(found, key=lambda t: (-len(found[t]), found[t][0], t))
    return Index([i for i, _ in items], {t: k for k, t in enumerate(order)}, [found[t] for t in order])


def tiles(held: Sequence[Sequence[tuple[int, int]]], weight: Sequence[int], n_items: int, exact: int = EXACT, size: int = TILE_TERMS) -> list[Tile]:
    """The vocabulary in tiles of at most `size` terms in which no item's weights add up to more than `exact`."""
    out: list[list[tuple[int, list[int], list[int]]]] = [[]]
    sums = np.zeros(n_items, np.int64)
    for t, (of, w) in enumerate(zip(held, weight, strict=True)):
        left = {i: n * w for i, n in of if w > 0}
        while left:
            part = {i: min(v, exact) for i, v in left.items()}
            rows, values = list(part), list(part.values())
            if len(out[-1]) == size or (sums[rows] + values > exact).any():
                out.append([])
                sums[:] = 0
            out[-1].append((t, rows, values))
            sums[rows] += values
            left = {i: left[i] - v for i, v in part.items() if left[i] > v}
    made = []
    for tile in filter(None, out):
        first = np.cumsum([0, *(len(rows) for _, rows, _ in tile)])
        made.append(Tile(np.array([t for t, _, _ in tile]), first, np.concatenate([r for _, r, _ in tile]).astype(np.int64), np.concatenate([v for _, _, v in tile]).astype(np.float64)))
    return made


def multiply(ts: Sequence[Tile], n_items: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (items x documents) of the entries (document, term, impact) of one tile of documents."""
    scores = np.zeros((n_items, n_docs), np.int64)
    by = np.argsort(term, kind="stable")
    doc, term, impact = doc[by], term[by], impact[by]
    used = np.unique(term)
    for tile in ts:
        here = np.flatnonzero(np.isin(tile.term, used, assume_unique=True))
        lo, hi = np.searchsorted(term, tile.term[here]), np.searchsorted(term, tile.term[here], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        impacts = np.zeros((len(here), n_docs))
        impacts[np.repeat(np.arange(len(here)), n), doc[at]] = impact[at]
        n = tile.first[here + 1] - tile.first[here]
        at = np.arange(n.sum()) + np.repeat(tile.first[here] - np.cumsum(n) + n, n)
        rows, row = np.unique(tile.item[at], return_inverse=True)
        column, weight = np.repeat(np.arange(len(here)), n), tile.weight[at]
        for r in range(0, len(rows), TILE_ITEMS):
            own = (row >= r) & (row < r + TILE_ITEMS)
            weights = np.zeros((min(TILE_ITEMS, len(rows) - r), len(here)))
            weights[row[own] - r, column[own]] = weight[own]
            scores[rows[r : r + TILE_ITEMS]] += (weights @ impacts).astype(np.int64)
    return scores


class Best:
    """The best `top` documents of each item so far."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.ones(n_items, np.int64)  # the least score that can still come in
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores: items x documents."""
        floor = self.floor
        if scores.shape[1] > self.top:
            floor = np.maximum(floor, np.partition(scores, -self.top, axis=1)[:, -self.top])
        i, d = np.nonzero(scores >= floor[:, None])
        if not len(i):
            return
        item, score = np.concatenate([self.item, i]), np.concatenate([self.score, scores[i, d]])
        ids, null = np.concatenate([self.doc, doc[d]]), np.concatenate([self.null, null[d]])
        by = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[by], score[by], ids[by], null[by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.top
        self.item, self.score, self.doc, self.null = item[kept], score[kept], ids[kept], null[kept]
        full = place == self.top - 1
        self.floor[item[full]] = score[full]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text) as VECTOR: n counts all terms, terms and counts hold those of the vocabulary."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in common.chunks(batches):
            n, keys = np.zeros(b.num_rows, np.int64), []
            for k, text in enumerate(common.as_bytes(b.column(1))):
                for ws in terms(text):
                    n[k] += len(ws)
                    keys.append(np.array([known[w] for w in ws if w in known], np.int64) + k * size)
            key, count = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(b.num_rows + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % size, count)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, VECTOR)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """The number of vectors that hold each of `size` terms; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(n[t])], names=["term", "n"])

    df = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.term] = r.n
    return df


def ranked(rows: DataFrame, idx: Index, top: int = TOP) -> DataFrame:
    """(item, item_id, doc_id, score): of each item of the index the best of each task; rows: written vectors."""
    total = rows.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms, n_items = total.docs, total.terms or 1, len(idx.ids)
    df = frequencies(rows, max(1, len(idx.vocabulary)))[: len(idx.vocabulary)]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(tiles(idx.held, weight.tolist(), n_items))
    ids = idx.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ts = Best(n_items, top), shared.value
        for b in batches:
            for s in range(0, b.num_rows, TILE_DOCS):
                t = b.slice(s, TILE_DOCS)
                doc = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column(2)).to_numpy(zero_copy_only=False))
                term, tf = (t.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
                m = 100 - B_PERCENT + B_PERCENT * t.column(1).to_numpy() * n_docs // n_terms
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                null = t.column(0).is_null().to_numpy(zero_copy_only=False)
                best.add(multiply(ts, n_items, doc, term, impact, t.num_rows), t.column(0).fill_null(0).to_numpy(), null)
        columns = [pa.array(best.item), pa.array([ids[i] for i in best.item.tolist()], pa.int64()), pa.array(best.doc, mask=best.null), pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of at most MAX_ITEMS items and about MAX_INDEX_BYTES of their texts; one at a time is on the driver."""
    own: list[tuple[int | None, str]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        if own and (len(own) == MAX_ITEMS or size + len(r.text or "") > MAX_INDEX_BYTES):
            yield index(own)
            own, size = [], 0
        own.append((r.item_id, r.text))
        size += len(r.text or "")
    if own:
        yield index(own)


def search(docs: DataFrame, items: DataFrame, stages: common.Stages, top: int = TOP) -> DataFrame:
    """OUT: the `top` best documents of each item."""
    out = None
    for k, idx in enumerate(indexes(items)):
        rows = stages.put(vectors(docs, idx.vocabulary))
        part = stages.put(ranked(rows, idx, top).withColumn("part", F.lit(k)))
        stages.drop(rows)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], OUT)
    by = W.partitionBy("part", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op11_blas_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), common.Stages(spark, "op11"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op11_blas_search": op11_blas_search}
SQL: dict[str, str] = {
    "op11_blas_search": f"""WITH q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
impact AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) AS i FROM tf, total),
scores AS (SELECT item_id, doc_id, sum(w * i)::BIGINT AS score FROM q JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0) WHERE rank <= {TOP}""",
}
