"""MinHash near-duplicates by a multi-index Hamming join.

Texts become sets of word shingles; equal sets form a class at once. A class with enough shingles gets a signature of
SYMBOLS b-bit minima (b = 8). By the pigeonhole principle two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 = 19 of 60 symbols have a chunk of 6 in which at most ERRORS = 1 differ; every class is
indexed under each chunk with each choice of that one symbol left out, so all pairs under the signature distance meet.
At similarity 0.8 a pair meets with probability 1 - 2.4e-5, above it more often. Sets too small for any other partner
than an equal set aren't indexed, as they need no search.

What meets is linked only after a check of the full sets. Classes whose signatures differ in at most FARTHEST symbols and that meet
in the index are of one family: each is compared with one hub, then in buckets that hold several families all members are compared,
and only which families join is passed on. The full sets are sent to blocks of their family, each once, and checked there,
nearest signatures first, until the block's members are connected or all their pairs are checked. In a family of several blocks (its
hub is in each) what then lies outside the family's most common component meets all blocks. So pairs of texts are never rows: a block
returns its components as stars. Two tests come before the full check that are right with a stated probability: a pair
whose signatures differ in over FARTHEST symbols (1e-8 at similarity 0.8) and one of long sets whose least hashes lie 4.9 deviations
under the similarity (5e-7). exact=True does without both: then every pair that the index finds is checked in full.

Defined results: a null text or one without words has an empty set, is linked with nothing and is its own component;
fewer words than a shingle count as one shingle; equal sets are linked whatever the order of texts. Rows that repeat an
id share one component, which all their texts' classes belong to. A row with a null id takes part like any other but is never
kept, and its component is null if no row of it has an id. Empty tables give empty results. Only id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common
from .components import components

SIMILAR = 80  # of 100
CHUNKS, WIDTH, ERRORS = 10, 6, 1
SYMBOLS = CHUNKS * WIDTH
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Pairs that meet in the index by luck may lie farther apart; up to here they are checked (at similarity 0.8 all but 1e-8 lie nearer).
FARTHEST = 30
LOWEST = 256  # least hashes that are compared before long sets are
LONG = 4 * LOWEST
BLOCK = 1000
BLOCK_BYTES = 32 << 20  # of the sets of a block
MAX_CACHE = 300_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(20)
A = _rng.integers(0, 1 << 31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1)
C = _rng.integers(0, 1 << 32, SYMBOLS, np.uint32)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M2
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, k: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of k words; fewer words: one hash of them all."""
    ws = common.byte_words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    out = h[: len(h) - k + 1]
    for j in range(1, k):
        out = mix(out * M1 + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def signature(s: np.ndarray) -> bytes:
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        low = np.minimum(low, (x[i : i + 1024, None] * A + C).min(0))
    return ((low * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_indexed(similar: int = SIMILAR) -> int:
    """Sets with fewer shingles have only equal sets as partners: n / (n + 1) is under the threshold."""
    return next(n for n in range(1, 1000) if 100 * n >= similar * (n + 1))


FEATURES = "doc_id long, row long, n long, h1 long, h2 long, sig binary"


def set_features(docs: DataFrame, k: int, similar: int = SIMILAR) -> DataFrame:
    least = least_indexed(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in common.chunks(batches):
            if len(words) > MAX_CACHE:
                words.clear()
            n, h, sig = [], [], []
            for t in common.as_bytes(b.column(2)):
                s = shingles(t or b"", k, words)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s)), h.append(d), sig.append(signature(s) if len(s) >= least else None)
            h = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(sig, pa.binary())], names=[c.split()[0] for c in FEATURES.split(", ")])

    return docs.select("doc_id", "row", "text").mapInArrow(run, FEATURES)


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, id): each chunk of the signature with each symbol left out in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, CHUNKS, WIDTH).astype(np.int64)
                keys = []
                for c in range(CHUNKS):
                    for w in range(WIDTH):
                        key = np.full(len(sig), c * WIDTH + w, np.int64)
                        for x in range(WIDTH):
                            if x != w:
                                key = (key << 8) | sig[:, c, x]
                        keys.append(key)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, SYMBOLS))], names=["key", "id"])

    return classes.filter(F.col("sig").isNotNull()).select("id", "sig").mapInArrow(run, "key long, id long")


def shared(keys: DataFrame) -> DataFrame:
    """keys with hub, the least id of each key, for the keys of several ids. The keys are shuffled once; most stand alone and end there."""
    key = W.partitionBy("key")
    return keys.withColumn("hub", F.min("id").over(key)).withColumn("last", F.max("id").over(key)).filter("hub < last").drop("last")


def may_be_similar(n1: int, low1: np.ndarray, n2: int, low2: np.ndarray, similar: int) -> bool:
    """Whether the least hashes of two sets allow the similarity: exactly where both sets are whole, else up to 4.9 deviations."""
    both = np.concatenate([low1, low2])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    if n1 <= LOWEST and n2 <= LOWEST:
        return 100 * len(twice) >= similar * (len(both) - len(twice))
    union = np.unique(both)[:LOWEST]
    need = len(union) * similar / 100
    return (twice <= union[-1]).sum() >= need - 4.9 * np.sqrt(need * (1 - similar / 100)) - 1


def near_signatures(pairs: DataFrame, classes: DataFrame, similar: int, farthest: int = FARTHEST) -> DataFrame:
    """The pairs (a, b) whose set sizes and signatures (up to farthest) allow the similarity."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= similar * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array((x != y).sum(1) <= farthest))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def with_sets(rows: DataFrame, k: int) -> DataFrame:
    """rows with `set`, the sorted hashes of the shingles, in the place of text, the last column."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in common.chunks(batches):
            if len(words) > MAX_CACHE:
                words.clear()
            sets = [shingles(t or b"", k, words).tobytes() for t in common.as_bytes(b.columns[-1])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], names=[*b.schema.names[:-1], "set"])

    return rows.mapInArrow(run, ", ".join([*fields, "set binary"]))


def similar_sets(x: np.ndarray, y: np.ndarray, similar: int, exact: bool) -> bool:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x):
        return False
    if len(x) > LONG and not exact:
        low = [(s[:LOWEST] >> np.uint64(32)).astype(np.uint32) for s in (x, y)]
        if not may_be_similar(len(x), low[0], len(y), low[1], similar):
            return False
    at = np.searchsorted(y, x)
    same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return same > 0 and 100 * same >= similar * (len(x) + len(y) - same)


def join_labels(labels: np.ndarray, x: int, y: int) -> None:
    labels[labels == labels[y]] = labels[x]


def stars(labels: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """(a, b): the components that a label joins, each with the least of them, so that few rounds settle what blocks have found."""
    least = np.full(len(labels), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, comp)
    return list({(int(a), int(b)) for a, b in zip(least[labels], comp, strict=True) if a != b})


def block_links(guest: np.ndarray, minor: np.ndarray, ids: np.ndarray, comp: np.ndarray, size: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], similar: int, exact: bool) -> list[tuple[int, int]]:
    """The components of a block that confirmed links join, as stars; the nearest signatures are checked first."""
    labels = np.unique(comp, return_inverse=True)[1].reshape(-1)
    xs, ys, fars = [], [], []
    for i in range(len(ids) - 1):
        y = np.arange(i + 1, len(ids))
        y = y[may_meet(np.full(len(y), i), y, guest, minor, ids, comp, size, similar)]
        far = (sig[i] != sig[y]).sum(1)
        ok = far <= (SYMBOLS if exact else FARTHEST)
        ys.append(y[ok].astype(np.int32)), fars.append(far[ok].astype(np.uint8)), xs.append(np.full(ok.sum(), i, np.int32))
    if not xs:
        return []
    x, y, far = np.concatenate(xs), np.concatenate(ys), np.concatenate(fars)
    order = far.argsort(kind="stable")
    x, y = x[order], y[order]
    for s in range(0, len(x), 1024):
        a, b = x[s : s + 1024], y[s : s + 1024]
        apart = labels[a] != labels[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if labels[i] != labels[j] and similar_sets(sets[i], sets[j], similar, exact):
                join_labels(labels, i, j)
    return stars(labels, comp)


def confirmed(rows: DataFrame, similar: int, exact: bool) -> DataFrame:
    """(a, b): the components that the confirmed links of each block of rows (MEETING and set) join. A component is named by an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 256):
            key, block, guest, minor, ids, comp, size = (t.column(i).to_numpy() for i in range(7))
            sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            found = []
            for s, e in zip([0, *edges], [*edges, len(key)], strict=True):
                if e - s > 1:
                    sets = [np.frombuffer(x, np.uint64) for x in t.column(8).slice(s, e - s).to_pylist()]
                    found += block_links(guest[s:e], minor[s:e], ids[s:e], comp[s:e], size[s:e], sig[s:e], sets, similar, exact)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    rows = rows.select(*MEETING, "set").repartition("key", "block").sortWithinPartitions("key", "block")
    return rows.mapInArrow(run, "a long, b long").distinct()


def several(named: DataFrame, stages: common.Stages) -> DataFrame:
    """named: (key, id, comp), written. Those whose key has several comps, with most (the key's most common comp), c (its members) and
    others (those outside most)."""
    counts = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    split = counts.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("c")).filter("comps > 1")
    return stages.put(named.join(stages.put(split.select("key", F.col("most.comp").alias("most"), "c", (F.col("c") - F.col("most.c")).alias("others"))), "key"))


def link(docs: DataFrame, classes: DataFrame, k: int, similar: int, stages: common.Stages, exact: bool = False) -> DataFrame:
    """(a, b): pairs that connect all classes that any confirmed link of the index connects, and no others. classes: (id, n, sig), written;
    docs: doc_id and text, among them a row for the id of each class."""
    members = stages.put(shared(index_keys(classes)))
    hubs = members.filter("id != hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    near = stages.put(near_signatures(hubs, classes, similar, SYMBOLS if exact else FARTHEST))
    # for now a member is of its hub's hub's family; what this leaves apart in a bucket is compared there
    up = near.select(F.col("b").alias("a"), F.col("a").alias("top"))
    first = stages.put(near.join(up, "a", "left").select(F.col("b").alias("id"), F.coalesce("top", "a").alias("comp")))
    named = stages.put(members.join(first, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")))
    open_ = several(named, stages)
    family = components(near.union(across(open_, classes, similar, exact)), stages)
    stages.drop(named, open_)

    wanted = family.select(F.col("id").alias("doc_id"))
    # an inner join, as the optimizer would take a semi join below the one with the bitmap; each id stands there once
    texts = stages.put(common.among(docs, wanted, "doc_id").join(wanted, "doc_id").dropDuplicates(["doc_id"]))
    own = stages.put(family.select("id", F.col("comp").alias("key")).join(classes.select("id", F.col("n").alias("size"), "sig"), "id"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("size") / BLOCK_BYTES)).cast("int")
    own = stages.put(own.join(stages.put(own.groupBy("key").agg(blocks.alias("blocks"))), "key"))
    both = lambda df: with_sets(df.join(texts.select(F.col("doc_id").alias("id"), "text"), "id"), k)
    home = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    at = F.when(F.col("id") == F.col("key"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    alone = both(own.select("key", "id", "blocks", F.col("id").alias("comp"), "size", "sig")).withColumn("block", F.explode(at.cast("array<long>")))
    links = stages.put(confirmed(alone.withColumn("guest", F.lit(OWN)).withColumn("minor", F.lit(True)), similar, exact))

    large = own.filter("blocks > 1")
    if large.isEmpty():
        return links
    named = stages.put(large.select("key", "id").join(components(links, stages), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")))
    open_ = several(named, stages)
    if open_.isEmpty():
        return links
    left = both(open_.join(own.select("id", "blocks", "size", "sig"), "id"))
    left = meetings(left, F.col("blocks"), F.ceil(F.col("others") * F.col("blocks") / F.col("c")).cast("int"))
    return stages.put(links.union(confirmed(left, similar, exact)))


def first_meeting(equal: np.ndarray) -> np.ndarray:
    """equal: pairs x SYMBOLS. The least number of an index key under which each pair meets; SYMBOLS if there is none."""
    wrong = ~equal.reshape(-1, CHUNKS, WIDTH)
    errors = wrong.sum(2)
    chunk = (errors <= ERRORS).argmax(1)
    at = np.arange(len(equal))
    return np.where(errors[at, chunk] <= ERRORS, chunk * WIDTH + np.where(errors[at, chunk] == 0, 0, wrong[at, chunk].argmax(1)), SYMBOLS)


MEETING = ("key", "block", "guest", "minor", "id", "comp", "size", "sig")
LIES, GUEST, OWN = 0, 1, 2


def meetings(rows: DataFrame, blocks: Column, chunks: Column) -> DataFrame:
    """rows: (key, id, comp, most) and more. A key's members lie in blocks, its members outside the most common component (the others)
    in chunks as well; a member's block meets every chunk. So no task holds more than a block and a chunk at once, and a key's
    members are sent (number of chunks) times, the others (number of blocks) times more."""
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    rows = rows.withColumn("minor", F.col("comp") != F.col("most"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    lies = F.transform(upto(chunks), lambda m: F.struct(spread(blocks, 1).alias("b"), m.alias("m"), F.lit(LIES).alias("guest")))
    goes = F.transform(upto(blocks), lambda b: F.struct(b.alias("b"), spread(chunks, 2).alias("m"), F.lit(GUEST).alias("guest")))
    rows = rows.withColumn("x", F.explode(F.when(F.col("minor"), F.concat(lies, goes)).otherwise(lies)))
    return rows.withColumn("block", F.col("x.b").cast("long") * 1_000_000_007 + F.col("x.m")).withColumn("guest", F.col("x.guest"))


def may_meet(x: np.ndarray, y: np.ndarray, guest: np.ndarray, minor: np.ndarray, ids: np.ndarray, comp: np.ndarray, size: np.ndarray, similar: int) -> np.ndarray:
    """Whether rows x and y of a block are to be compared there: of different components and of sizes that allow the similarity."""
    # a guest meets those that lie there; of two others the one of lesser id is the guest
    mine = np.where(minor[x] & minor[y], (ids[x] < ids[y]) == (guest[x] == GUEST), True)
    ok = (guest[x] == OWN) | ((guest[x] != guest[y]) & mine)
    return ok & (ids[x] != ids[y]) & (comp[x] != comp[y]) & (100 * np.minimum(size[x], size[y]) >= similar * np.maximum(size[x], size[y]))


def across(open_: DataFrame, classes: DataFrame, similar: int, exact: bool) -> DataFrame:
    """(a, b): components that near signatures of members of a bucket join, by block and chunk, as stars. A component is named by an id."""
    rows = meetings(open_, F.ceil(F.col("c") / BLOCK).cast("int"), F.ceil(F.col("others") / BLOCK).cast("int"))
    rows = rows.join(classes.select("id", F.col("n").alias("size"), "sig"), "id").select(*MEETING).repartition("key", "block").sortWithinPartitions("key", "block")
    farthest = SYMBOLS if exact else FARTHEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            key, block, guest, minor, ids, comp, size = (t.column(i).to_numpy() for i in range(7))
            sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            labels = np.unique(comp, return_inverse=True)[1].reshape(-1)
            for d in range(1, len(ids)):  # rows and those d further in their group
                x = np.flatnonzero((key[d:] == key[:-d]) & (block[d:] == block[:-d]))
                if not len(x):
                    break
                y = x + d
                ok = labels[x] != labels[y]
                x, y = x[ok], y[ok]
                ok = may_meet(x, y, guest, minor, ids, comp, size, similar)
                x, y = x[ok], y[ok]
                ok = (sig[x] != sig[y]).sum(1) <= farthest
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    if labels[i] != labels[j]:
                        join_labels(labels, i, j)
            if found := stars(labels, comp):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.Table]:
    """The sorted rows of a partition in tables that never cut a group of (key, block)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for s in range(0, b.num_rows, rows):
            part = b.slice(s, rows)
            key, block = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            if held:
                last = held[-1]
                new = (key != last.column(0)[-1].as_py()) | (block != last.column(1)[-1].as_py())
            else:
                new = np.ones(len(key), bool)
            ends = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            cut = int(ends[-1]) if len(ends) else (0 if held and new[0] else -1)
            if cut >= 0:
                if held or cut:
                    yield pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks()
                held = [part.slice(cut)]
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(docs: DataFrame, stages: common.Stages, k: int = 2, similar: int = SIMILAR, exact: bool = False) -> DataFrame:
    """docs: doc_id and text. Per row: doc_id, n_shingles, component_id and kept. exact: check all pairs of the index in full."""
    before = set(stages.live)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), "text"))  # rows with the same id and text are one
    rows = stages.put(set_features(docs, k, similar))
    # a class has an id of its own, that of one of its rows, as a document's id may stand in several classes
    classes = rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("id"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.min("doc_id").alias("least"))
    classes = stages.put(classes)
    indexed = classes.filter("sig is not null").select("id", "n", "sig")
    links = link(docs.select(F.col("row").alias("doc_id"), "text"), indexed, k, similar, stages, exact)
    repeated = stages.put(rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x != y").select("doc_id"))
    if not repeated.isEmpty():
        joins = stages.put(rows.filter("n > 0").join(repeated, "doc_id").select("doc_id", "h1", "h2").distinct().join(classes, ["h1", "h2"]).select("doc_id", "id"))
        hubs = joins.groupBy("doc_id").agg(F.min("id").alias("hub"))
        links = links.union(joins.join(hubs, "doc_id").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    named = stages.put(classes.join(components(links, stages), "id", "left").select("h1", "h2", "least", "comp"))
    # what is joined is written, so that a component of very many classes and a class of very many rows can be split
    linked = named.filter("comp is not null")
    least = stages.put(linked.groupBy("comp").agg(F.min("least").alias("component_id")))
    alone = named.filter("comp is null").select("h1", "h2", F.col("least").alias("component_id"))
    component = stages.put(linked.join(least, "comp").select("h1", "h2", "component_id").union(alone))
    stages.clear(rows, component, before=before)
    found = rows.filter("n > 0").join(component, ["h1", "h2"]).select("doc_id", "n", "component_id")
    whole = found.union(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), common.Stages(spark, "op2"))


QUERIES = {"op2_minhash_hamming": op2_minhash_hamming}
SQL = {"op2_minhash_hamming": f"""WITH RECURSIVE w AS (SELECT doc_id, {common.SQL_WORDS} AS w FROM documents),
  g AS (SELECT doc_id, unnest(CASE len(w) WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
  s AS (SELECT DISTINCT doc_id, g FROM g),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {SIMILAR} * (x.n + y.n - i)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""}
