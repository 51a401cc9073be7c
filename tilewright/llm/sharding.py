"""Resharding by minimum-cost flow: rows move from old shards to new capacities, so that the fewest bytes move.

A block is the set of rows of one old shard and one range of sizes. From the blocks' row counts and bytes and the
capacities of the new shards (row counts at most one apart) a flow network is solved on the driver; its size depends on
the numbers of shards and blocks only. Blocks at a cut, where some rows stay and others go, are refined and the flow is solved
again, until those hold rows of one size: then no choice of rows moves fewer bytes. Which of the new shards get the one
row more that the counts may differ by is part of the flow, through spare arcs.

Equal texts form a group, and a group lies in one old shard before (prior_shard()) and in one new shard after. Where a block is
divided among shards, its large groups are dealt first, and the others follow in the order of their hashes up to an exact
row count; a group across the cut goes to a later shard and the next ones take its rows. Only a group that fits into no
shard's part of its block is divided, by its rows' places (Placement.split counts those).

What decides are short broadcast tables and an expression over a row's old shard, size and hashes, so texts are never dealt out: each task writes
its rows to their shards, and a row's slot is its place in the shard's files. Only files of shards that gain or lose
rows are written anew (rewrite()).

Defined results: a null text has no bytes (size 1) and checksum 0, and is equal to the empty text; rows with null
ids and repeated rows are rows like any other; an empty table gives an empty result. Only the id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

N_OLD, N_NEW = 6, 8
FINER = 16  # parts of a block that is refined
LARGE = 256  # a group with more than this part of its block's rows is placed by itself
WINDOW = 4000  # groups at a cut that the driver looks at
Group = tuple[int, int]


def cheapest(n: int, arcs: Sequence[tuple[int, int, int, float]], source: int, sink: int, amount: int) -> list[int]:
    """Units on each arc (from, to, most, cost) of the cheapest flow of amount from source to sink among n nodes.

    Shortest augmenting paths with potentials; each path moves as much as its arcs allow, so the work depends on the arcs and
    not on the units.
    """
    out: list[list[int]] = [[] for _ in range(n)]
    to, room, price = [], [], []
    for u, v, units, c in arcs:
        for x, y, r, p in ((u, v, units, c), (v, u, 0, -c)):
            out[x].append(len(to))
            to.append(y), room.append(r), price.append(p)
    potential, left = [0.0] * n, amount
    while left:
        dist, via = [float("inf")] * n, [-1] * n
        dist[source], queue = 0.0, [(0.0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u] + 1e-12:
                continue
            for a in out[u]:
                if room[a] and (new := d + price[a] + potential[u] - potential[to[a]]) < dist[to[a]] - 1e-9:
                    dist[to[a]], via[to[a]] = new, a
                    heapq.heappush(queue, (new, to[a]))
        if via[sink] < 0:
            raise ValueError("the capacities don't fit the supply")
        reached = max(d for d in dist if d < float("inf"))
        potential = [p + min(d, reached) for p, d in zip(potential, dist, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        units = min(left, *(room[a] for a in path))
        for a in path:
            room[a] -= units
            room[a ^ 1] += units
        left -= units
    return room[1::2]


def min_cost_flow(supply: Sequence[int], capacity: Sequence[tuple[int, int]], cost: Sequence[Sequence[float]]) -> list[list[int]]:
    """Units from each block to each shard at the least cost, all of supply moved.

    capacity: (least, most) units of each shard; sum of least <= sum of supply <= sum of most.
    """
    b, s = len(supply), len(capacity)
    arcs = [(b + s, i, n, 0.0) for i, n in enumerate(supply)] + [(i, b + j, n, cost[i][j]) for i, n in enumerate(supply) for j in range(s)]
    arcs += _shard_arcs(capacity, b, sum(supply), b + s + 1, b + s + 2)
    flow = cheapest(b + s + 3, arcs, b + s, b + s + 1, sum(supply))
    return [flow[b + i * s : b + (i + 1) * s] for i in range(b)]


def _shard_arcs(capacity: Sequence[tuple[int, int]], first: int, total: int, sink: int, extra: int) -> list[tuple[int, int, int, float]]:
    """Arcs to the sink: the least of each shard, and the rest through one more node."""
    floor = sum(c[0] for c in capacity)
    if not floor <= total <= sum(c[1] for c in capacity):
        raise ValueError("the capacities don't fit the supply")
    arcs = [(first + j, sink, c[0], 0.0) for j, c in enumerate(capacity)]
    return arcs + [(first + j, extra, c[1] - c[0], 0.0) for j, c in enumerate(capacity)] + [(extra, sink, total - floor, 0.0)]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


@dataclass(frozen=True, order=True)
class Block:
    """The rows of an old shard with sizes from lo to hi; low and high are the least and greatest among them."""

    old: int
    lo: int
    hi: int
    rows: int
    bytes: int
    low: int
    high: int


def flow_of(blocks: list[Block], n_new: int) -> dict[tuple[Block, int], int]:
    """Rows of each block to each shard: counts at most one apart, fewest bytes. What a move costs doesn't depend on where it goes,
    so all moves from an old shard pass one node."""
    total = sum(b.rows for b in blocks)
    least, more = divmod(total, n_new)
    olds = sorted({b.old for b in blocks})
    nb = len(blocks)
    leave = {o: nb + k for k, o in enumerate(olds)}
    first = nb + len(olds)
    source, sink, extra = first + n_new, first + n_new + 1, first + n_new + 2
    arcs = [(source, i, b.rows, 0.0) for i, b in enumerate(blocks)] + [(i, leave[b.old], b.rows, b.bytes / b.rows) for i, b in enumerate(blocks)]
    arcs += [(i, first + b.old, b.rows, 0.0) for i, b in enumerate(blocks) if b.old < n_new]
    across = [(o, j) for o in olds for j in range(n_new) if o != j]
    arcs += [(leave[o], first + j, total, 0.0) for o, j in across]
    flow = cheapest(first + n_new + 3, arcs + _shard_arcs([(least, least + (more > 0))] * n_new, first, total, sink, extra), source, sink, total)
    go = {b: flow[nb + i] for i, b in enumerate(blocks)}
    rest = dict(zip(across, flow[len(arcs) - len(across) : len(arcs)], strict=True))
    out = {}
    for b in blocks:
        if b.rows > go[b]:
            out[b, b.old] = b.rows - go[b]
        n = go[b]
        for j in range(n_new):
            if n and (units := min(n, rest.get((b.old, j), 0))):
                out[b, j] = units
                rest[b.old, j] -= units
                n -= units
    return out


def coarse(blocks: list[Block], flow: dict[tuple[Block, int], int]) -> list[Block]:
    """Blocks of several sizes at a cut: some rows stay and others go, or they lie next to where that changes."""
    out = set()
    for b in blocks:
        stays = flow.get((b, b.old), 0)
        if 0 < stays < b.rows:
            out.add(b)
    for o in {b.old for b in blocks}:
        own = sorted(b for b in blocks if b.old == o)
        for x, y in zip(own, own[1:], strict=False):
            if not flow.get((x, o), 0) and flow.get((y, o), 0):
                out |= {x, y}
    return sorted(b for b in out if b.low < b.high)


@dataclass
class Division:
    """How a block's groups go to shards: those named first, the others in hash order up to each cut."""

    named: dict[Group, int] = field(default_factory=dict)
    split: dict[Group, list[tuple[Group, int]]] = field(default_factory=dict)  # cuts among a group's rows; the last has none
    cuts: list[tuple[Group, int]] = field(default_factory=list)
    last: int = 0

    def column(self) -> Column:
        """Where a row goes whose group isn't named; as long as there are cuts and split groups, which are few."""
        upto = lambda x, y, at: (F.col(x) < at[0]) | ((F.col(x) == at[0]) & (F.col(y) <= at[1]))
        out = F.lit(self.last)
        for at, j in reversed(self.cuts):
            out = F.when(upto("_g1", "_g2", at), j).otherwise(out)
        for g, parts in self.split.items():
            own = F.lit(parts[-1][1])
            for at, j in reversed(parts[:-1]):
                own = F.when(upto("_r1", "_r2", at), j).otherwise(own)
            out = F.when((F.col("_g1") == g[0]) & (F.col("_g2") == g[1]), own).otherwise(out)
        return out


def cut_at(pool: DataFrame, need: int) -> tuple[Group, list[tuple[Group, int]], int]:
    """pool (u1, u2, n): the pair up to which, in order, n adds up to need, without the pairs passed over as they are too large, and
    what is missing where all are. Counts by the leading bits of u1 lead to the WINDOW pairs that the driver reads."""
    lo, base, shift = -(1 << 63), 0, 64
    while True:
        shift -= 12
        at = F.shiftright("u1", max(shift, 0)) if shift > 0 else F.col("u1")
        near = pool.filter(F.col("u1") >= lo) if shift == 52 else pool.filter(F.col("u1").between(lo, lo + (1 << shift + 12) - 1))
        bins = sorted(near.groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect())  # 4,096 at most
        for b in bins:
            if base + b.n >= need:
                lo = b.b << max(shift, 0)
                break
            base += b.n
        if b.c <= WINDOW // 2 or shift <= 0:
            break
    passed, end, left = [], (lo, -(1 << 63)), need - base
    for r in pool.filter(F.col("u1") >= lo).orderBy("u1", "u2").limit(WINDOW).collect():
        if not left:
            break
        if r.n <= left:
            left -= r.n
            end = (r.u1, r.u2)
        else:
            passed.append(((r.u1, r.u2), r.n))
    return end, [x for x in passed if x[0] < end], left


def divide(groups: DataFrame, rows: DataFrame, quotas: list[tuple[int, int]]) -> Division:
    """Deals a block's groups (_g1, _g2, n) to shards by exact row counts. quotas: (shard, rows); rows: the block's rows with _r1, _r2."""
    total = sum(q for _, q in quotas)
    room, out = dict(quotas), Division(last=quotas[-1][0])

    def place(g: Group, n: int, among: list[int]) -> None:
        fits = [j for j in among if room[j] >= n]
        if fits:
            j = min(fits, key=lambda j: (room[j], j))
            out.named[g], room[j] = j, room[j] - n
            return
        parts, pool = [], rows.filter((F.col("_g1") == g[0]) & (F.col("_g2") == g[1])).select(F.col("_r1").alias("u1"), F.col("_r2").alias("u2"), F.lit(1).alias("n"))
        for j in sorted(among, key=lambda j: -room[j]):
            take = min(n, room[j])
            if take:
                n, room[j] = n - take, room[j] - take
                before = sum(p[2] for p in parts) + take
                parts.append((cut_at(pool, before)[0] if n else (0, 0), j, take))
        out.split[g] = [(at, j) for at, j, _ in parts]

    large = groups.filter(F.col("n") > max(1, total // LARGE)).orderBy(F.desc("n"), "_g1", "_g2").collect()  # LARGE at most
    for r in large:
        place((r._g1, r._g2), r.n, [j for j, _ in quotas])
    pool = groups.filter(F.col("n") <= max(1, total // LARGE)).select(F.col("_g1").alias("u1"), F.col("_g2").alias("u2"), "n")
    open_ = [j for j, _ in quotas if room[j]]
    for k, j in enumerate(open_[:-1]):
        if not room[j]:
            continue
        end, passed, left = cut_at(pool, room[j])
        room[j] = left
        out.cuts.append((end, j))
        later = open_[k + 1 :]
        for g, n in passed:
            place(g, n, later if not left else [j, *later])
        after = (F.col("u1") > end[0]) | ((F.col("u1") == end[0]) & (F.col("u2") > end[1]))
        pool = pool.filter(after)
    out.last = open_[-1] if open_ else out.last
    return out


@dataclass
class Placement:
    blocks: list[tuple[Block, int | None]]  # None: divided
    divisions: list[tuple[Block, Division]]

    @property
    def split(self) -> int:
        """Groups that lie in several shards."""
        return sum(len(d.split) for _, d in self.divisions)

    def of(self, rows: DataFrame) -> DataFrame:
        """rows (_old, _size and hashes) with their shard. The tables that are broadcast have a row for each block, and for each named
        group: LARGE and WINDOW of each cut at most."""
        table = rows.sparkSession.createDataFrame([(b.old, b.lo, b.hi, j) for b, j in self.blocks], "_o int, _lo long, _hi long, _to int")
        hit = (F.col("_old") == F.col("_o")) & F.col("_size").between(F.col("_lo"), F.col("_hi"))
        shard = F.col("_to")
        for b, d in self.divisions:
            shard = F.when(F.col("_to").isNull() & (F.col("_o") == b.old) & (F.col("_lo") == b.lo), d.column()).otherwise(shard)
        out = rows.join(F.broadcast(table), hit)
        if named := [(*g, j) for _, d in self.divisions for g, j in d.named.items()]:
            names = rows.sparkSession.createDataFrame(named, "_n1 long, _n2 long, _nj int")
            out = out.join(F.broadcast(names), (F.col("_g1") == F.col("_n1")) & (F.col("_g2") == F.col("_n2")), "left")
            shard = F.coalesce("_nj", shard)
        return out.withColumn("shard", shard.cast("int")).drop("_o", "_lo", "_hi", "_to", "_n1", "_n2", "_nj")


def hashed(df: DataFrame, old_shard: Column, size: Column, group: Column, place: Column) -> DataFrame:
    """df with _old, _size, the 128-bit hash of the row's group, and one of its place among the files."""
    g = lambda seed: F.xxhash64(F.lit(seed), F.coalesce(group.cast("string"), F.lit("")))
    r = lambda seed: F.xxhash64(F.lit(seed), place)
    return df.select("*", old_shard.cast("int").alias("_old"), size.cast("long").alias("_size"), g(1).alias("_g1"), g(2).alias("_g2"), r(3).alias("_r1"), r(4).alias("_r2"))


def solve(rows: DataFrame, n_new: int, stages: common.Stages) -> Placement:
    """Where the rows (_old, _size, _g1, _g2, _r1, _r2; written) go. No texts are read."""
    groups = stages.put(rows.groupBy("_old", "_size", "_g1", "_g2").agg(F.count("*").alias("n")))
    sizes = stages.put(groups.groupBy("_old", "_size").agg(F.sum("n").alias("n")))

    def blocks_in(ranges: list[tuple[int, int, int]]) -> list[Block]:
        table = rows.sparkSession.createDataFrame(ranges, "old int, lo long, hi long")
        hit = sizes.join(F.broadcast(table), (F.col("_old") == F.col("old")) & F.col("_size").between(F.col("lo"), F.col("hi")))
        found = hit.groupBy("old", "lo", "hi").agg(F.sum("n"), F.sum(F.col("n") * F.col("_size")), F.min("_size"), F.max("_size")).collect()
        return sorted(Block(*r) for r in found)

    olds = [r._old for r in sizes.select("_old").distinct().collect()]  # as many as there are shards
    blocks = blocks_in([(o, 1 << k, (2 << k) - 1) for o in olds for k in range(62)]) if olds else []
    while blocks and (rough := coarse(blocks, flow := flow_of(blocks, n_new))):
        step = lambda b: -(-(b.high - b.low + 1) // FINER)
        finer = [(b.old, x, min(x + step(b) - 1, b.high)) for b in rough for x in range(b.low, b.high + 1, step(b))]
        blocks = sorted([*(b for b in blocks if b not in rough), *blocks_in(finer)])
    to: dict[Block, list[tuple[int, int]]] = defaultdict(list)
    for (b, j), n in (flow.items() if blocks else ()):
        to[b].append((j, n))
    out = Placement([(b, x[0][0] if len(x) == 1 else None) for b, x in to.items()], [])
    for b, x in to.items():
        if len(x) > 1:
            own = (F.col("_old") == b.old) & F.col("_size").between(b.lo, b.hi)
            out.divisions.append((b, divide(groups.filter(own), rows.filter(own), x)))
    return out


def reshard(df: DataFrame, old_shard: Column, size: Column, group: Column, n_new: int, stages: common.Stages) -> tuple[DataFrame, DataFrame, Placement]:
    """df, which is read from files, with old_shard and shard (0 to n_new - 1); the same of each row without df's columns, with size;
    and the placement. Old shards are whole numbers; those from n_new on vanish. size: 1 at least."""
    place = F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    own = [c for c in df.columns if c not in ("old_shard", "shard", "_metadata")]
    whole = hashed(df.select(*own, place.alias("_place")), old_shard, size, group, F.col("_place"))
    rows = stages.put(whole.select("_old", "_size", "_g1", "_g2", "_r1", "_r2"))
    placement = solve(rows, n_new, stages)
    short = placement.of(rows).select(F.col("_old").alias("old_shard"), F.col("_size").alias("size"), "shard")
    return placement.of(whole).select(*own, F.col("_old").alias("old_shard"), "shard"), short, placement


def moved(assigned: DataFrame, size: str = "size") -> DataFrame:
    """Per shard, old ones that vanish included: rows and bytes that come, rows that go, and whether its file has to be written anew."""
    stay = F.col("old_shard") == F.col("shard")
    come = assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), F.count_if(~stay).alias("rows_in"), F.sum(F.when(~stay, F.col(size)).otherwise(0)).alias("bytes_in"))
    go = assigned.groupBy(F.col("old_shard").alias("shard")).agg(F.count_if(~stay).alias("rows_out"))
    out = come.join(go, "shard", "full_outer").fillna(0)
    return out.withColumn("rewritten", (F.col("rows_in") > 0) | (F.col("rows_out") > 0))


def rewrite(assigned: DataFrame, change: DataFrame, path: str) -> None:
    """Brings the shards below path, a folder shard=N each, to what assigned says; change: moved().

    Shards that gain or lose rows, and those that aren't there yet, are written beside and then take their folder's place; emptied
    ones go; the files of all others stay as they are. assigned may be read from path itself.
    """
    spark = assigned.sparkSession
    path = path.rstrip("/")
    fs, at = common.file_system(spark, path)
    old = {str(f.getPath().getName()) for f in fs.listStatus(at)} if fs.exists(at) else set()
    rows = {r.shard: (r.n_rows, r.rewritten) for r in change.collect()}  # as many as there are shards
    write = [j for j, (n, new) in rows.items() if n and (new or f"shard={j}" not in old)]
    beside = f"{path}/.new-{uuid.uuid4().hex}"
    # no deal by shard: each task writes its rows, so that texts don't take the disk once more
    assigned.filter(F.col("shard").isin(write)).write.option("compression", "zstd").partitionBy("shard").parquet(beside)
    for j in [*write, *(j for j, (n, _) in rows.items() if not n)]:
        target = common.file_system(spark, f"{path}/shard={j}")[1]
        fs.delete(target, True)
        if rows[j][0] and not fs.rename(common.file_system(spark, f"{beside}/shard={j}")[1], target):
            raise OSError(f"shard {j} is written below {beside} and can't be moved")
    fs.delete(common.file_system(spark, beside)[1], True)


def read_shards(spark: SparkSession, path: str, schema: str, *columns: str | Column) -> DataFrame:
    """columns (default: all) of the rows of the shards below path, with shard and slot: a row's place in its shard, through the files by
    name. The columns are dealt out to find the slot, so texts are better left out of them."""
    rows = spark.read.schema(f"{schema}, shard int").parquet(path)
    rows = rows.select(*(columns or rows.columns[:-1]), "shard", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("shard", "_file").agg(F.count("*").alias("n"))  # a row for each file
    before = F.sum("n").over(W.partitionBy("shard").orderBy("_file").rowsBetween(W.unboundedPreceding, -1))
    files = files.select(F.col("shard").alias("_s"), F.col("_file").alias("_f"), F.coalesce(before, F.lit(0)).alias("_first"))
    both = rows.join(files, (F.col("shard") == F.col("_s")) & (F.col("_file") == F.col("_f")))
    return both.withColumn("slot", F.col("_first") + F.col("_at")).drop("_s", "_f", "_first", "_file", "_at")


def prior_shard(text: Column, n_old: int = N_OLD) -> Column:
    """Where a row lies before: by a hash of its text, so that equal texts lie together; null counts as empty."""
    return F.pmod(F.xxhash64(F.lit(7), F.coalesce(text, F.lit(""))), F.lit(n_old)).cast("int")


def digest(docs: DataFrame, stages: common.Stages) -> DataFrame:
    """docs (doc_id, text), read from files, from N_OLD to N_NEW shards under the law of rows, written with their texts below
    stages.root/shards, which stays; what it returns is read back from there. groups_split: texts whose copies lie in several shards."""
    before, text = set(stages.live), F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), "_metadata")
    assigned, short, placement = reshard(rows, prior_shard(F.col("text")), text_bytes(F.col("text")) + 1, F.col("text"), N_NEW, stages)
    path = f"{stages.root}/shards"
    rewrite(assigned.select("doc_id", "text", "old_shard", "shard"), moved(short), path)
    stages.clear(before=before)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    size = (text_bytes(F.col("text")) + 1).alias("size")
    out = read_shards(docs.sparkSession, path, "doc_id long, text string, old_shard int", "doc_id", size, crc, "old_shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", F.lit(placement.split).alias("groups_split"))


def op7_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), common.Stages(spark, "op7"))


QUERIES = {"op7_flow_resharding": op7_flow_resharding}
SQL: dict[str, str] = {}
