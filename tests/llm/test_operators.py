"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its defined results on odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import common, components, decontaminate, media, minhash, mixing, packing, quality, sharding, suffix_dedup, toxicity, url_filter

from ..conftest import SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka lo mi nu re so ta vu".split() for b in "ban cil dor fes gim hul".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, clashing columns."""
    rng = random.Random(1)
    long, again = prose(rng, 4000), prose(rng, 60)
    texts = [None, "", " \t\n", "one", "One two", long, long, again, again, None]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 7, None]
    df = frame(spark, texts, ["a", "a", None, "b", "b", "a", "b", None, None, "a"], ids)
    return df.union(df.filter("doc_id = 7")).withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("shard", F.lit(0))


@pytest.fixture
def stages(spark):
    return common.Stages(spark, "test")


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# --- 1: mixing


def fill(sizes: dict, weights=(3, 1, 2), share=1.5):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target, full = {s: 0.0 for s in order}, set()
    rest = total
    while rest > 1e-9:
        open_ = [s for s in order if s not in full]
        if not open_:
            break
        k = sum(w[s] for s in open_)
        for s in open_:
            target[s] += rest * w[s] / k
        rest = 0.0
        for s in open_:
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def test_mixing(spark, stages):
    rng = random.Random(2)
    names = ["b", "é", "a", None, "Z", "c"]
    texts = [prose(rng, int(rng.paretovariate(1.1) * 8) % 900 + 1) for _ in range(700)]
    sources = [names[min(int(rng.expovariate(0.7)), 5)] for _ in texts]
    df = frame(spark, texts, sources)
    out = mixing.mix(df, stages)
    rows = out.collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(t.split())
    want = fill(dict(sizes))
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.02 * want[s] + 8
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 and r["size"] == len(r.text.split()) for r in rows)
    again = mixing.mix(df.repartition(7), common.Stages(spark, "again")).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    # the tilt solves the dual: rates sum to the target, and log-odds are linear in the size
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert math.isclose(sum(r.rate * r["size"] for r in own), want[s], rel_tol=1e-4)
        slopes = {round(math.log(r.rate / (2 - r.rate)) / r["size"], 6) for r in own if 1e-6 < r.rate < 2 - 1e-6 and r["size"]}
        assert not slopes or max(slopes) - min(slopes) < 1e-4


def test_mixing_carries_any_column(spark, stages):
    df = frame(spark, [prose(random.Random(i), i % 9) for i in range(60)], ["ab"[i % 2] for i in range(60)])
    names = ["lam", "_mean", "_edge", "_steps", "_at", "_s", "row", "_state", "n"]
    for n in names:
        df = df.withColumn(n, F.lit(n))
    rows = mixing.mix(df, stages).collect()
    assert len(rows) == 60 and {tuple(r[n] for n in names) for r in rows} == {tuple(names)}


def test_mixing_odd(spark, odd, stages):
    rows = mixing.mix(odd, stages).collect()
    assert len(rows) == odd.count() and {r.doc_id: r["size"] for r in rows}[0] == 0
    assert mixing.mix(spark.createDataFrame([], EMPTY), stages).count() == 0


# --- 2: near-duplicates


def groups(sets: dict) -> dict:
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def word_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, stages, k):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 2, 4, 6, 9, 30, 120])) for _ in range(60)]
    for _ in range(160):  # chains of edits, at every distance
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(1, 2 + len(w) // 12)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [None, "", " ", texts[5].upper(), texts[9]]
    sets = {i: word_set(t, k) for i, t in enumerate(texts)}
    want = groups(sets)
    rows = minhash.near_duplicates(frame(spark, texts), stages, k).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in rows)


def test_near_duplicates_odd(spark, odd, stages):
    rows = minhash.near_duplicates(odd, stages).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None] == [(0, None, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], EMPTY), stages).count() == 0


def test_near_duplicates_of_long_texts(spark):
    """Recall over pairs at and above the threshold whose sets are longer than the hashes that are kept of each."""
    rng = random.Random(36)
    texts = []
    for _ in range(60):
        w = prose(rng, rng.randrange(300, 1500)).split()
        texts.append(" ".join(w))
        for share in (0.05, 0.053, 0.055, 0.057, 0.06):  # of words changed: similarities about the threshold
            x = list(w)
            for i in rng.sample(range(len(x)), int(len(x) * share)):
                x[i] = prose(rng, 1)
            texts.append(" ".join(x))
    sets = {i: word_set(t, 2) for i, t in enumerate(texts)}
    want = groups(sets)
    for exact in (False, True):
        rows = minhash.near_duplicates(frame(spark, texts), common.Stages(spark, "long"), exact=exact).collect()
        got = {r.doc_id: r.component_id for r in rows}
        linked = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
        found = sum(got[a] == got[b] for a, b in linked) / len(linked)
        assert len(linked) > 200 and found == 1.0 and all(want[a] == want[c] for a, c in got.items())


@pytest.mark.parametrize("exact", [False, True])
def test_buckets_without_a_common_component(spark, stages, monkeypatch, exact):
    """Members of one bucket that are alike but mostly not similar, in blocks and chunks of a few rows."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(37)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(70):
        x = list(base)
        for i in rng.sample(range(60), rng.choice([1, 3, 4, 5, 6])):
            x[i] = prose(rng, 1)
        texts.append(" ".join(x))
    want = groups({i: word_set(t, 2) for i, t in enumerate(texts)})
    assert 5 < len(set(want.values())) < 65
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), stages, exact=exact).collect()} == want


def test_an_id_with_several_texts(spark, stages):
    rng = random.Random(38)
    a, b, c = (prose(rng, 40) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "end"])
    df = frame(spark, [a, b, near(a), near(b), c, near(c), near(c) + " more"], ids=[0, 0, 5, 6, None, 8, 9])
    rows = minhash.near_duplicates(df, stages).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(0, 0), (5, 0), (6, 0), (None, 8), (8, 8), (9, 8)}
    assert sum(r.kept for r in rows) == 3


def test_index_guarantee():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (400, minhash.SYMBOLS), dtype=np.uint8)
    y = x.copy()
    for row in y:
        at = rng.permutation(minhash.SYMBOLS)[: rng.integers(0, minhash.DISTANCE + 1)]
        row[at] += 1
    assert (minhash.first_meeting(x == y) < minhash.SYMBOLS).all()


def test_components(spark, stages):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 440)]
    got = {r.id: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long"), stages).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n), todo.append(n)
        assert got[start] == min(seen)


# --- 3: media


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(6)
    for n in (0, 1, 191, 192, 193, 5000):
        p = media.payload_of(bytes(rng.integers(32, 100, n, dtype=np.uint8)))
        assert media.decode_png(media.encode_png(p)).tobytes() == p and len(p) % 192 == 0 and p
    repeated = media.payload_of(b"abcdefgh" * 2000)
    assert media.decode_png(media.encode_png(repeated)).tobytes() == repeated
    for colour, c in media.CHANNELS.items():
        a = rng.integers(0, 256, (12, 5 * c), dtype=np.uint8)
        lines = np.zeros((12, 5 * c + 1), np.uint8)
        for y in range(12):
            k = y % 5
            lines[y, 0] = k
            for x in range(5 * c):
                left, up = int(a[y, x - c]) if x >= c else 0, int(a[y - 1, x]) if y else 0
                corner = int(a[y - 1, x - c]) if y and x >= c else 0
                p = left + up - corner
                guess = [0, left, up, (left + up) // 2, min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]][k]
                lines[y, x + 1] = (int(a[y, x]) - guess) & 255
        head = __import__("struct").pack(">IIBBBBB", 5, 12, 8, colour, 0, 0, 0)
        png = media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"IDAT", zlib.compress(lines.tobytes())) + media.chunk(b"IEND", b"")
        assert (media.decode_png(png).reshape(12, -1) == a).all()
    bad = bytearray(media.encode_png(repeated))
    bad[60] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(bad))


def test_media_columns(spark, odd):
    texts = {}
    for r in odd.collect():
        texts[r.doc_id] = (r.text or "").encode()
    stored = media.encode(odd)
    for r in media.features(stored).collect():
        p = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    rows = media.features(stored).collect()
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (5, 6)}) == 1
    back = media.restore(stored).collect()
    assert {r.doc_id: r.text for r in back}[4] == "One two"
    assert media.features(media.encode(spark.createDataFrame([], EMPTY))).count() == 0


def test_media_of_a_text_longer_than_a_chunk(spark):
    text = "".join(random.Random(40).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .", k=3_000_000))
    assert len(media.encode_png(media.payload_of(text.encode()))) > 2 * media.IDAT_BYTES
    row = media.features(media.encode(frame(spark, [text]))).collect()[0]
    p = media.payload_of(text.encode())
    assert (row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


# --- 4: repeated strings


def covered(texts, n=400):
    at = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            at[t[p : p + n]].append((i, p))
    out = [bytearray(len(t)) for t in texts]
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                out[i][p : p + n] = b"\1" * n
    return out


def test_repeated_strings(spark, stages):
    rng = random.Random(7)
    passage = [prose(rng, n) for n in (45, 50, 60, 90)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passage)
            cut = rng.randrange(0, 120)
            parts.insert(rng.randrange(len(parts) + 1), p[cut:] if rng.random() < 0.5 else p[: len(p) - cut])
        texts.append(" ".join(parts))
    texts += ["a" * 900, "ab" * 450, texts[3], texts[3] + "x", "y" + texts[4][10:] + "z", passage[3][:400], passage[3][1:401], passage[3][:399], "é" * 250, None, "", prose(rng, 3000)]
    texts.append(texts[-1][500:9000])
    raw = [(t or "").encode() for t in texts]
    want = covered(raw)
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), stages, with_bytes=True).collect()}
    for i, (t, c) in enumerate(zip(raw, want, strict=True)):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        n_spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(c), n_spans, hashlib.sha256(kept).hexdigest()), i
        assert r.shortened == any(c)


def sharing(texts: dict) -> set:
    """The ids of documents with 51 words in a row that another document has too."""
    at = defaultdict(set)
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        for k in range(len(w) - 50):
            at[tuple(w[k : k + 51])].add(i)
    return {i for ids in at.values() if len(ids) > 1 for i in ids}


def test_shared_passages(spark, stages):
    rng = random.Random(44)
    short = lambda n: " ".join(rng.choice("a b c d ef gh".split()) for _ in range(n))
    passages = [short(n) for n in (49, 50, 51, 52, 60)] + [prose(rng, n) for n in (50, 51, 80)]
    texts = {}
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages) if i % 2 else "")
        if i % 7 == 0:
            parts = [p.upper().replace(" ", rng.choice([" \n", "\t", "  "])) for p in parts]
        texts[i] = " ".join(parts)
    twice = prose(rng, 55)
    texts |= {70: short(51), 71: None, 72: "", 73: twice + " x " + twice, 74: "é" * 300_000 + " " + passages[4], 75: prose(rng, 60_000) + " " + passages[3] + " " + prose(rng, 100)}
    texts |= {76: short(55), 80: prose(rng, 50), 81: prose(rng, 51)}
    texts |= {82: texts[80], 83: texts[81], 84: texts[76]}
    rows = {r.doc_id: r.shared for r in suffix_dedup.remove_repeats(frame(spark, list(texts.values()), ids=list(texts)), stages).collect()}
    want = sharing(texts)
    assert {i for i, s in rows.items() if s} == want and 20 < len(want) < 50 and {74, 75, 76, 81} <= want and not {70, 73, 80} & want


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 64)
    rng = random.Random(45)
    words = ["".join(rng.choices("abcXYZé", k=rng.choice([1, 2, 9, 60, 130]))) for _ in range(80)]
    text = "".join(rng.choice(words) + rng.choice([" ", "\n\t ", "  "]) for _ in range(900)).encode()
    h, at = suffix_dedup.words_of(np.frombuffer(text, np.uint8))
    plain = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    assert len(h) == len(plain) and all(text[a:].lower().startswith(w) for a, w in zip(at, plain, strict=True))
    by = defaultdict(set)
    for w, x in zip(plain, h.tolist(), strict=True):
        by[w].add(x)
    assert len(set.union(*by.values())) == len(by) and all(len(x) == 1 for x in by.values())


def test_repeated_strings_of_all_small_documents(spark, stages):
    """Every document of the smallest tables, by positions of all strings of 400 bytes."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, stages).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for (i, t), c in zip(texts.items(), covered(list(texts.values())), strict=True):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        n_spans = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(t), sum(c), n_spans, hashlib.sha256(kept).hexdigest())
    assert {i for i, r in rows.items() if r.shared} == sharing({r.doc_id: r.text for r in docs.collect()})


def test_repeats_across_pieces_of_a_long_text(spark, stages):
    rng = random.Random(39)
    a, b = prose(rng, 100)[:900], prose(rng, 100)[:700]
    long = prose(rng, 110_000)[: suffix_dedup.PIECE + 3000]
    at = suffix_dedup.PIECE - 450
    text = long[:at] + a + long[at : at + 1200] + b + long[at + 1200 :]
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, [text, "x " + a, b + " y"]), stages, with_bytes=True).collect()}
    assert [(s.start, s.end) for s in rows[0].spans] == [(at, at + 900), (at + 2100, at + 2800)]
    assert rows[0].kept.decode() == long and rows[1].kept == b"x " and rows[2].kept == b" y"


def test_repeated_strings_odd(spark, odd, stages):
    rows = suffix_dedup.remove_repeats(odd, stages).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in rows}
    assert got[5][0] == got[5][1] > 0 and got[0] == (0, 0) and got[3] == (3, 0)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY), stages).count() == 0


# --- 5: packing


def test_best_fit_against_loop():
    rng = random.Random(8)
    for _ in range(30):
        width, lengths = 50, [rng.randrange(1, 51) for _ in range(80)]
        rows = packing.best_fit(lengths, width)
        rooms = []
        for i in sorted(range(80), key=lambda i: (-lengths[i], i)):
            fit = [r for r in rooms if r >= lengths[i]]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - lengths[i])
            else:
                rooms.append(width - lengths[i])
        assert sorted(width - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)
        assert sorted(i for r in rows for i in r) == list(range(80))


def test_packing(spark, odd):
    packed = packing.pack(odd, 512, group=2000)
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    rows = packed.collect()
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<i4"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 512 and len(r.cu_seqlens) == r.n_segments + 1
        assert all((pos[s:e] == np.arange(e - s)).all() for s, e in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False))
    back = defaultdict(dict)
    n = Counter()
    for r in packing.unpack(packed).collect():
        back[r.doc_id][r.doc_offset] = r.bytes
        n[r.doc_id, r.doc_offset] += 1
    assert {d: b"".join(v for _, v in sorted(p.items())) for d, p in back.items()} == texts and n[7, 0] == 4
    raw = packing.ranks(spark)
    assert packing.ranks(spark, f"file://{packing.RANKS}") == raw
    with pytest.raises(Exception, match="nowhere"):
        packing.ranks(spark, "/nowhere")
    enc, cache = packing.encoding(raw), packing.Pieces(raw)
    for t in ("Hello  world's 12 é\n\n x", "", " a\u00a0b ", "<|endoftext|>", "".join(map(chr, range(128))), "a \x1c b\x1f\x1f c\t\t\td  \n ", "x\x85y \u2003z ½²"):
        assert cache.ids(t).tolist() == enc.encode_ordinary(t)
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


# --- 6 and 8: classifiers


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_held_out():
    rng = random.Random(9)
    bad = ["grumlat", "grumpo", "zorkk"]
    texts, y = [], []
    for _ in range(500):
        w = prose(rng, rng.randrange(5, 80)).split()
        y.append(int(rng.random() < 0.3))
        if y[-1]:
            for _ in range(3):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad) + rng.choice(["", "a", "um", "."]))
        texts.append(" ".join(w))
    model = toxicity.fit(texts[:400], np.array(y[:400], float))
    m = model.margins(texts[400:] + ["", "x"], toxicity.Vocabulary())
    assert np.mean((m[:100] >= 0) == np.array(y[400:])) >= 0.95 and np.isfinite(m).all()


def test_toxicity_learns_from_whole_texts():
    rng = random.Random(34)
    long = lambda n: prose(rng, n).split()
    texts, y = [], []
    for i in range(160):  # the one bad word stands anywhere in far more than a block of words
        w = long(toxicity.BLOCK + 300)
        y.append(i % 2)
        if i % 2:
            w[rng.randrange(len(w))] = "grumlat"
        texts.append(" ".join(w))
    model = toxicity.fit(texts[:120], np.array(y[:120], float))
    m = model.margins(texts[120:], toxicity.Vocabulary())
    assert np.mean((m >= 0) == np.array(y[120:])) >= 0.9


def test_pooling_against_loops():
    rng = np.random.default_rng(35)
    parts = [[rng.standard_normal((50, 4)).astype(np.float32) for _ in range(w)] for w in (1, 2, 3)]
    for n in (1, 2, 7, toxicity.BLOCK - 1, toxicity.BLOCK, toxicity.BLOCK + 2, 2 * toxicity.BLOCK + 1):
        ids = rng.integers(0, 50, n)
        want = [[max(0.0, max(sum(float(p[k][ids[i + k], f]) for k in range(len(p)) if i + k < n) for i in range(n))) for f in range(4)] for p in parts]
        assert np.allclose(toxicity._one(ids, parts), np.concatenate(want), atol=1e-4)
        zero = [[np.vstack([np.zeros((1, 4), np.float32), t]) for t in p] for p in parts]
        flat = np.concatenate([ids + 1, [0] * 3, ids[: n // 2] + 1, [0] * 3])
        values, at = toxicity._pool(flat, np.array([0, n + 3]), zero)
        assert np.allclose(np.maximum(values[0], 0), np.concatenate(want), atol=1e-4) and (at[0] < n + 3).all() and (at[1] >= n + 3).all()


def test_toxicity_bounds_choose_rows(spark):
    df = frame(spark, [prose(random.Random(i), 10 if i % 2 else 400) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(200)], "doc_id long, toxic int")
    whole = {r.doc_id: r.text for r in df.collect()}
    rows = toxicity.training_rows(df, labels, 1000, 60_000).collect()
    assert all(r.text == whole[r.doc_id] for r in rows) and 20 < len(rows) < 140
    for y in (0, 1):
        assert 20_000 < sum(len(r.text) for r in rows if r.y == y) <= 30_000


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = toxicity.train(odd, labels.filter("false"))
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(spark.createDataFrame([], EMPTY), none).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows of a label than a sample held, a repeated row, several blocks: each row is learned from or cuts once, and the model
    doesn't depend on the division of the input."""
    rng = random.Random(36)
    texts = [prose(rng, 6) + (" grumlat" if i % 40 == 0 else "") for i in range(4200)]
    df = frame(spark, texts)
    df = df.union(df.filter("doc_id = 1"))
    labels = spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(4200)], "doc_id long, toxic int")
    known = [i for i in [*range(4200), 1] if not held(i)]
    assert sorted(r.doc_id for r in toxicity.training_rows(df, labels).collect()) == sorted(known)
    packed = [toxicity.Block.unpack([r[c] for c in toxicity.PACKED]) for r in toxicity.blocks(df, labels, 3).collect()]
    assert len(packed) == 3 and sum(len(b.ids) for b in packed) == len(known) and sum(b.y.sum() for b in packed) == sum(i % 40 == 0 for i in known)
    learned, cuts = (sum(f(b) for b in packed) for f in (lambda b: toxicity.slot_counts(b).reshape(2, -1)[:, -1].sum(), lambda b: (~b.fold).sum()))
    assert learned == cuts and 0.15 < 1 - learned / len(known) < 0.25
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 1200)
    one, two = toxicity.train(df, labels), toxicity.train(df.repartition(5), labels.repartition(3))
    assert (one.emb == two.emb).all() and (one.out == two.out).all() and (one.cuts == two.cuts).all()
    wrong = toxicity.score(df, one).filter((F.col("predicted") == 1) != (F.col("doc_id") % 40 == 0)).count()
    assert wrong < 20


def test_toxicity_labels_meet_ids_of_other_types(spark):
    """Narrower ids, labels beyond their range, null ids, texts without words."""
    df = frame(spark, [None if i % 3 else "" for i in range(40)]).withColumn("doc_id", F.when(F.col("doc_id") < 38, F.col("doc_id")).cast("int"))
    labels = spark.createDataFrame([*((i, i % 2) for i in range(40)), (1 << 40, 1), (1 << 41, 1)], "doc_id long, toxic int")
    known = [i for i in range(38) if not held(i)]
    packed = [toxicity.Block.unpack([r[c] for c in toxicity.PACKED]) for r in toxicity.blocks(df, labels, 2).collect()]
    assert sum(len(b.ids) for b in packed) == len(known) == toxicity.training_rows(df, labels).count() and sum(b.y.sum() for b in packed) == sum(i % 2 for i in known)
    scores = {r.score for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1


def test_blocks_average_what_they_hold():
    rng = random.Random(37)
    make = lambda word: toxicity.Block.of([prose(rng, 8) + (f" {word}" if k % 2 else "") for k in range(80)], np.arange(80) % 2.0, np.zeros(80, bool))
    a, b = make("grumlat"), make("zorkk")
    begun = toxicity.State.begin(toxicity.slot_counts(a) + toxicity.slot_counts(b), 7)
    changes = [begun.change(x, (1.0, 1.0), 0.1, [7, 0, k]) for k, x in enumerate((a, b))]
    both, alone = begun.changed(sum(changes)), begun.changed(changes[0])
    held = [{int(s) for s in x.rows[:, :3].ravel()} for x in (a, b)]
    own, none = sorted(held[0] - held[1]), sorted(set(range(toxicity.SLOTS)) - held[0] - held[1])
    assert own and np.array_equal(both.model.emb[own], alone.model.emb[own]) and (both.model.emb[own] != begun.model.emb[own]).any()
    assert np.array_equal(both.model.emb[none], begun.model.emb[none])


def junk(rng: random.Random) -> str:
    w = prose(rng, rng.randrange(4, 40)).split()
    return rng.choice([lambda: " ".join(x for x in w for _ in range(9)), lambda: " ".join(x.upper() + "!!" for x in w), lambda: " ".join(x + rng.choice(["###", "$$$"]) for x in w), lambda: " | ".join(w)])()


def test_quality_held_out_and_compiled(spark):
    rng = random.Random(10)
    y = [int(rng.random() < 0.8) for _ in range(600)]
    texts = [prose(rng, rng.randrange(3, 90)) if g else junk(rng) for g in y]
    x = np.array([quality.statistics(t.encode()) for t in texts])
    model = quality.fit(x[:450], np.array(y[:450], float))
    p = 1 / (1 + np.exp(-np.clip(model.margin(x), -30, 30)))
    assert np.mean((p[450:] >= 0.3) == np.array(y[450:])) >= 0.95
    assert 0 < len(model.rules) < 60 and all(1 <= len(r) <= 3 for r in model.rules)
    rows = {r.doc_id: r.score for r in quality.score(frame(spark, texts), model).collect()}
    assert np.allclose([rows[i] for i in range(600)], p, atol=1e-9)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(42)
    f = (rng.random((400, 25)) < rng.random(25)).astype(float)
    w = np.where(rng.random(25) < 0.3, rng.normal(0, 2, 25), 0)
    y = (rng.random(400) < 1 / (1 + np.exp(-(f @ w - 0.5)))).astype(float)
    for penalty in (0.002, 0.01, 0.05):
        b, got = quality.lasso(f, y, penalty, 20_000)
        g = np.hstack([np.ones((400, 1)), f]).T @ (1 / (1 + np.exp(-(f @ got + b))) - y) / 400
        assert abs(g[0]) < 1e-5 and (np.abs(g[1:][got == 0]) <= penalty + 1e-5).all()
        assert np.allclose(g[1:][got != 0], -penalty * np.sign(got[got != 0]), atol=1e-5)


def test_tree_paths_split_where_gain_is_greatest():
    rng = np.random.default_rng(43)
    x = rng.random((200, 3))
    y = ((x[:, 1] > 0.6) ^ (rng.random(200) < 0.05)).astype(float)
    cuts = [np.quantile(c, [0.2, 0.4, 0.6, 0.8]) for c in x.T]
    codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)
    p = np.full(200, y.mean())
    grad, hess, rules = y - p, p * (1 - p), set()
    quality.grow(x, codes, cuts, grad, hess, np.arange(200), 1, (), 5, rules, np.zeros(200))
    score = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
    j, c = max(((j, c) for j in range(3) for c in cuts[j]), key=lambda t: score(x[:, t[0]] > t[1]) + score(x[:, t[0]] <= t[1]))
    assert rules == {((j, False, float(c)),), ((j, True, float(c)),)}


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    none = quality.train(odd, labels.filter("false"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(spark.createDataFrame([], EMPTY), none).count() == 0


def test_labels_of_the_held_out_fifth_are_never_read(spark):
    docs = frame(spark, [f"text {i}" for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    for rows in (quality.training_rows(docs, labels, "quality", 1000), toxicity.training_rows(docs, labels)):
        ids = {r.doc_id for r in rows.collect()}
        assert ids == {i for i in range(300) if not held(i)}
    assert quality.training_rows(docs, labels, "quality", 50).count() == 50


# --- 7: resharding


def test_flow_is_cheapest():
    rng = random.Random(11)
    for _ in range(40):
        supply, cost = [rng.randrange(0, 4) for _ in range(3)], [[rng.randrange(0, 9) for _ in range(3)] for _ in range(3)]
        n = sum(supply)
        caps = [(n // 3, -(-n // 3))] * 3
        flow = sharding.min_cost_flow(supply, caps, cost)
        assert [sum(f) for f in flow] == supply and all(lo <= sum(f[j] for f in flow) <= hi for j, (lo, hi) in enumerate(caps))
        best = min((sum(cost[b][j] for b, j in zip((b for b, s in enumerate(supply) for _ in range(s)), c, strict=True)) for c in itertools.product(range(3), repeat=n) if all(lo <= c.count(j) <= hi for j, (lo, hi) in enumerate(caps))), default=0)
        assert sum(f[j] * cost[b][j] for b, f in enumerate(flow) for j in range(3)) == best


def written(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def least_bytes(old: dict, n_new: int = 8) -> int:
    """The fewest bytes that must move, over all choices of the shards with one row more: each old shard loses its smallest rows.
    old: sizes by shard."""
    n = sum(map(len, old.values()))
    least, more = divmod(n, n_new)
    sums = {o: list(itertools.accumulate(sorted(x), initial=0)) for o, x in old.items()}
    cost = lambda o, cap: sums[o][max(0, len(old[o]) - cap)] if o < n_new else sums[o][-1]
    # more shards get one row more; so many at least can hold it as those that have rows enough
    return min(sum(cost(o, least + (o in more_)) for o in old) for more_ in itertools.combinations(range(n_new), more))


def check_shards(rows, texts_by_row, n_new=8):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(n_new)) and max(map(len, by.values())) - (min(map(len, by.values())) if len(by) == n_new else 0) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.law) for r in rows)
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows") for i, t in texts_by_row)


@pytest.mark.parametrize("n", [0, 3, 97, 600])
def test_resharding_moves_the_fewest_bytes(spark, stages, tmp_path, n):
    rng = random.Random(n)
    texts = [f"{i} {prose(rng, rng.randrange(0, 60))}" for i in range(n)]
    df = written(spark, frame(spark, texts), tmp_path / "in")
    rows = sharding.digest(df, stages).collect()
    if n:
        check_shards(rows, list(enumerate(texts)))
        old = defaultdict(list)
        for r in rows:
            old[r.old_shard].append(r["size"])
        assert sum(r["size"] for r in rows if r.old_shard != r.shard) == least_bytes(old)
    assert len(rows) == n


def test_equal_texts_stay_together(spark, stages, tmp_path, odd):
    rng = random.Random(31)
    texts = [prose(rng, 12)[:60] for _ in range(500)]
    for n in (2, 2, 3, 5, 9, 30, 60):
        texts += [prose(rng, 12)[:60]] * n
    extra = odd.select(*DOC.replace(",", "").split()[::2])
    df = written(spark, frame(spark, texts).unionByName(extra), tmp_path / "in")
    rows = sharding.digest(df, stages).collect()
    pairs = [(r.doc_id, r.text) for r in df.collect()]
    check_shards(rows, pairs)
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and {r.groups_split for r in rows} == {0}


def test_a_group_larger_than_a_shard_is_split(spark, stages, tmp_path):
    rng = random.Random(32)
    texts = ["hot text"] * 300 + [prose(rng, rng.randrange(1, 9)) for _ in range(500)]
    df = written(spark, frame(spark, texts), tmp_path / "in")
    rows = sharding.digest(df, stages).collect()
    check_shards(rows, list(enumerate(texts)))
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert len(where.pop("hot text")) > 1 and all(len(s) == 1 for s in where.values()) and {r.groups_split for r in rows} == {1}
    old = defaultdict(list)
    for r in rows:
        old[r.old_shard].append(r["size"])
    assert sum(r["size"] for r in rows if r.old_shard != r.shard) == least_bytes(old)


def test_cut_passes_over_what_is_too_large(spark, monkeypatch):
    rng = random.Random(33)
    monkeypatch.setattr(sharding, "WINDOW", 40)
    pairs = sorted({(rng.randrange(-(1 << 63), 1 << 63) >> rng.choice([0, 0, 50]), rng.randrange(9)): rng.choice([1, 1, 1, 4]) for _ in range(3000)}.items())
    pool = spark.createDataFrame([(a, b, n) for (a, b), n in pairs], "u1 long, u2 long, n int")
    for need in (1, 2, 777, 2500, sum(n for _, n in pairs)):
        end, passed, left = sharding.cut_at(pool, need)
        out = {p for p, _ in passed}
        assert left == 0 and sum(n for p, n in pairs if p <= end and p not in out) == need


def test_rewrite_keeps_what_lies_there(spark, tmp_path):
    path = str(tmp_path / "shards")
    first = spark.createDataFrame([(i, i % 3) for i in range(12)] + [(50, 9)], "id int, shard int")
    sharding.rewrite(first, sharding.moved(first.select("shard", F.col("shard").alias("old_shard"), F.lit(1).alias("size"))), path)
    assert {(r.id, r.shard) for r in spark.read.parquet(path).collect()} == {(r.id, r.shard) for r in first.collect()}
    lies = lambda j: {(f.name, f.stat().st_mtime_ns) for f in (tmp_path / "shards" / f"shard={j}").iterdir()}
    before = lies(1)
    # from the same place: shard 9 vanishes, its row and one of shard 0 go to shard 2; shard 1 isn't touched
    now = spark.read.schema("id int, shard int").parquet(path).withColumnRenamed("shard", "old_shard")
    now = now.withColumn("shard", F.when((F.col("id") == 3) | (F.col("old_shard") == 9), 2).otherwise(F.col("old_shard")))
    change = sharding.moved(now.withColumn("size", F.lit(1)))
    assert {r.shard: r.rewritten for r in change.collect()} == {0: True, 1: False, 2: True, 9: True}
    sharding.rewrite(now, change, path)
    got = {r.id: r.shard for r in spark.read.schema("id int, shard int").parquet(path).collect()}
    assert got == {i: i % 3 for i in range(12)} | {3: 2, 50: 2} and lies(1) == before
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if not p.name.startswith(("_", "."))) == ["shard=0", "shard=1", "shard=2"]


def test_shards_hold_the_texts(spark, odd, stages, tmp_path):
    df = written(spark, frame(spark, [prose(random.Random(i), i % 40) for i in range(333)]).unionByName(odd.select(*DOC.replace(",", "").split()[::2])), tmp_path / "in")
    out = sharding.digest(df, stages).collect()
    lies = sharding.read_shards(spark, f"{stages.root}/shards", "doc_id long, text string").collect()
    assert Counter((r.doc_id, r.text) for r in lies) == Counter((r.doc_id, r.text) for r in df.collect())
    assert {(r.shard, r.slot): (r.doc_id, zlib.crc32((r.text or "").encode())) for r in lies} == {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in out}


# --- 9: urls


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/1", "http://net/es/", "http://x.net/fr", "http://x.net/fr/1", "https://blog.b.com", "https://b.com/p", "http://cheap-pills.org/", "http://cheap.org/", "http://porn.org", "http://pornography.org", "http://h:80/a#b?c", "x://y?z/en/", "http://cheapcheap.org/cheap"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block")
    assert got[5][2:] == ("net/es/", "block") and got[6][2] is None and got[7][2] == "net/fr/" and got[8][:3] == ("blog.b.com", "", None) and got[9][2] == "com/"
    assert [got[i][3] for i in (10, 11, 12, 13, 16)] == ["block", "allow", "block", "allow", "allow"]
    assert got[14][:2] == ("h:80", "/a") and got[15][:2] == ("y", "")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert {r[0]: tuple(r[1:5]) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.SQL['op9_url_filter']})").fetchall()} == got


def test_url_rules_and_vocabulary_from_tables(spark, monkeypatch):
    rng = random.Random(41)
    names = ["a", "b", "ads", "x"]
    urls = ["http://" + ".".join(rng.choices(names, k=rng.randrange(1, 4))) + "".join("/" + rng.choice(names) for _ in range(rng.randrange(0, 3))) for _ in range(300)] + [None, "", "http://", "a/b"]
    rules = sorted({(rng.choice(["allow", "block"]), ".".join(rng.choices(names, k=rng.randrange(1, 4))) + "/" + "/".join(rng.choices(names, k=rng.randrange(0, 3)))) for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("_hits", F.lit(1)).withColumn("_rule", F.lit(2)).withColumn("row", F.lit(3)).withColumn("fit", F.lit(4))
    table = spark.createDataFrame([*rules, (None, "a/"), ("block", None)], "verdict string, rule string")
    got = url_filter.judge(df, rules=table)
    assert got.columns == ["page_id", "url", "_hits", "_rule", "row", "fit", *url_filter.OUTPUTS]
    got = {r.page_id: tuple(r)[2:] for r in got.collect()}
    assert len(got) == len(urls) and {v[:4] for v in got.values()} == {(1, 2, 3, 4)}
    for i, u in enumerate(urls):
        host, path = re.match(r"([^/?#]*)([^?#]*)", u.partition("://")[2].lower()).groups() if u and "://" in u else ("", "")
        fit = [(len(r), r, v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        assert got[i][4:7] == (host, path, max(fit)[1] if fit else None) and (not fit or got[i][9] == max(fit)[2])
    assert {r.page_id: tuple(r)[2:] for r in url_filter.judge(df, rules=rules).collect()} == got
    monkeypatch.setattr(url_filter, "MAX_RULES", 10)
    assert {r.page_id: tuple(r)[2:] for r in url_filter.judge(df, rules=rules).collect()} == got
    terms = spark.createDataFrame([("Böse", "strict"), ("x", "soft"), ("ads", "soft"), (None, "soft"), ("", "strict")], "term string, kind string")
    assert url_filter.vocabulary(terms) == (("böse",), ("ads", "x"))
    strict, soft = url_filter.vocabulary(terms)
    one = spark.createDataFrame([(1, "http://q/böse"), (2, "http://q/ads/x"), (3, "http://q/x/x")], "page_id int, url string")
    assert [r.verdict for r in url_filter.judge(one, rules=(), strict=strict, soft=soft).orderBy("page_id").collect()] == ["block", "block", "allow"]


# --- 10: leaks


def plain_terms(text):
    return [w for w in (re.sub(r"^\W+|\W+$", "", w.lower()) for w in (text or "").split()) if w]


def plain_parts(text):
    """Question and answer."""
    t = text.rstrip()
    inner = [i for i, c in enumerate(t) if c == "?" and i < len(t) - 1]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", t)]
    cut = inner[-1] + 1 if inner else ends[-1] if ends else 0
    q, a = plain_terms(text[:cut]), plain_terms(text[cut:])
    if not q or not a:
        w = q or a
        k = len(w) - max(1, len(w) // 3) if len(w) > 1 else 0
        q, a = w[:k], w[k:]
    return q, a


def plain_scores(docs: dict, items: dict) -> dict:
    """(document, item): best score of a passage with question and answer; all passages against all items, by the formula of BM25."""
    bags = {i: Counter(plain_terms(t)) for i, t in items.items() if plain_terms(t)}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / max(1, len(bags))
    gain = {i: {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, tf in b.items()} for i, b in bags.items()}
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for d, t in docs.items():
        words = plain_terms(t)
        for i, g in gain.items():
            size = 64
            while size < 2 * sum(bags[i].values()):
                size *= 2
            last = max(0, len(words) - size)
            for s in sorted({min(x, last) for x in range(0, len(words), size // 2)}):
                p = words[s : s + size]
                score = sum(g[w] for w in set(p) if w in g)
                if score < 0.6 * sum(g.values()) - 1e-6:
                    continue
                share = []
                for part in plain_parts(items[i]):
                    k = min(5, len(part))
                    want = grams(part, k) if part else set()
                    share.append(len(want & grams(p, k)) / len(want) if want else 1.0)
                if min(share) >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def plain_leaks(docs: dict, items: dict) -> set:
    return set(plain_scores(docs, items))


def test_leaks(spark):
    rng = random.Random(12)
    items = {i: prose(rng, rng.randrange(15, 60)).capitalize() + ". " + prose(rng, rng.randrange(3, 9)) + "." for i in range(40)} | {90: "What is kaban? " + prose(rng, 6)}
    docs = {}
    for d in range(120):
        t = prose(rng, rng.randrange(1, 400))
        if d % 3 == 0:
            w = items[rng.choice(list(items))].split()
            if d % 2:
                w = [x if rng.random() > 0.03 else "zzz" for x in w]
            t = t + " " + " ".join(w) + " " + prose(rng, rng.randrange(0, 200))
        elif d % 3 == 1:
            t += " " + " ".join(items[rng.choice(list(items))].split()[:10])
        docs[d] = t
    docs |= {200: None, 201: "", 202: items[3]}
    df = frame(spark, list(docs.values()), ids=list(docs))
    bench = spark.createDataFrame([*items.items(), (91, None), (92, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()}
    want = plain_scores(docs, items)
    assert set(got) == set(want) and (202, 3) in got and len(got) >= 30
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == set(docs) - {d for d, _ in got}
    assert decontaminate.leaks(df, bench.filter("false")).count() == 0 and decontaminate.leaks(df.filter("false"), bench).count() == 0


def test_any_division_of_the_items_gives_equal_scores(spark, monkeypatch):
    rng = random.Random(21)
    texts = {i: prose(rng, rng.randrange(8, 40)) + "? " + prose(rng, 6) for i in range(1500)}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    assert [len(i.ids) for i in decontaminate.indexes(items)] == [1500]
    docs = frame(spark, [prose(rng, 90) + " " + texts[i * 7] + " " + prose(rng, 700) for i in range(30)])
    rows = lambda: sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect())
    one = rows()
    assert {(r[0], r[1]) for r in one} >= {(i, i * 7) for i in range(30)}
    monkeypatch.setattr(decontaminate, "MAX_INDEX_BYTES", 40_000)
    parts = [len(i.ids) for i in decontaminate.indexes(items)]
    assert len(parts) > 5 and sum(parts) == 1500
    several = rows()
    assert [r[:2] for r in one] == [r[:2] for r in several] and all(np.allclose(a[2:], b[2:]) for a, b in zip(one, several, strict=True))


def test_pivots_reach_every_item():
    rng = random.Random(22)
    items = [(i, " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rng.randrange(1, 30)))) for i in range(300)]
    bags = [Counter(decontaminate.terms(t)) for _, t in items]
    stats = decontaminate.Statistics(len(items), sum(sum(b.values()) for b in bags) / len(items), Counter(w for b in bags for w in b))
    index = decontaminate.build(items, stats)
    queries = [np.unique(rng.choices(range(len(index.vocabulary)), k=rng.randrange(0, 40))).astype(np.int64) for _ in range(200)]
    value = np.zeros((len(index.vocabulary), len(items)))
    for i, (t, x) in enumerate(index.bags):
        value[t, i] = x
    want = [(q, int(i)) for q, terms in enumerate(queries) for i in np.flatnonzero(value[terms].sum(0) >= 1 - 1e-6)]
    assert index.wand(queries) == want and 0 < len(want) < 200 * 300


def test_leaks_odd(spark):
    rng = random.Random(23)
    item = prose(rng, 30) + "? " + prose(rng, 9)
    long = prose(rng, 3000) + " " + item + " " + prose(rng, 70_000) + " " + item
    df = frame(spark, [long, item, item, None, prose(rng, 40)], ids=[0, None, 2, 3, 4]).withColumn("score", F.lit("own")).withColumn("item_id", F.lit(1))
    df = df.union(df.filter("doc_id = 2"))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit(5))
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()) == {(0, 1): 1, (None, 1): 1, (2, 1): 2}
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {3, 4}


# --- all on the small tables


def test_registered(spark):
    from tilewright.llm import registry

    numbers = sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES)
    assert numbers == list(range(1, 11))
    assert registry.QUERIES["op9_url_filter"](spark, SMALL).count() == 50


@pytest.mark.parametrize("name", ["op2_minhash_hamming", "op4_suffix_dedup", "op9_url_filter"])
def test_query_agrees_with_sql(spark, name):
    from tilewright.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r) for r in found)


# --- names and ids that operators don't expect


def test_classifiers_take_any_column_name_and_ids_of_text(spark):
    rng = random.Random(3)
    docs = frame(spark, [prose(rng, 30) if k % 2 else "SCUM!! " * 20 for k in range(60)])
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))).withColumn("__text", F.lit("x")).withColumn("__TEXT_", F.lit("y"))
    labels = named.select("doc_id", (F.length("text") % 2).cast("int").alias("quality"), F.col("text").startswith("SCUM").cast("int").alias("toxic"))
    for module in (toxicity, quality):
        out = module.score(named, module.train(named, labels))
        assert out.count() == 60 and {"__text", "__TEXT_"} <= set(out.columns) and out.filter("__text = 'x' AND __TEXT_ = 'y'").count() == 60


def test_very_long_texts_pack_like_others_and_hold_few_pieces(spark, monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 20_000) + " 12 ab!\n\n  x"
    cache = packing.Pieces(packing.ranks(spark))
    want = cache.ids(text).tolist()
    monkeypatch.setattr(packing, "LONG", 1000)
    monkeypatch.setattr(packing, "BLOCK", 37)
    assert packing.Pieces(packing.ranks(spark)).ids(text).tolist() == want == packing.encoding(packing.ranks(spark)).encode_ordinary(text)


def test_a_family_of_nearly_similar_long_texts_is_no_table_of_pairs(spark, monkeypatch):
    """Texts that the index and the first tests can't tell from similar ones, and two families that are linked by many pairs."""
    rng = random.Random(41)
    texts = []
    for share, n in ((0.04, 40), (0.028, 30)):  # of words changed: similarities of pairs just below and about the threshold
        base = prose(rng, 500).split()
        for _ in range(n):
            x = list(base)
            for i in rng.sample(range(500), int(500 * share)):
                x[i] = prose(rng, 1)
            texts.append(" ".join(x))
    want = groups({i: word_set(t, 2) for i, t in enumerate(texts)})
    most, put = [0], common.Stages.put

    def counted(self, df):
        out = put(self, df)
        if set(out.columns) == {"a", "b"}:
            most.append(out.count())
        return out

    monkeypatch.setattr(common.Stages, "put", counted)
    rows = minhash.near_duplicates(frame(spark, texts), common.Stages(spark, "family")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert 0 < max(most) < 3 * len(texts)


def test_rows_without_a_match_arent_shuffled(spark):
    rows = spark.range(0, 20000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("_at"))
    ids = spark.range(0, 20000, 40).select(F.col("id").alias("k"))
    got = {r.k for r in common.among(rows, ids, "k").collect()}
    assert got >= set(range(0, 20000, 40)) and len(got) < 600
    assert common.among(rows, ids, "k").columns == ["k", "_at"] and common.among(rows, ids.filter("false"), "k").count() == 0


def test_index_keys_are_shuffled_once(spark):
    keys = spark.createDataFrame([(1, 5), (1, 3), (2, 7), (3, 8), (3, 8), (4, 9), (4, 2), (4, 6)], "key long, id long")
    out = minhash.shared(keys)
    assert sorted(map(tuple, out.select("key", "id", "hub").collect())) == [(1, 3, 3), (1, 5, 3), (4, 2, 2), (4, 6, 2), (4, 9, 2)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
