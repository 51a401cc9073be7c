"""Ranked search, language identification and importance resampling against brute-force versions, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import common, langid, lexical, resampling

from ..conftest import SMALL
from .test_operators import frame, prose

ITEM = "item_id long, text string"


@pytest.fixture
def stages(spark):
    return common.Stages(spark, "test")


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, clashing columns."""
    rng = random.Random(1)
    long, again = prose(rng, 4000), prose(rng, 60)
    df = frame(spark, [None, "", " \t\n", "one", "One two", long, long, again, again, again], ["a", "a", None, "b", "b", "a", "b", None, None, "a"], [0, 1, 2, 3, 4, 5, 6, 7, 7, None])
    return df.withColumn("score", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("row", F.lit(0)).withColumn("lang_pred", F.lit(0)).withColumn("_score", F.lit(0)).withColumn("_id", F.lit(0))


def oracle(name: str, sql: str) -> list:
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(sql)
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    return sorted([str(r[i]) for i in order] for r in found.fetchall())


@pytest.mark.parametrize("name", ["op11_blas_search", "op13_importance_quickselect"])
def test_query_agrees_with_sql(spark, name):
    module = lexical if name in lexical.SQL else resampling
    df = module.QUERIES[name](spark, SMALL)
    assert sorted([str(r[c]) for c in sorted(df.columns)] for r in df.collect()) == oracle(name, module.SQL[name])


# --- 11: ranked search


def lexical_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(text))


def search(docs, items, top=10):
    """{item position: [(score, doc_id)]} by plain loops; docs and items: lists of (id, text)."""
    bags = [(i, Counter(lexical_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = {}
    for k, (_, text) in enumerate(items):
        found, item = [], Counter(lexical_terms(text))
        for i, b, size in bags:
            m = 100 - 75 + (75 * size * n) // length
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, k in item.items() if b[t])
            found += [(-s, i is None, i)] if s > 0 else []
        out[k] = [(-s, i) for s, _, i in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top]]
    return out


def test_search_equals_loops_with_ties_copies_and_many_tiles(spark, stages, monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(150)]
    docs = [(i, texts[i % 150] if i % 7 else "Ünder ÜNDER A-b_c d 9") for i in range(600)]
    items = [(k, prose(rng, rng.randint(1, 30)) + " ünder b") for k in range(40)] + [(40, "kaban " * 50), (41, ""), (42, None), (43, "!?")]
    monkeypatch.setattr(lexical, "TILE_DOCS", 37)
    monkeypatch.setattr(lexical, "TILE_ITEMS", 7)
    monkeypatch.setattr(lexical, "PIECE", 20)
    monkeypatch.setattr(lexical, "MAX_ITEMS", 15)  # several indexes
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, ITEM), stages)
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.item_id, r["rank"])):
        by.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(by[r.item_id])
    assert by == {k: v for k, v in search(docs, items).items() if v}


def test_products_stay_exact_when_weights_are_split_over_tiles():
    rng = np.random.default_rng(5)
    held = [[(i, int(rng.integers(1, 4))) for i in range(9) if rng.random() < 0.5] for _ in range(60)]
    weight = rng.integers(0, 25_000, 60).tolist()
    ts = lexical.tiles(held, weight, 9, exact=20_000, size=8)
    sums = np.zeros((9, 60), np.int64)
    for t in ts:
        own = np.bincount(t.item, t.weight, 9)
        assert own.max() <= 20_000 and len(t.term) <= 8
        np.add.at(sums, (t.item, np.repeat(t.term, np.diff(t.first))), t.weight.astype(np.int64))
    want = np.zeros((9, 60), np.int64)
    for k, of in enumerate(held):
        for i, n in of:
            want[i, k] = n * weight[k]
    assert (sums == want).all()
    doc, term = rng.integers(0, 11, 200), rng.integers(0, 60, 200)
    pairs = np.unique(np.stack([doc, term]), axis=1)
    impact = rng.integers(1, 10**6, pairs.shape[1])
    dense = np.zeros((60, 11), np.int64)
    dense[pairs[1], pairs[0]] = impact
    assert (lexical.multiply(ts, 9, pairs[0], pairs[1], impact, 11) == want @ dense).all()


def test_scores_beyond_the_exact_range_of_floats(spark, stages):
    """An item so long that its score passes 2^53."""
    docs = [(i, f"aa bb{i % 3}" + " zz" * (i in (7, 9))) for i in range(2000)]
    items = [(1, "zz " * 3_000_000 + "aa " * 3 + "bb2")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), stages, top=3).collect()
    want = search(docs, items, 3)[0]
    assert want[0][0] > 2**53 and sorted((r["rank"], r.score, r.doc_id) for r in got) == [(k + 1, s, i) for k, (s, i) in enumerate(want)]


def test_search_on_odd_rows_and_empty_tables(spark, stages):
    docs, items = odd(spark), spark.createDataFrame([(1, "ONE two"), (1, "ONE two"), (None, "two"), (3, None)], ITEM)
    got = sorted((r.item_id is None, r["rank"], r.doc_id) for r in lexical.search(docs, items, stages).collect())
    assert got == [(False, 1, 4), (False, 2, 3), (True, 1, 4)]
    again = lexical.search(frame(spark, ["x", "x", "x"], ids=[7, 7, None]), spark.createDataFrame([(1, "x")], ITEM), stages)
    assert [(r["rank"], r.doc_id) for r in again.orderBy("rank").collect()] == [(1, 7), (2, 7), (3, None)]
    assert not lexical.search(docs.limit(0), items, stages).count() and not lexical.search(docs, items.limit(0), stages).count()


# --- 12: language


def plain_phrases(text: str, model: langid.Model, samples: dict[str, list[int]]) -> dict[str, int]:
    """Phrases by looking for ever longer pieces in the samples themselves."""
    out = dict.fromkeys(samples, 0)
    for a in range(0, len(text), langid.SLICE):
        flat = langid.symbols(text[a : a + langid.SLICE], model.classes)
        for b in range(0, len(flat), langid.PIECE):
            piece = flat[b : b + langid.PIECE]
            for lang, s in samples.items():
                sample, at = "".join(map(chr, s)), 0
                while at < len(piece):
                    end = at + 1
                    while end < len(piece) and "".join(map(chr, piece[at : end + 1])) in sample:
                        end += 1
                    out[lang] += 1
                    at = end
    return out


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 50)
    monkeypatch.setattr(langid, "SLICE", 130)
    rng = random.Random(8)
    texts = {"x": ["".join(rng.choice("abc  ") for _ in range(400))], "y": ["".join(rng.choice("bcdé-") for _ in range(300))]}
    model = langid.build(texts)
    samples = {lang: [*langid.symbols(ts[0], model.classes), 0] for lang, ts in texts.items()}
    assert model.langs == ["x", "y"] and np.allclose(model.bits, [np.log2(len(s)) for s in samples.values()])
    probes = ["", "  ", "abc", "ÉDÉ", "z", "zz9", "…", *("".join(rng.choice("abcdez é-ß文") for _ in range(n)) for n in (1, 2, 49, 50, 51, 129, 130, 131, 700))]
    per, size, letters = langid.Parser(model).phrases(probes)
    for k, t in enumerate(probes):
        assert dict(zip(model.langs, per[k].tolist(), strict=True)) == plain_phrases(t, model, samples)
        assert letters[k] == sum(c.isalpha() for c in t)
        assert size[k] == sum(len(langid.symbols(t[a : a + 130], model.classes)) for a in range(0, len(t), 130))


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(2)
    s = [rng.randrange(3) for _ in range(40)]
    step = langid.automaton(s, 4)
    subs = {tuple(s[a:b]) for a in range(40) for b in range(a + 1, 41)}
    for probe in [*subs, *(tuple(rng.randrange(4) for _ in range(rng.randint(1, 6))) for _ in range(500))]:
        at = 0
        for c in probe:
            at = step[at][c]
            if not at:
                break
        assert bool(at) == (probe in subs)


def test_language_of_held_out_documents(spark):
    rows = langid.op12_cross_parsing(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in own) >= 0.95 * len(own)
    texts = {}
    for r in rows:
        assert texts.setdefault(docs[r.doc_id].text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)


def test_held_out_rows_and_null_languages_are_not_learned(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0][:5]
    rows = [(i, "kata mora " * 5, "in", "s", 0) for i in ids] + [(1, "wowo zuzu", None, "s", 0), (3, "lili nono", "b", "s", 0)]
    assert set(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))) == {"b"}


def test_language_on_odd_rows_and_empty_tables(spark):
    df = odd(spark)
    out = langid.predict(df, langid.train(df))
    assert out.columns == [*(c for c in df.columns if c not in ("lang_pred", "score")), "lang_pred", "score"]
    got = out.collect()
    assert len(got) == 10 and all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and {r.lang_pred for r in got} == {"en", "und"}
    nothing = langid.train(df.limit(0))
    assert not langid.predict(df.limit(0), nothing).count()
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


# --- 13: resampling


def resample(docs, target, buckets=10_000, least=20, percent=10, n_gram=1):
    """[(doc_id, n_features, weight, score, rank)] by a sort of all rows."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    features = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, n_gram + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, x in docs:
        fs = features(x)
        w = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    place = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        place.setdefault(r, []).append(k + 1)
    return sorted(((*r[:4], p.pop(0) if (p := place.get(r)) else None) for r in rows), key=str)


@pytest.mark.parametrize(("pivots", "n_gram"), [(15, 1), (1, 3)])
def test_resampling_equals_a_sort(spark, stages, monkeypatch, pivots, n_gram):
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randint(0, 60)) + " Ærø 9x") for i in range(700)] + [(5, prose(rng, 30))] * 100 + [(None, prose(rng, 30)), (900, None)]
    target = [prose(rng, 20) for _ in range(20)] + [None]
    monkeypatch.setattr(resampling, "RANGE_ROWS", 10)
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    monkeypatch.setattr(resampling.select, "__defaults__", (pivots,))
    monkeypatch.setattr(resampling, "PIECE", 64)
    got = resampling.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"), stages, keep=["doc_id"], n_gram=n_gram, percent=30,
    ).collect()
    assert sorted((tuple(r) for r in got), key=str) == resample(docs, target, n_gram=n_gram, percent=30)


def test_drawn_documents_lean_to_the_target(spark, stages):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["red", "blue"] if i % 2 else ["tree", "house"]) for _ in range(30))) for i in range(400)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("red blue red blue " * 50,)], "text string"), stages).filter("rank IS NOT NULL").collect()
    assert len(got) == 40 and sum(r.doc_id % 2 for r in got) >= 32 and sorted(r["rank"] for r in got) == list(range(1, 41))
    assert all(r.text == dict(docs)[r.doc_id] for r in got)


def test_resampling_on_odd_rows_and_empty_tables(spark, stages):
    df, target = odd(spark), spark.createDataFrame([("one",), (None,)], "text string")
    out = resampling.resample(df, target, stages, percent=50)
    assert out.columns == [*(c for c in df.columns if c not in ("score", "rank")), "n_features", "weight", "score", "rank"]
    got = out.collect()
    assert len(got) == 10 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and all(r["rank"] is None for r in got if r.n_features < 20)
    assert all(r.weight == 0 for r in got if not r.n_features)
    assert not resampling.resample(df.limit(0), target, stages).count()
    assert resampling.resample(df, target.limit(0), stages).count() == 10
