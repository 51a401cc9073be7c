"""The pipeline stage by stage against plain versions of what each must do."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import common, quality

from ..conftest import SMALL
from .test_operators import groups, plain_leaks, word_set


def test_stages(spark):
    stages = common.Stages(spark, "test")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = stages.put(f(spark, docs, SMALL))
        before, rows = docs.collect(), out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            whole = {r.doc_id: r for r in before}
            assert all(whole[r.doc_id] == r for r in rows)
        kept[name] = (before, rows)
        docs = out
    before, rows = kept["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = {d for d, q in labels.items() if q == 1}
    left = {r.doc_id for r in rows}
    assert len(good & left) >= 0.95 * len(good & {r.doc_id for r in before}) and len(rows) < len(before)
    model = quality.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    scored = {r.doc_id: r.predicted for r in quality.score(spark.read.parquet(f"{SMALL}/documents.parquet"), model).collect()}
    assert left == {d for d, p in scored.items() if p}
    before, rows = kept["near_duplicates"]
    want = groups({r.doc_id: word_set(r.text, 5) for r in before})
    assert {r.doc_id for r in rows} == {d for d, c in want.items() if d == c}
    before, rows = kept["decontamination"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    hit = {d for d, _ in plain_leaks({r.doc_id: r.text for r in before}, items)}
    assert {r.doc_id for r in rows} == {r.doc_id for r in before} - hit
    before, rows = kept["mixture"]
    times = Counter(r.doc_id for r in rows)
    assert set(times) <= {r.doc_id for r in before} and set(times.values()) <= {1, 2}
    size = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(size(rows) / size(before) - 1.5) < 0.03
    before, rows = kept["shards"]
    n = Counter(r.shard for r in rows)
    assert len(rows) == len(before) and max(n.values()) - min(n.values()) <= 1


def test_clashing_columns_and_nulls(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (900, "", "en", None, 0)], docs.schema))
    for c in ("size", "score", "n_words", "target", "predicted", "copies"):
        odd = odd.withColumn(c, F.lit("own"))
    for name in ("quality", "mixture"):
        out = dict(corpus_pipeline.STAGES)[name](spark, odd, SMALL)
        assert out.columns == odd.columns and {tuple(r)[5:] for r in out.collect()} == {("own",) * 6}
    for name in ("near_duplicates", "decontamination"):
        out = dict(corpus_pipeline.STAGES)[name](spark, odd, SMALL)
        assert out.columns == odd.columns and {r.doc_id for r in out.collect()} >= {None, 900}


def test_run_and_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
