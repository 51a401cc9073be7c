"""Queries over all of their rows against plain versions, on tables large enough to show a cut."""

from __future__ import annotations

import duckdb
import pytest

from tilewright import registry
from tilewright.operators import stats

from .test_oracle import TABLES, cell

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MEDIUM}/{t}.parquet'")
    return c


def test_ap_at_ratios_has_all_positives(spark, con):
    pos, neg = con.execute("SELECT count(*) FILTER (p), count(*) FILTER (NOT p) FROM (SELECT bool_or(l_linenumber <> 7 AND l_returnflag = 'R') AS p FROM lineitem GROUP BY l_orderkey)").fetchone()
    out = {r.ratio: r for r in registry.QUERIES["m03_ap_at_ratios"](spark, MEDIUM).collect()}
    assert {k: (r.n_neg, r.bootstrapped) for k, r in out.items()} == {k: (pos * k, pos * k > neg) for k in (1, 5, 20)}
    assert all(0 < r.ap < 1 for r in out.values()) and out[1].ap > out[5].ap > out[20].ap


def agrees(spark, con, name: str, sql: str) -> None:
    df = registry.QUERIES[name](spark, MEDIUM)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted([cell(r[c]) for c in columns] for r in df.collect()) == sorted([cell(v) for v in r] for r in want)


@pytest.mark.parametrize("name", ["j11_distance_to_positive", "j11_distance_to_all_positives", "a29_block_any", "a29_block_any_by_tile", "r25_reclassify", "r25_reclassify_in_domain", "j04_modality_stack", "j04_modality_stack_all_rows", "a17_mode_fallback", "a17_mode_fallback_all_scenes", "m03_ap_at_ratios"])
def test_whole_tables(spark, con, name):
    for cut in ("id < 500", "tile_id = 7", "tile_id % 2 = 0", "l_linenumber <= 4", "qa % 3 = 0", "% 97"):
        assert cut not in registry.SQL[name]
    agrees(spark, con, name, registry.SQL[name])


def test_mode_none(spark):
    rows = [(1, "IW", ["VV"]), (1, "EW", ["VV", "VH"]), (2, "EW", ["HH", "HV"]), (2, "IW", ["VV"]), (3, "EW", ["HH", "HV"]), (3, "IW", ["VV", "VH"])]
    df = spark.createDataFrame(rows, "pixel int, mode string, pols array<string>")
    assert {tuple(r) for r in stats.mode_choice(df, "pixel").collect()} == {(1, "NONE"), (2, "EW"), (3, "IW")}
