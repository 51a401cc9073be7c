"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, langid, lexical, media, minhash, mixing, packing, quality, resampling, sharding, suffix_dedup, toxicity, url_filter

MODULES = (mixing, minhash, media, suffix_dedup, packing, toxicity, sharding, quality, url_filter, decontaminate, lexical, langid, resampling)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
