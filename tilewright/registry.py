"""Every registered query over the reference tables and the SQL twins."""

from __future__ import annotations

from .functions import scalar
from .operators import catalog, fields, geodesy, metrics, outlines, projection, raster, sampling, spatial, stats, table_functions, vectors
from .plans import decisions, integrity, round_trips, suites
from .streaming import state

MODULES = (catalog, fields, stats, metrics, sampling, spatial, scalar, raster, outlines, table_functions, geodesy, vectors, projection, state, decisions, suites, integrity, round_trips)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
