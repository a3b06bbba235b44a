"""All queries over the reference's operators, with their DuckDB counterparts."""

from __future__ import annotations

from reviewloom.plans import analysis, curation, mining, scoring, training

MODULES = (curation, mining, scoring, analysis, training)

QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}
