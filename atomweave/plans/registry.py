"""All registered queries of the package: name -> callable, name -> oracle SQL."""

from __future__ import annotations

from atomweave.plans import aggregates, analytics, concepts, graph, grouped, relational, search, sources, spatial, streams, temporal, texts, vectors

MODULES = (search, relational, analytics, vectors, graph, texts, aggregates, spatial, temporal, streams, grouped, sources, concepts)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
