"""The training-data queries: name -> callable, name -> oracle SQL."""

from __future__ import annotations

from atomweave.llm import (
    queries_chat,
    queries_fingerprint,
    queries_jaccard,
    queries_language,
    queries_merge,
    queries_neighbours,
    queries_packing,
    queries_secrets,
    queries_sentencepiece,
    queries_spelling,
    queries_toxicity,
    queries_url,
    queries_warc,
)

MODULES = (queries_warc, queries_language, queries_fingerprint, queries_jaccard, queries_neighbours, queries_chat, queries_packing, queries_toxicity, queries_url, queries_sentencepiece, queries_merge, queries_secrets, queries_spelling)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
