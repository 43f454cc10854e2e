"""Registered queries of this package."""

from __future__ import annotations

from knotwork.llm import queries_answers, queries_labels, queries_sizes, queries_text, queries_vectors

_PARTS = (queries_answers, queries_labels, queries_text, queries_vectors, queries_sizes)
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _PARTS for k, v in m.ORACLES.items()}
