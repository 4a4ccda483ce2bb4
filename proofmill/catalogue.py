"""The queries of the evidence engine: name to (query, DuckDB SQL of the same rows or None)."""

from __future__ import annotations

from proofmill.operators import documents, evidence, extraction, integrity, offsets, prompts, spans
from proofmill.plans import arms, decisions, evaluation, flips, operations, review, rules, snapshot
from proofmill.sources import deletion, schemas

QUERIES = {**operations.QUERIES, **documents.QUERIES, **offsets.QUERIES, **spans.QUERIES, **prompts.QUERIES, **evidence.QUERIES, **integrity.QUERIES, **rules.QUERIES, **evaluation.QUERIES, **review.QUERIES, **snapshot.QUERIES, **flips.QUERIES, **arms.QUERIES, **decisions.QUERIES, **deletion.QUERIES, **schemas.QUERIES, **extraction.QUERIES}
