"""Every query of the library outside docweft.llm, by name, and its SQL."""

from __future__ import annotations

from docweft.plans import artifacts, capacity, chunking, citations, dag, documents, evidence, expansion, experts, models, outline, records, runlog, search, text

FLAGSHIP = "bm25_search"
_ALL: dict = {**artifacts.QUERIES, **text.QUERIES, **search.QUERIES, **runlog.QUERIES, **documents.QUERIES, **records.QUERIES, **chunking.QUERIES, **evidence.QUERIES, **capacity.QUERIES, **experts.QUERIES, **outline.QUERIES, **dag.QUERIES, **models.QUERIES, **expansion.QUERIES, **citations.QUERIES}
QUERIES = {name: q[0] for name, q in _ALL.items()}
ORACLE_SQL = {name: q[1] for name, q in _ALL.items() if q[1]}
