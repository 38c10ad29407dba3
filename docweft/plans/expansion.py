"""Queries over the chunk graph, each with its SQL."""

from __future__ import annotations

from docweft.operators import expansion as E
from docweft.operators import text as X
from docweft.plans import search as P
from docweft.plans.documents import hits
from docweft.plans.text import BLOCKS, t

RELATIONS = P.BASE + f"""b AS ({BLOCKS}),
bb AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS after, min(pos) OVER (PARTITION BY doc_id, page) AS head FROM b),
heads AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, pos) <= 11),
allr AS (SELECT doc_id, pos, 'neighbor' AS relation, doc_id AS to_doc, before AS to_pos FROM bb WHERE before IS NOT NULL UNION ALL SELECT doc_id, pos, 'neighbor', doc_id, after FROM bb WHERE after IS NOT NULL
  UNION ALL SELECT doc_id, pos, 'parent', doc_id, head FROM bb WHERE head <> pos UNION ALL SELECT doc_id, head, 'child', doc_id, pos FROM bb WHERE head <> pos
  UNION ALL SELECT b.doc_id, b.pos, 'cross_ref', h.doc_id, h.pos FROM b JOIN heads h ON h.text = b.text AND (h.doc_id <> b.doc_id OR h.pos <> b.pos)),
rel AS (SELECT * FROM allr QUALIFY row_number() OVER (PARTITION BY doc_id, pos, relation ORDER BY to_doc, to_pos) <= 10),
w(relation, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in E.WEIGHTS.items())}),
h AS (SELECT query_id, doc_id, pos, max(score) AS score FROM (SELECT query_id, doc_id, pos, score, unnest({P.TOKENS.format(c='b.text')}) AS term FROM bm JOIN b USING (doc_id)) JOIN terms USING (query_id, term) WHERE length(term) >= 8 GROUP BY ALL),
l0 AS (SELECT query_id, doc_id, pos, score, score AS origin, 0 AS hop, 'original' AS relations FROM h)"""


def hop(k: int) -> str:
    seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM l{j} s WHERE s.query_id = l.query_id AND s.doc_id = r.to_doc AND s.pos = r.to_pos)" for j in range(k))
    return f""", l{k} AS (SELECT l.query_id, r.to_doc AS doc_id, r.to_pos AS pos, max(l.origin * weight * {E.DECAY ** (k - 1)!r}::DOUBLE) AS score, arg_max(l.origin, (l.origin * weight * {E.DECAY ** (k - 1)!r}::DOUBLE, l.origin)) AS origin, {k} AS hop,
  array_to_string(list_sort(list_distinct(list(r.relation))), ',') AS relations FROM l{k - 1} l JOIN rel r ON r.doc_id = l.doc_id AND r.pos = l.pos JOIN w ON w.relation = r.relation WHERE true {seen} GROUP BY l.query_id, r.to_doc, r.to_pos)"""


def expanded_sql(depth: int) -> str:
    return RELATIONS + "".join(hop(k) for k in range(1, depth + 1)) + f""", u AS ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(depth + 1))}),
r AS (SELECT query_id, doc_id, pos, round(score, 5) AS score, hop, relations FROM u)
SELECT query_id, place, doc_id, pos, score, hop, relations FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos)::INTEGER AS place FROM r) WHERE place <= {E.A_QUERY}"""


def expanded(depth):
    return lambda s, d: E.expand_chunks(hits(s, d), E.block_relations(X.blocks(t(s, d, "documents"))), depth)


QUERIES = {"expand_chunks": (expanded(1), expanded_sql(1)), "expand_chunks_twice": (expanded(2), expanded_sql(2))}
