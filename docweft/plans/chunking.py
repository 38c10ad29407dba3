"""Queries over chunks and layout, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators import chunking as C
from docweft.operators import graph as G
from docweft.operators import text as X
from docweft.plans.text import BLOCKS, CHUNKS, CONTENT_TYPE, HINTS, t


def blocks(s, d):
    return X.blocks(t(s, d, "documents"))


def nodes(s, d):
    return G.nodes(blocks(s, d))


def hinted(s, d):
    chunks = X.chunks(t(s, d, "documents"))
    return X.chunk_hints(chunks).join(chunks.select("chunk_id", F.concat(F.lit("chunk "), F.col("chunk_no")).alias("section"), "text"), "chunk_id")


B = f"WITH RECURSIVE b AS ({BLOCKS}), n AS (SELECT doc_id, 'p' || page || '_n_block_' || pos AS node_id, page, pos, CASE WHEN is_heading THEN 'heading' WHEN contains(text, '|') THEN 'table' ELSE 'paragraph' END AS type, text FROM b)"
names = lambda xs: ", ".join(f"'{x}'" for x in xs)
BEGINS = " ".join(f"WHEN regexp_matches(s, '{p}') AND n <= {k} THEN page > 1" for p, k in C.BEGINNINGS)
HEADER = rf"""CASE WHEN s = '' OR length(s) > 120 OR n > 12 OR (ends_with(s, '.') AND n > 4) THEN false
  WHEN regexp_matches(s, '(?i)^Phase\s+\d+') AND n <= 10 THEN true
  WHEN lower(s) IN ({names(C.SECTION_NAMES)}) OR (n <= 5 AND len(list_filter([{names(C.SECTION_NAMES)}], lambda x: starts_with(lower(s), x))) > 0) THEN true
  WHEN page = 1 AND regexp_matches(s, '^[A-Z][A-Z\s&\-/,]{{2,}}$') AND lower(s) NOT IN ({names(C.FIRST_PAGE_NAMES)}) THEN false
  WHEN regexp_matches(s, '^[A-Z][A-Z\s&\-/,]{{3,}}$') AND n > 1 AND NOT regexp_matches(lower(s), '\b(by|at|on|for|the|of|in|and|a|an)\b') THEN page > 1
  WHEN regexp_matches(s, '^[A-Z][A-Z\s&\-/,]{{3,}}$') AND n = 1 AND lower(s) IN ({names(C.CAPITAL_NAMES)}) THEN true
  WHEN regexp_matches(s, '^\d+\.\s+[A-Z]') AND n <= 6 THEN true {BEGINS} ELSE false END"""
LINES = f"""WITH b AS ({BLOCKS}), l AS (SELECT doc_id, pos, {HEADER} AS header, text FROM (SELECT *, trim(text) AS s, len(regexp_extract_all(trim(text), '{T.NOT_SPACE}')) AS n FROM b)),
lines AS (SELECT doc_id, pos, header, coalesce(last_value(CASE WHEN header THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'unknown') AS section, text FROM l)"""
COLLAPSED = B + """, c AS (SELECT * FROM (SELECT *, coalesce(type = 'heading' AND lag(type) OVER w = 'heading' AND trim(text) = trim(lag(text) OVER w), false) AS again FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE NOT again)"""

QUERIES = {
    "section_lines": (lambda s, d: C.section_lines(blocks(s, d)), LINES + " SELECT * FROM lines"),
    "section_paragraphs": (
        lambda s, d: C.section_paragraphs(blocks(s, d)),
        LINES + f""", r AS (SELECT *, sum(header::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM lines),
g AS (SELECT doc_id, run, section, string_agg(text, chr(10) ORDER BY pos) AS text FROM r WHERE NOT header GROUP BY doc_id, run, section)
SELECT doc_id, run, section, {CONTENT_TYPE.format(ns=T.NOT_SPACE)} AS type, len(regexp_extract_all(text, '{T.NOT_SPACE}'))::INTEGER AS n_words, CASE WHEN section = 'unknown' THEN text ELSE '[Section: ' || section || ']' || chr(10) || text END AS text
FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM g)""",
    ),
    "collapse_headings": (lambda s, d: C.collapse_headings(nodes(s, d)), COLLAPSED + " SELECT * EXCLUDE (again) FROM c"),
    "merge_continued": (
        lambda s, d: C.merge_continued(nodes(s, d)),
        B + """, p AS (SELECT *, sum((type = 'heading')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS parent FROM n),
j AS (SELECT *, coalesce(type NOT IN ('heading', 'table', 'figure') AND type = lag(type) OVER w AND parent = lag(parent) OVER w AND page = lag(page) OVER w, false) AS joined FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, sum((NOT joined)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM j)
SELECT doc_id, arg_min(node_id, pos) AS first_node, count(*)::INTEGER AS n_nodes, min(page) AS page, max(page) AS page_end, type, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, run, type""",
    ),
    "section_chunks": (
        lambda s, d: C.section_chunks(nodes(s, d)),
        COLLAPSED + """, m AS (SELECT *, sum((type = 'heading')::INTEGER) OVER w AS section, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER w AS heading FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT doc_id, section::BIGINT AS section, heading, substr(sha256(doc_id || '|' || array_to_string(list_sort(list(node_id)), '|')), 1, 16) AS chunk_id, count(*)::INTEGER AS n_nodes, min(page) AS first_page, max(page) AS last_page FROM m WHERE type <> 'heading' GROUP BY doc_id, section, heading""",
    ),
    "spatial_chunks": (
        lambda s, d: C.spatial_chunks(nodes(s, d), 60),
        B + f""", a AS (SELECT *, type IN ('heading', 'section', {names(C.ALONE)}) AS alone, len(regexp_extract_all(text, '{T.NOT_SPACE}'))::INTEGER AS nw, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS r,
  coalesce(last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, pos ROWS UNBOUNDED PRECEDING), '') AS heading FROM n),
k AS (SELECT *, alone OR coalesce(lag(alone) OVER w, true) OR page <> lag(page) OVER w AS brk FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY r)),
f AS (SELECT doc_id, r, page, heading, text, nw, nw AS held, 1 AS chunk_no FROM k WHERE r = 1
  UNION ALL SELECT k.doc_id, k.r, k.page, k.heading, k.text, k.nw, CASE WHEN k.brk OR f.held + k.nw > 60 THEN k.nw ELSE f.held + k.nw END, CASE WHEN k.brk OR f.held + k.nw > 60 THEN f.chunk_no + 1 ELSE f.chunk_no END FROM f JOIN k ON k.doc_id = f.doc_id AND k.r = f.r + 1)
SELECT doc_id, chunk_no, page, heading, count(*)::INTEGER AS n_nodes, sum(nw)::INTEGER AS n_words, string_agg(text, chr(10) || chr(10) ORDER BY r) AS text FROM f GROUP BY doc_id, chunk_no, page, heading""",
    ),
    "embedding_text": (
        lambda s, d: C.embedding_text(hinted(s, d)),
        HINTS.replace(" SELECT chunk_id,", ", hints AS (SELECT chunk_id, text, 'chunk ' || chunk_no AS section,", 1) + r""")
SELECT chunk_id, concat_ws(chr(10), 'Section: ' || section, 'Section: ' || section, 'Type: ' || type, CASE WHEN keywords <> '' THEN 'Keywords: ' || keywords END, CASE WHEN trim(text) <> '' THEN trim(text) END, CASE WHEN refs <> '' THEN 'References: ' || refs END) AS text FROM hints""",
    ),
    "chunk_collections": (
        lambda s, d: C.collections(hinted(s, d)).groupBy("collection").agg(F.count("*").alias("n")),
        HINTS.replace(" SELECT chunk_id,", ", hints AS (SELECT chunk_id,", 1) + ") SELECT collection, count(*) AS n FROM (SELECT unnest(['unified', CASE WHEN type = 'table' THEN 'tables' ELSE 'paragraphs' END]) AS collection FROM hints) GROUP BY 1",
    ),
    "layout": (
        lambda s, d: C.layout(nodes(s, d)),
        B + " SELECT doc_id, string_agg(node_id, ' ' ORDER BY pos) AS reading_order, count(*) FILTER (type = 'heading') AS n_headings, count(*) FILTER (type IN ('table', 'figure')) AS n_visual FROM n GROUP BY doc_id",
    ),
    "page_graph": (
        lambda s, d: C.page_graph(blocks(s, d)),
        f"WITH b AS ({BLOCKS}), p AS (SELECT doc_id, page, sum(len(regexp_extract_all(text, '{T.NOT_SPACE}')))::BIGINT AS n_words FROM b GROUP BY ALL) SELECT doc_id, page, 'p' || page || '_n_0' AS node_id, lead('p' || page || '_n_0') OVER (PARTITION BY doc_id ORDER BY page) AS next_node, n_words FROM p",
    ),
    "document_metadata": (
        lambda s, d: C.document_metadata(t(s, d, "documents"), blocks(s, d)),
        f"WITH b AS ({BLOCKS}), f AS (SELECT doc_id, arg_min(text, pos) AS first, max(page) AS pages FROM b GROUP BY doc_id) SELECT doc_id, coalesce(substr(first, 1, 100), 'Untitled') AS title, coalesce(nullif(trim(lang), ''), 'en') AS language, coalesce(nullif(trim(source), ''), 'unknown') AS origin, coalesce(pages, 0) AS page_count FROM documents LEFT JOIN f USING (doc_id)",
    ),
}
