"""Queries over texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators import text as X

SPACE, UNPRINTABLE = T.SPACE, T.UNPRINTABLE


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def quality_sql(table: str) -> str:
    return rf"""
SELECT doc_id, CASE WHEN blank THEN 0.0 ELSE 1.0 - CASE WHEN n > 0 THEN (n - np)::DOUBLE / n ELSE 0.0 END END AS printable_ratio,
  CASE WHEN blank THEN 0.0 WHEN w > 0 THEN ns::DOUBLE / w ELSE 0.0 END AS avg_word_length,
  CASE WHEN blank THEN 0.0 WHEN n > 0 THEN (n - ns)::DOUBLE / n ELSE 0.0 END AS whitespace_ratio,
  CASE WHEN blank THEN 0.0 ELSE greatest(100.0
    - CASE WHEN 1.0 - CASE WHEN n > 0 THEN (n - np)::DOUBLE / n ELSE 0.0 END < 0.8 THEN 30.0 ELSE 0.0 END
    - CASE WHEN CASE WHEN w > 0 THEN ns::DOUBLE / w ELSE 0.0 END BETWEEN 3.0 AND 12.0 THEN 0.0 ELSE 35.0 END
    - CASE WHEN CASE WHEN n > 0 THEN (n - ns)::DOUBLE / n ELSE 0.0 END < 0.1 THEN 35.0 ELSE 0.0 END, 0.0)::DOUBLE END AS score
FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '{UNPRINTABLE}', '', 'g')) AS np, length(regexp_replace(text, '{SPACE}', '', 'g')) AS ns,
  len(regexp_extract_all(text, '{T.NOT_SPACE}')) AS w, regexp_replace(text, '{SPACE}', '', 'g') = '' AS blank FROM {table})"""


GATE_TEXT = """(SELECT doc_id, substr(text, 1, 2000) || CASE WHEN length(text) > 4000 THEN substr(text, (length(text) // 2) - 999, 2000) ELSE '' END
  || CASE WHEN length(text) > 2000 THEN substr(text, greatest(length(text) - 999, 1), 1000) ELSE '' END AS text FROM documents)"""

COHERENCE = r"""CASE WHEN length(trim({c})) < 20 THEN 0.0 ELSE round((
  CASE WHEN len(regexp_extract_all({c}, '[a-zA-Z]{{2,}}')) > 0 THEN greatest(0.0, 100.0 - abs(length(array_to_string(regexp_extract_all({c}, '[a-zA-Z]{{2,}}'), ''))::DOUBLE / len(regexp_extract_all({c}, '[a-zA-Z]{{2,}}')) - 6.0) * 15.0) ELSE 0.0 END * 40.0
  + least(100.0, greatest(0.0, (length(array_to_string(regexp_extract_all({c}, '[a-zA-Z]{{2,}}'), ''))::DOUBLE / greatest(length(regexp_replace({c}, '\s', '', 'g')), 1) - 0.35) / 0.5 * 100.0)) * 30.0
  + CASE WHEN len(list_filter(string_split({c}, chr(10)), lambda x: trim(x) <> '')) > 0 THEN len(list_filter(string_split({c}, chr(10)), lambda x: trim(x) <> '' AND len(regexp_extract_all(x, '[a-zA-Z]{{2,}}')) >= 2)) * 100.0::DOUBLE / len(list_filter(string_split({c}, chr(10)), lambda x: trim(x) <> '')) ELSE 0.0 END * 30.0) / 100.0, 1) END::DOUBLE"""

BLOCKS = r"""SELECT doc_id, pos::INTEGER AS pos, (pos // 5 + 1)::INTEGER AS page, text,
  length(text) < 100 AND (upper(text) = text OR regexp_matches(text, '^(#|Section|Chapter|Introduction)')) AS is_heading
FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, trim(unnest(string_split(text, chr(10)))) AS text FROM documents) WHERE text <> ''"""

CHUNKS = f"""WITH b AS ({BLOCKS}), m AS (SELECT *, sum(is_heading::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chunk_no FROM b),
chunks AS (SELECT doc_id, chunk_no::BIGINT AS chunk_no, 'chunk_' || doc_id || '_' || chunk_no AS chunk_id, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) AS n_blocks, min(page) AS first_page, max(page) AS last_page FROM m GROUP BY doc_id, chunk_no)"""

CONTENT_TYPE = r"""CASE WHEN len(ls) = 0 THEN 'paragraph' WHEN len(list_filter(ls, lambda x: contains(x, '|'))) >= 2 THEN 'table'
  WHEN len(list_filter(ls, lambda x: regexp_matches(trim(x), '^([•*–-]|\d+[.)]\s)'))) * 2 > len(ls) THEN 'list'
  WHEN len(ls) = 1 AND length(trim(text)) < 100 AND len(regexp_extract_all(text, '{ns}')) <= 6 THEN 'heading' ELSE 'paragraph' END"""

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
HINTS = (
    CHUNKS
    + rf""" SELECT chunk_id, {CONTENT_TYPE.format(ns=T.NOT_SPACE)} AS type,
  array_to_string(list_slice(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{5,}}')), lambda x: x NOT IN ({STOP}))), 1, 8), ' ') AS keywords,
  substr(array_to_string(list_slice({SENTENCES}, 1, 2), ' '), 1, 200) AS summary,
  array_to_string(list_transform(list_filter(list_transform(range(1, len(r) + 1), lambda i: {{'i': i, 'x': r[i]}}), lambda y: list_position(r, y.x) = y.i), lambda y: y.x), ',') AS refs,
  len(regexp_extract_all(text, '{T.NOT_SPACE}'))::INTEGER AS n_tokens
FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls, regexp_extract_all(text, '(?:Table|Figure)\s+\d+') AS r FROM chunks)"""
)

INJECT = "|".join(X.INJECTION)

QUERIES = {
    "text_quality": (lambda s, d: X.quality(t(s, d, "documents")), quality_sql("documents")),
    "quality_gate": (
        lambda s, d: X.quality_gate(t(s, d, "documents")),
        f"WITH s AS ({quality_sql(GATE_TEXT)}) SELECT s.doc_id, score, CASE WHEN length(trim(text)) < 10 THEN 'rejected' WHEN score < 50 THEN 'warning' ELSE 'passed' END AS verdict FROM s JOIN documents USING (doc_id)",
    ),
    "text_coherence": (
        lambda s, d: t(s, d, "documents").select("doc_id", X.coherence("text").alias("coherence")),
        f"SELECT doc_id, {COHERENCE.format(c='text')} AS coherence FROM documents",
    ),
    "route_documents": (
        lambda s, d: X.route(t(s, d, "documents")),
        rf"""SELECT *, CASE WHEN reason = 'text layer' THEN 'DIGITAL' ELSE 'SCANNED' END AS route FROM (
SELECT *, CASE WHEN chars_a_page < 30 THEN 'few characters' WHEN empty_share > 0.4 THEN 'empty pages' WHEN coherence < 50 THEN 'incoherent text' ELSE 'text layer' END AS reason FROM (
SELECT doc_id, pages, length(regexp_replace(f, '\s', '', 'g'))::DOUBLE / pages AS chars_a_page, round(len(list_filter(range(1, pages + 1), lambda k: regexp_replace(array_to_string(list_slice(l, (k - 1) * 5 + 1, k * 5), ''), '\s', '', 'g') = ''))::DOUBLE / pages, 4)::DOUBLE AS empty_share, {COHERENCE.format(c="f")} AS coherence FROM (
SELECT doc_id, string_split(text, chr(10)) AS l, least(5, ceil(len(string_split(text, chr(10)))::DOUBLE / 5))::INTEGER AS pages, array_to_string(list_slice(string_split(text, chr(10)), 1, 25), chr(10)) AS f FROM documents)))""",
    ),
    "quality_confusion": (
        lambda s, d: X.confusion(X.quality(t(s, d, "documents")).select("doc_id", (F.col("score") >= 70).cast("int").alias("predicted")), t(s, d, "labels").select("doc_id", F.col("quality").alias("expected"))),
        f"WITH q AS ({quality_sql('documents')}) SELECT quality AS expected, (score >= 70)::INTEGER AS predicted, count(*) AS n FROM q JOIN labels USING (doc_id) GROUP BY ALL",
    ),
    "triage_lines": (
        lambda s, d: X.triage(t(s, d, "documents")),
        """SELECT doc_id, len(l)::INTEGER AS n_flagged, array_to_string(list_slice(l, 1, 5), chr(10)) AS first_flagged FROM (
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND regexp_matches(x, '(?i)(error|warn|fail|critical)')) AS l FROM documents) WHERE len(l) > 0""",
    ),
    "injection_flags": (
        lambda s, d: X.flag_injection(t(s, d, "conversations"), "text").groupBy("role", "flagged").agg(F.count("*").alias("n")),
        f"SELECT role, regexp_matches(text, '(?i)({INJECT})') AS flagged, count(*) AS n FROM conversations GROUP BY ALL",
    ),
    "sanitize_pages": (
        lambda s, d: t(s, d, "pages").select("page_id", X.sanitize("html").alias("clean")),
        "SELECT page_id, trim(substr(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), chr(10), ' '), chr(13), ''), 1, 2000)) AS clean FROM pages",
    ),
    "blocks": (lambda s, d: X.blocks(t(s, d, "documents")), BLOCKS),
    "sections": (
        lambda s, d: X.sections(X.blocks(t(s, d, "documents"))),
        f"WITH b AS ({BLOCKS}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS section, pos, text AS title FROM b WHERE is_heading",
    ),
    "semantic_chunks": (
        lambda s, d: X.chunks(t(s, d, "documents")),
        CHUNKS + " SELECT *, lag(chunk_id) OVER w AS previous_chunk, lead(chunk_id) OVER w AS next_chunk FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)",
    ),
    "chunk_hints": (lambda s, d: X.chunk_hints(X.chunks(t(s, d, "documents"))), HINTS),
    "lead_summary": (
        lambda s, d: X.lead_summary(X.chunks(t(s, d, "documents"))),
        CHUNKS + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS r FROM chunks) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_no) AS summary FROM r WHERE r <= 2 GROUP BY doc_id",
    ),
    "contract_report": (
        lambda s, d: X.contract_report(t(s, d, "documents")),
        "SELECT doc_id, 'empty_text' AS reason FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT doc_id, 'duplicate_content' FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE trim(coalesce(text, '')) <> '') WHERE n > 1",
    ),
    "parent_child_chunks": (
        lambda s, d: X.parent_child(t(s, d, "documents")),
        r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 51, 0) + 1, 250)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, (start // 1200)::INTEGER AS parent_no, (start // 250)::INTEGER AS child_no, len(w[start + 1 : start + 300])::INTEGER AS n_words, array_to_string(w[start + 1 : start + 300], ' ') AS text FROM s""",
    ),
}
