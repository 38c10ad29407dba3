"""Citations in all three ways and the whole check of answers, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.operators import citations as C
from docweft.plans import search as P
from docweft.plans.evidence import CITED, cited
from docweft.plans.text import t


def context(s, d):
    """The ten best documents of each query as its context."""
    found = P.bm25(s, d).select(F.col("query_id").alias("answer_id"), "rank", "doc_id")
    return found.join(t(s, d, "documents").select("doc_id", "text"), "doc_id").select("answer_id", "rank", F.concat(F.lit("chunk_"), "doc_id").alias("chunk_id"), "text")


def answers(s, d):
    return cited(s, d).withColumnRenamed("query_id", "answer_id")


def marked(s, d):
    """The answers, each with a last sentence that names its first document by the chunk's id."""
    first = P.bm25(s, d).filter("rank = 1").select(F.col("query_id").alias("answer_id"), F.concat(F.lit("[chunk_"), "doc_id", F.lit("]")).alias("mark"))
    return answers(s, d).join(first, "answer_id").select("answer_id", F.concat("text", F.lit(" See also "), "mark", F.lit(".")).alias("text"))


QUERIES = {
    "build_citations": (
        lambda s, d: C.build_citations(marked(s, d), context(s, d)).drop("snippet"),
        CITED + r""", mk AS (SELECT query_id AS answer_id, unnest(regexp_extract_all(text, '\[(\d{1,9})\]', 1))::INTEGER AS rank, generate_subscripts(regexp_extract_all(text, '\[(\d{1,9})\]', 1), 1) - 1 AS i FROM cited),
al AS (SELECT cited.query_id AS answer_id, 0 AS way, 0 AS i, 'cit_1' AS citation_id, 'chunk_' || doc_id AS chunk_id, bm.rank FROM cited JOIN bm ON bm.query_id = cited.query_id AND bm.rank = 1
  UNION ALL SELECT mk.answer_id, 1, mk.i, 'cit_num_' || mk.rank, 'chunk_' || doc_id, mk.rank FROM mk JOIN bm ON bm.query_id = mk.answer_id AND bm.rank = mk.rank)
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY way, i)::INTEGER AS place, citation_id, chunk_id, rank FROM (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY answer_id, chunk_id ORDER BY way, i) = 1)""",
    ),
    "verify_answers_fully": (
        lambda s, d: C.verify_answers(answers(s, d), context(s, d)),
        CITED + r""", cx AS (SELECT query_id, lower(string_agg(coalesce(text, ''), ' ' ORDER BY rank)) AS cx FROM bm JOIN documents USING (doc_id) GROUP BY 1),
v AS (SELECT cited.query_id AS answer_id, text, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+') AND NOT contains(cx, lower(x))))::INTEGER AS n_unsupported,
  len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[0-9]{3,}') AND NOT contains(cx, x)))::INTEGER AS n_contradictions,
  len(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 30 AND NOT regexp_matches(x, '\[[0-9]+\]')))::INTEGER AS n_uncited FROM cited JOIN cx USING (query_id)),
w AS (SELECT *, CASE WHEN text = '' THEN 0.0 ELSE round(greatest(0.0, 1.0::DOUBLE - (n_unsupported + n_contradictions + n_uncited) * 0.15::DOUBLE), 2) END::DOUBLE AS score FROM v)
SELECT answer_id, n_unsupported, n_contradictions, n_uncited, score, score >= 0.7 AND n_unsupported = 0 AND n_contradictions = 0 AS valid FROM w""",
    ),
}
