"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from docweft.llm import bpe, extraction, lines, mixing, neardup, periods, quality, repair, simhash, substrings, suffixes, topk, toxicity

OP6_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM src),
f AS (SELECT *, cap::DOUBLE / weight AS full_at, sum(source_size) OVER ()::DOUBLE AS whole, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (whole - coalesce(sum(cap) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level, row_number() OVER (ORDER BY full_at, source IS NULL, encode(source)) AS turn FROM f
      WINDOW b AS (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, (SELECT arg_min(level, turn) FROM l WHERE level < full_at) AS open_level FROM l),
t AS (SELECT source, source_size, CASE WHEN open_level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, open_level * weight) END AS target FROM o),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS certain FROM t),
d AS (SELECT s.*, c.source_size, c.target, c.certain, greatest(c.target - c.certain * c.source_size, 0) AS wanted,
        ((('0x' || substr(md5('17|' || s.doc_id), 1, 12))::BIGINT) + 0.5) / 281474976710656.0 AS u
      FROM sized s JOIN c ON s.source IS NOT DISTINCT FROM c.source),
hs AS (SELECT source, size, count(*) AS n, any_value(wanted) AS wanted FROM d WHERE size > 0 GROUP BY source, size),
hw AS (SELECT source, size, wanted - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
        (sum(size::HUGEINT * size * n) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS squares FROM hs),
pw AS (SELECT source, arg_max(rest / squares, size) AS per_word FROM hw WHERE rest * size <= squares GROUP BY source),
i AS (SELECT d.*, least(greatest(least(1.0::DOUBLE, size * coalesce(per_word, 0.0)::DOUBLE), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p FROM d LEFT JOIN pw ON d.source IS NOT DISTINCT FROM pw.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)), doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM i)
SELECT doc_id, size, source_size, target,
  (size * (certain + CASE WHEN wanted > 0 AND wanted > run - size AND (run <= wanted OR run - wanted < wanted - (run - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND len(q.v) = len(e.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id),
m AS (SELECT id AS doc_id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
s AS (SELECT l.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, word_chars::DOUBLE / greatest(n_words, 1) / 50.0::DOUBLE AS mean FROM s),
r AS (SELECT doc_id, stratum, base_failed, rule, floor(least(greatest(score, 0.0), 1.0) * 400)::INTEGER AS step FROM (SELECT doc_id, stratum, base_failed,
        unnest([{'rule': 1, 'score': n_symbols::DOUBLE / greatest(n_words, 1)}, {'rule': 2, 'score': n_dup_lines::DOUBLE / greatest(n_lines, 1)}, {'rule': 3, 'score': n_repeat_words::DOUBLE / greatest(n_words, 1)},
                {'rule': 4, 'score': mean}, {'rule': 5, 'score': 1.0::DOUBLE - least(mean, 1.0)}], recursive := true) FROM b)),
g AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
c AS (SELECT stratum, rule, step, count(*) AS c FROM r JOIN g USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
a AS (SELECT *, sum(c) OVER (PARTITION BY stratum, rule ORDER BY step DESC) AS rejected, sum(c) OVER (PARTITION BY stratum, rule) AS n FROM c),
e AS (SELECT stratum, rule, any_value(n)::BIGINT AS n, count(*) OVER () AS tests FROM a GROUP BY stratum, rule),
p AS (SELECT stratum, rule, 0.05::DOUBLE / tests AS error, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.02::DOUBLE / 5) + (n - k) * ln(1 - 0.02::DOUBLE / 5))) OVER (PARTITION BY stratum, rule ORDER BY k) AS total
      FROM (SELECT *, unnest(range(0, ceil(n * 0.02::DOUBLE / 5)::BIGINT + 1)) AS k FROM e) WHERE k <= n),
m AS (SELECT stratum, rule, coalesce(max(k) FILTER (total <= error), -1) AS k FROM p GROUP BY ALL),
q AS (SELECT m.stratum, m.rule, CASE WHEN m.k < 0 THEN 401 ELSE coalesce(max(a.step) FILTER (a.rejected > m.k) + 1, 0) END AS cutoff FROM m JOIN a ON a.rule = m.rule AND a.stratum IS NOT DISTINCT FROM m.stratum GROUP BY m.stratum, m.rule, m.k),
v AS (SELECT DISTINCT doc_id FROM r JOIN q ON q.rule = r.rule AND q.stratum IS NOT DISTINCT FROM r.stratum WHERE step >= cutoff)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND v.doc_id IS NULL AS kept FROM b LEFT JOIN v USING (doc_id)
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM later),
each AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM w),
kept AS (SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(e.word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS text FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op1_html_extraction": extraction.op1, "op2_line_dedup": lines.op2, "op3_topk": topk.op3, "op4_toxicity": toxicity.op4, "op5_minhash_near_dedup": neardup.op5, "op6_mix_sources": mixing.op6, "op7_quality_rules": quality.op7, "op8_suffix_dedup": suffixes.op8, "op9_bpe": bpe.op9, "op10_substring_dedup": substrings.op10, "op11_conversation_repair": repair.op11, "op12_simhash_near_dedup": simhash.op12, "op13_periodic_runs": periods.op13}
ORACLE_SQL = {"op3_topk": OP3_SQL, "op5_minhash_near_dedup": OP5_SQL, "op6_mix_sources": OP6_SQL, "op7_quality_rules": OP7_SQL, "op10_substring_dedup": OP10_SQL}
