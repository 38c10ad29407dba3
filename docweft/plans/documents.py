"""Queries over graphs, answers, sources and registries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft import functions as T
from docweft import sources as O
from docweft.operators import answers as A
from docweft.operators import graph as G
from docweft.operators import search as S
from docweft.operators import text as X
from docweft.plans import search as P
from docweft.plans.text import BLOCKS, t


def nodes(s, d):
    return G.nodes(X.blocks(t(s, d, "documents")))


def edges(s, d):
    return G.edges(nodes(s, d))


def some_edges(s, d):
    """Edges, a few of which lead nowhere: what a graph looks like after nodes have been dropped."""
    return edges(s, d).withColumn("target", F.when(F.col("target").endswith("_7"), "gone").otherwise(F.col("target")))


def seeds(s, d):
    return nodes(s, d).filter("pos = 0").select("doc_id", "node_id")


def hits(s, d):
    """The blocks of each query's documents that have one of its longer words."""
    words = F.explode(F.array_distinct(T.tokens("text")))
    long = P.asked(s, d).select("query_id", words.alias("term")).filter("length(term) >= 8")
    found = P.bm25(s, d).select("query_id", "doc_id", "score").join(nodes(s, d).select("doc_id", "pos", words.alias("term")), "doc_id")
    return found.join(long, ["query_id", "term"], "left_semi").select("query_id", "doc_id", "pos", "score").distinct()


def ranked(s, d):
    return P.bm25(s, d).select("query_id", "rank", "doc_id").join(t(s, d, "documents").select("doc_id", "text"), "doc_id")


def conversations(s, d):
    return t(s, d, "conversations")


def answers(s, d):
    rows = conversations(s, d).filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "text")
    context = conversations(s, d).filter("role = 'user'").select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("answer_id"), "text")
    return rows, context


def registry(s, d):
    """What is known already: even documents at version 1; then all documents at the version their length gives."""
    docs = O.identify(t(s, d, "documents"))
    old = docs.filter("doc_id % 2 = 0").groupBy("document_id").agg(F.lit(1).cast("long").alias("version"), F.min("doc_id").alias("created_at"))
    new = docs.groupBy("document_id").agg((F.max("n_chars") % 7).alias("version"), (F.min("doc_id") + 1_000_000).alias("created_at"))
    return docs, old, new


def manifest(s, d):
    blocks, conv = X.blocks(t(s, d, "documents")), conversations(s, d)
    return O.manifest({"blocks": blocks.select("doc_id", F.col("pos").cast("long").alias("ord"), F.col("text").alias("item")), "turns": conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("text").alias("item"))})


def files(s, d):
    kinds = F.array(*[F.lit(x) for x in ("application/pdf", "text/plain", "video/mp4")])
    ends = F.array(*[F.lit(x) for x in (".pdf", ".TXT", ".exe", "")])
    return t(s, d, "pages").select(F.concat(F.lit("page"), "page_id", F.get(ends, (F.col("page_id") % 4).cast("int"))).alias("name"), F.get(kinds, (F.col("page_id") % 3).cast("int")).alias("mime"), (F.length("html") * 4000).cast("long").alias("bytes"))


def brands(s, d):
    p = t(s, d, "part")
    return O.split_tables(p.select("p_brand", "p_partkey", F.concat_ws(" | ", F.col("p_partkey").cast("string"), "p_name", "p_type").alias("line")), "p_brand", "line", "p_partkey")


def global_search(s, d, text="9"):
    names = {"supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name"), "nation": ("n_nationkey", "n_name")}
    out = None
    for name, (key, col) in names.items():
        one = t(s, d, name).filter(F.col(col).contains(text)).orderBy(key).limit(10).select(F.lit(name).alias("source"), F.col(key).cast("long").alias("id"), F.col(col).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


B = f"WITH RECURSIVE b AS ({BLOCKS}), n AS (SELECT doc_id, 'p' || page || '_n_block_' || pos AS node_id, page, pos, CASE WHEN is_heading THEN 'heading' WHEN contains(text, '|') THEN 'table' ELSE 'paragraph' END AS type, text FROM b)"
E = (
    B
    + """, a AS (SELECT doc_id, node_id AS source, page, lead(node_id) OVER w AS target, lead(page) OVER w AS np FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
e AS (SELECT doc_id, source, target, CASE WHEN page = np THEN 'next' ELSE 'page_next' END AS type FROM a WHERE target IS NOT NULL UNION ALL SELECT doc_id, 'doc_' || doc_id, node_id, 'contains' FROM n),
x AS (SELECT doc_id, source, CASE WHEN suffix(target, '_7') THEN 'gone' ELSE target END AS target, type FROM e)"""
)
MIME = ", ".join(f"'{m}'" for m in O.MIME_TYPES)
EXT = ", ".join(f"'{m}'" for m in O.EXTENSIONS)
INTENT = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for k, p in A.INTENTS.items()) + " ELSE 'hybrid' END"
N_INTENT = " + ".join(f"regexp_matches(x, '{p}')::INTEGER" for p in A.INTENTS.values())
SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
TOK = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
SCORED = P.BASE + f"""se AS (SELECT query_id, rank, doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT query_id, rank, doc_id, {SENT} AS s FROM bm JOIN documents USING (doc_id))),
q AS (SELECT query_id, list_distinct({TOK.format(c='text')}) AS q FROM asked),
h AS (SELECT se.*, list_filter({TOK.format(c='sentence')}, lambda w: list_contains(q, w)) AS hits FROM se JOIN q USING (query_id)),
sc2 AS (SELECT query_id, rank, doc_id, pos, sentence, round((5.0::DOUBLE * len(list_distinct(hits)) + 0.5::DOUBLE * len(hits)) * 10.0 / rank, 4) AS score FROM h),
one AS (SELECT * FROM sc2 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, sentence ORDER BY score DESC, rank, doc_id, pos) = 1)
"""

QUERIES = {
    "layout_nodes": (nodes, B + " SELECT * FROM n"),
    "layout_edges": (edges, E + " SELECT * FROM e"),
    "repair_graph": (
        lambda s, d: G.repair(nodes(s, d).withColumn("page", F.col("page") * 2).withColumn("node_id", F.when(F.col("pos") % 6 != 5, F.concat(F.lit("n"), F.floor(F.col("pos") / 2))))),
        B + """, r AS (SELECT doc_id, CASE WHEN pos % 6 <> 5 THEN 'n' || (pos // 2) END AS node_id, page * 2 AS page, pos FROM n)
SELECT doc_id, CASE WHEN node_id IS NULL OR row_number() OVER (PARTITION BY doc_id, node_id ORDER BY pos) > 1 THEN concat_ws('_', coalesce(node_id, 'node'), pos) ELSE node_id END AS node_id,
  dense_rank() OVER (PARTITION BY doc_id ORDER BY page)::INTEGER AS page, pos FROM r""",
    ),
    "validate_graph": (
        lambda s, d: G.validate(nodes(s, d), some_edges(s, d)),
        E + """, m AS (SELECT doc_id, source AS node_id FROM x WHERE type <> 'contains' UNION SELECT doc_id, target FROM x WHERE type <> 'contains')
SELECT doc_id, 'unknown_target' AS issue, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = x.doc_id AND n.node_id = x.target) GROUP BY 1
UNION ALL SELECT doc_id, 'orphan', count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = n.doc_id AND m.node_id = n.node_id) GROUP BY 1
UNION ALL SELECT doc_id, 'duplicate_id', count(*) FROM (SELECT doc_id, node_id FROM n GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT doc_id, 'page_order', count(*) FROM (SELECT doc_id, page, lag(page) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM n) WHERE page < p GROUP BY 1""",
    ),
    "graph_profile": (
        lambda s, d: G.profile(nodes(s, d), edges(s, d)),
        E + " SELECT * FROM (SELECT doc_id, " + ", ".join(f"count(*) FILTER (type = '{k}') AS n_{k}" for k in ("heading", "table", "paragraph")) + " FROM n GROUP BY 1) JOIN (SELECT doc_id, " + ", ".join(f"count(*) FILTER (type = '{k}') AS e_{k}" for k in ("next", "page_next", "contains")) + " FROM e GROUP BY 1) USING (doc_id)",
    ),
    "closed_edges": (
        lambda s, d: G.closed(nodes(s, d), some_edges(s, d)),
        E + " SELECT * FROM x WHERE EXISTS (SELECT 1 FROM n WHERE n.doc_id = x.doc_id AND n.node_id = x.target) AND EXISTS (SELECT 1 FROM n WHERE n.doc_id = x.doc_id AND n.node_id = x.source)",
    ),
    "graph_bfs": (
        lambda s, d: G.bfs(edges(s, d).filter("type <> 'contains'"), seeds(s, d)),
        E + """, w AS (SELECT doc_id, source AS a, target AS b FROM e WHERE type <> 'contains' UNION SELECT doc_id, target, source FROM e WHERE type <> 'contains'),
r AS (SELECT doc_id, node_id, 0 AS depth FROM n WHERE pos = 0 UNION SELECT r.doc_id, w.b, depth + 1 FROM r JOIN w ON w.doc_id = r.doc_id AND w.a = r.node_id WHERE depth < 3)
SELECT doc_id, node_id, min(depth) AS depth FROM r GROUP BY ALL""",
    ),
    "expand_neighbours": (
        lambda s, d: G.expand(hits(s, d), nodes(s, d)),
        P.BASE + f"""b AS ({BLOCKS}), h AS (SELECT DISTINCT query_id, doc_id, pos, score FROM (SELECT query_id, doc_id, pos, score, unnest({P.TOKENS.format(c='b.text')}) AS term FROM bm JOIN b USING (doc_id)) JOIN terms USING (query_id, term) WHERE length(term) >= 8),
g AS (SELECT query_id, doc_id, pos + o AS pos, score * w AS score FROM h, (VALUES (0, 1.0::DOUBLE), (-1, 0.8::DOUBLE), (1, 0.8::DOUBLE), (-2, 0.56::DOUBLE), (2, 0.56::DOUBLE)) v(o, w))
SELECT query_id, doc_id, pos, round(max(score), 5) AS score FROM g WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = g.doc_id AND b.pos = g.pos) GROUP BY ALL""",
    ),
    "graph_parity": (
        lambda s, d: G.parity(nodes(s, d)),
        B + """, u AS (SELECT doc_id // 2 AS pair, text, max((doc_id % 2 = 0)::INTEGER) AS a, max((doc_id % 2 = 1)::INTEGER) AS b FROM n GROUP BY 1, 2),
v AS (SELECT pair, sum(a)::BIGINT AS l, sum(b)::BIGINT AS r, sum(a * b)::BIGINT AS c FROM u GROUP BY 1)
SELECT pair, r - c AS added, l - c AS removed, round(least(l, r)::DOUBLE / greatest(l, r), 4) AS structural, round(c::DOUBLE / (l + r - c), 4) AS textual FROM v""",
    ),
    "route_queries": (
        lambda s, d: A.route(conversations(s, d).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")),
        f"SELECT conv_id || '-' || turn AS query_id, {INTENT} AS intent, ({N_INTENT})::INTEGER AS n_intents, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(x, '[a-z]{{6,}}'))), 1, 5), ' ') AS keywords FROM (SELECT *, lower(text) AS x FROM conversations)",
    ),
    "analyze_queries": (
        lambda s, d: A.analyze(conversations(s, d).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")),
        rf"""SELECT query_id, n_words, n_capitalised, n_numbers, CASE WHEN n_words > 20 THEN 'high' WHEN n_words > 8 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT conv_id || '-' || turn AS query_id,
  len(regexp_extract_all(text, '{X.T.NOT_SPACE}'))::INTEGER AS n_words, len(regexp_extract_all(text, '(?:^|\s)[A-Z][a-z]+'))::INTEGER AS n_capitalised, len(regexp_extract_all(text, '[0-9]{{3,}}'))::INTEGER AS n_numbers FROM conversations)""",
    ),
    "pack_context": (
        lambda s, d: A.pack_context(ranked(s, d)),
        P.BASE + rf"""z AS (SELECT query_id, rank, doc_id, len(regexp_extract_all(text, '{X.T.NOT_SPACE}')) AS n_words FROM bm JOIN documents USING (doc_id)),
y AS (SELECT *, 600 - coalesce(sum(n_words) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM z)
SELECT query_id, rank, doc_id, n_words::INTEGER AS n_words, used FROM (SELECT *, (CASE WHEN n_words <= rest THEN n_words WHEN rest > 50 THEN rest ELSE 0 END)::BIGINT AS used FROM y) WHERE used > 0""",
    ),
    "extract_answers": (
        lambda s, d: A.extract(P.asked(s, d), ranked(s, d)),
        SCORED + "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id, pos)::INTEGER AS place, doc_id, sentence, score FROM one) WHERE place <= 4",
    ),
    "verify_answers": (
        lambda s, d: A.verify(*answers(s, d)),
        """SELECT answer_id, n::INTEGER AS n_unsupported, round(greatest(1.0::DOUBLE - n * 0.15::DOUBLE, 0.0), 2)::DOUBLE AS score FROM (SELECT a.conv_id || '-' || a.turn AS answer_id,
  len(list_filter(list_distinct(regexp_extract_all(a.text, '[A-Z][a-z]{3,}|[0-9]{3,}')), lambda c: NOT coalesce(contains(u.text, c), false))) AS n
  FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn AND u.role = 'user' WHERE a.role = 'assistant')""",
    ),
    "truncate_context": (
        lambda s, d: t(s, d, "documents").select("doc_id", A.truncate("text", 200).alias("text")),
        r"SELECT doc_id, CASE WHEN length(text) <= 800 THEN text WHEN regexp_extract(substr(text, 1, 800), '^([\s\S]*[.!?])', 1) <> '' THEN regexp_extract(substr(text, 1, 800), '^([\s\S]*[.!?])', 1) ELSE substr(text, 1, 800) END AS text FROM documents",
    ),
    "pack_sentences": (lambda s, d: A.pack_sentences(t(s, d, "documents")), None),
    "new_documents": (
        lambda s, d: O.new_documents(registry(s, d)[0], registry(s, d)[1]),
        "WITH d AS (SELECT sha256(coalesce(text, '')) AS document_id, doc_id FROM documents) SELECT document_id, min(doc_id) AS doc_id FROM d WHERE document_id NOT IN (SELECT document_id FROM d WHERE doc_id % 2 = 0) GROUP BY 1",
    ),
    "upsert_registry": (
        lambda s, d: O.upsert_registry(*registry(s, d)[1:]),
        "WITH d AS (SELECT sha256(coalesce(text, '')) AS document_id, doc_id, n_chars FROM documents), o AS (SELECT document_id, 1 AS version, min(doc_id) AS c FROM d WHERE doc_id % 2 = 0 GROUP BY 1 UNION ALL SELECT document_id, max(n_chars) % 7, min(doc_id) + 1000000 FROM d GROUP BY 1) SELECT document_id, max(version)::BIGINT AS version, min(c) AS created_at FROM o GROUP BY 1",
    ),
    "manifest": (
        manifest,
        f"WITH b AS ({BLOCKS}) SELECT doc_id, 'blocks' AS representation, count(*) AS version, sha256(string_agg(text, chr(10) ORDER BY pos)) AS content_hash FROM b GROUP BY 1 UNION ALL SELECT conv_id, 'turns', count(*), sha256(string_agg(text, chr(10) ORDER BY turn)) FROM conversations GROUP BY 1",
    ),
    "page_of_events": (
        lambda s, d: O.page(t(s, d, "events").select("event_id", "event_type"), "event_id", 3, 50),
        "SELECT event_id, event_type, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events) > 150 AS has_next, true AS has_prev FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 100",
    ),
    "admit_files": (
        lambda s, d: O.admit(files(s, d)),
        f"""SELECT name, CASE WHEN bytes > 16777216 THEN 'too_large' WHEN mime NOT IN ({MIME}) THEN 'mime_type' WHEN lower(regexp_extract(name, '\\.([^.]*)$', 1)) NOT IN ({EXT}) THEN 'extension' END AS reason
FROM (SELECT 'page' || page_id || ['.pdf', '.TXT', '.exe', ''][page_id % 4 + 1] AS name, ['application/pdf', 'text/plain', 'video/mp4'][page_id % 3 + 1] AS mime, length(html) * 4000 AS bytes FROM pages)""",
    ),
    "split_tables": (
        brands,
        "WITH x AS (SELECT p_brand, concat_ws(' | ', p_partkey, p_name, p_type) AS line, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand AS \"table\", i // 50 + 1 AS part, ceil(any_value(n)::DOUBLE / 50)::BIGINT AS parts, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY i) AS text FROM x GROUP BY 1, 2",
    ),
    "global_search": (
        global_search,
        " UNION ALL ".join(f"(SELECT '{n}' AS source, {k}::BIGINT AS id, {c} AS name FROM {n} WHERE contains({c}, '9') ORDER BY {k} LIMIT 10)" for n, (k, c) in {"supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name"), "nation": ("n_nationkey", "n_name")}.items()),
    ),
}
