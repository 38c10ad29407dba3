"""Queries over outlines: heading levels and paths, sections, graph chunks and their degradation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.operators import dag as D
from docweft.operators import graph as G
from docweft.operators import outline as O
from docweft.plans.text import t

#: Statement nodes: one document a customer (operators.outline.statements).
NODES = """o AS (SELECT o_orderkey, o_custkey AS doc_id, year(o_orderdate) AS y, epoch(o_orderdate) AS secs FROM orders),
ln AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n, l_returnflag, l_partkey, l_quantity FROM lineitem),
raw AS (SELECT DISTINCT doc_id, 'c-' || doc_id AS node_id, NULL::VARCHAR AS parent, 'heading' AS type, c_name AS text, (-1, -1, -1, -1)::STRUCT(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) AS sort FROM o JOIN customer ON c_custkey = doc_id
  UNION ALL SELECT DISTINCT doc_id, 'y-' || doc_id || '-' || y, 'c-' || doc_id, 'heading', 'Year ' || y, {'a': y, 'b': -1, 'c': -1, 'd': -1} FROM o
  UNION ALL SELECT doc_id, 'o-' || o_orderkey, 'y-' || doc_id || '-' || y, 'heading', 'Order ' || o_orderkey, {'a': y, 'b': secs, 'c': o_orderkey, 'd': -1} FROM o
  UNION ALL SELECT doc_id, 'l-' || l_orderkey || '-' || n, 'o-' || l_orderkey, CASE l_returnflag WHEN 'N' THEN 'list' WHEN 'R' THEN 'figure' ELSE 'paragraph' END, 'Part ' || l_partkey || ' quantity ' || l_quantity::INTEGER, {'a': y, 'b': secs, 'c': l_orderkey, 'd': n} FROM ln JOIN o ON o_orderkey = l_orderkey),
placed AS (SELECT doc_id, node_id, parent, type, text, row_number() OVER (PARTITION BY doc_id ORDER BY sort) AS pos FROM raw),
nodes AS (SELECT *, ((pos - 1) // 12)::INTEGER + 1 AS page FROM placed)"""
LEVELS = """lev AS (SELECT doc_id, node_id, (type = 'heading')::INTEGER AS level, type = 'heading' AS h, CASE WHEN type = 'heading' AND trim(text) <> '' THEN [trim(text)] ELSE [] END AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.doc_id, n.node_id, CASE WHEN lev.h THEN lev.level + 1 ELSE (n.type = 'heading')::INTEGER END, n.type = 'heading', CASE WHEN n.type = 'heading' AND trim(n.text) <> '' THEN list_append(lev.path, trim(n.text)) ELSE lev.path END
  FROM nodes n JOIN lev ON lev.doc_id = n.doc_id AND lev.node_id = n.parent)"""


def whole_sections_sql(table: str) -> str:
    """sections_sql as section_groups documents it: identical neighbouring headings are one, and a document of headings only is one section 0 with all of them as its content."""
    one = f"cp AS (SELECT * FROM {table} WINDOW w AS (PARTITION BY doc_id ORDER BY pos) QUALIFY NOT coalesce(type = 'heading' AND lag(type) OVER w = 'heading' AND trim(text) = trim(lag(text) OVER w), false)), "
    return one + sections_sql("cp").replace("sec AS (", "sec AS (SELECT doc_id, 0::BIGINT AS section, []::VARCHAR[] AS path, []::VARCHAR[] AS headings, list(node_id ORDER BY pos) AS contents FROM cp GROUP BY doc_id HAVING bool_and(type = 'heading')\n  UNION ALL ")


def sections_sql(table: str) -> str:
    """The heading stack as a recursion from heading to heading."""
    return f"""hd AS (SELECT n.doc_id, n.node_id, trim(n.text) AS t, n.pos, lev.level, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.pos) AS k FROM {table} n JOIN lev ON lev.doc_id = n.doc_id AND lev.node_id = n.node_id WHERE n.type = 'heading'),
st AS (SELECT doc_id, k, [node_id] AS ids, [t] AS ts FROM hd WHERE k = 1
  UNION ALL SELECT hd.doc_id, hd.k, list_append(list_slice(st.ids, 1, hd.level - 1), hd.node_id), list_append(list_slice(st.ts, 1, hd.level - 1), hd.t) FROM st JOIN hd ON hd.doc_id = st.doc_id AND hd.k = st.k + 1),
ct AS (SELECT * FROM (SELECT *, sum((type = 'heading')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM {table}) WHERE type <> 'heading'),
sec AS (SELECT c.doc_id, c.section::BIGINT AS section, coalesce(any_value(st.ts), []) AS path, coalesce(any_value(st.ids), []) AS headings, list(c.node_id ORDER BY c.pos) AS contents FROM ct c LEFT JOIN st ON st.doc_id = c.doc_id AND st.k = c.section GROUP BY c.doc_id, c.section)"""


MERGED = """jn AS (SELECT *, coalesce(type IN ('list', 'paragraph') AND type = lag(type) OVER w AND parent = lag(parent) OVER w, false) AS joined FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
rn AS (SELECT *, sum((NOT joined)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM jn),
mg AS (SELECT doc_id, arg_min(node_id, pos) AS node_id, min(pos) AS pos, min(page) AS page, max(page) AS page_end, arg_min(type, pos) AS type, string_agg(text, ' ' ORDER BY pos) AS text FROM rn GROUP BY doc_id, run)"""
HASH = "substr(sha256(doc_id || '|' || array_to_string(list_sort({ids}), '|')), 1, 16)"


def records_sql(sections=sections_sql) -> str:
    return f"""WITH RECURSIVE {NODES}, {LEVELS}, {MERGED}, {sections("mg")},
pr AS (SELECT *, {HASH.format(ids="list_concat(headings, contents)")} AS parent_chunk_id FROM sec),
ch AS (SELECT pr.doc_id, pr.section, pr.parent_chunk_id, pr.path, m.node_id, m.type, m.page, m.page_end, m.pos, trim(m.text) AS text, substr(sha256(pr.doc_id || '|' || m.node_id), 1, 16) AS chunk_id
  FROM (SELECT *, unnest(contents) AS c FROM pr) pr JOIN mg m ON m.doc_id = pr.doc_id AND m.node_id = pr.c WHERE trim(m.text) <> ''),
rec AS (SELECT pr.doc_id, pr.section, pr.parent_chunk_id AS chunk_id, list_concat(headings, contents) AS node_ids, path, (SELECT list(ch.chunk_id ORDER BY ch.pos) FROM ch WHERE ch.doc_id = pr.doc_id AND ch.section = pr.section) AS children FROM pr)"""


def degrade_sql(most: int) -> str:
    return records_sql() + f""", c AS (SELECT doc_id, count(*) AS n, count(DISTINCT (parent_chunk_id, type)) FILTER (type IN ('paragraph', 'list')) AS groups, count(*) FILTER (type = 'figure') AS figures, count(DISTINCT section) AS records FROM ch GROUP BY doc_id),
sg AS (SELECT doc_id, CASE WHEN n + records <= {most} THEN 0 WHEN groups + figures + records <= {most} THEN 1 WHEN groups + records <= {most} THEN 2 ELSE 3 END AS stage FROM c),
x AS (SELECT doc_id, stage, chunk_id, parent_chunk_id, node_id AS node_ids, path, type, page AS page_start, page_end, text FROM ch JOIN sg USING (doc_id) WHERE stage = 0 OR (stage = 1 AND type = 'figure')
  UNION ALL SELECT doc_id, stage, {HASH.format(ids="list(node_id)")}, parent_chunk_id, array_to_string(list_sort(list(node_id)), ','), any_value(path), type, min(page), max(page_end), string_agg(text, ' ' ORDER BY pos) FROM ch JOIN sg USING (doc_id) WHERE stage IN (1, 2) AND type <> 'figure' GROUP BY doc_id, stage, parent_chunk_id, type
  UNION ALL SELECT n.doc_id, stage, substr(sha256(n.doc_id || '|' || n.node_id), 1, 16), NULL, n.node_id, [], type, page, page, trim(text) FROM nodes n JOIN sg USING (doc_id) WHERE stage = 3)
SELECT doc_id, stage, chunk_id, parent_chunk_id, node_ids, array_to_string(path, ' > ') AS path, type, page_start, page_end, text, len(regexp_extract_all(text, '\\S+'))::INTEGER AS n_words FROM x"""


def nodes(s, d):
    return O.statements(t(s, d, "customer"), t(s, d, "orders"), t(s, d, "lineitem"))


def longest(s, d):
    return O.longest_statement(t(s, d, "orders"), t(s, d, "lineitem"))


def heading_paths(s, d):
    return O.heading_paths(nodes(s, d), longest(s, d)).select("doc_id", "node_id", "level", F.array_join("path", " > ").alias("path"), "error")


def section_groups(s, d):
    return O.section_groups(nodes(s, d), longest(s, d)).select("doc_id", "section", F.array_join("path", " > ").alias("path"), F.array_join("headings", ",").alias("headings"), F.array_join("contents", ",").alias("contents"))


def section_records(s, d):
    found = O.section_records(O.merge_pages(nodes(s, d)), longest(s, d)).filter("not embed")
    return found.select("doc_id", "chunk_id", F.array_join("node_ids", ",").alias("node_ids"), F.array_join("path", " > ").alias("path"), F.array_join("children", ",").alias("children"))


def chunk_graph(most):
    def run(s, d):
        found = O.chunk_graph(nodes(s, d), most, longest(s, d))
        return found.select("doc_id", "stage", "chunk_id", "parent_chunk_id", F.array_join("node_ids", ",").alias("node_ids"), F.array_join("path", " > ").alias("path"), "type", "page_start", "page_end", "text", "n_words")

    return run


def graph_edges(nodes):
    """Edges of outline nodes: contains from the parent, next to the node read after."""
    ahead = nodes.select("doc_id", "node_id", "parent", F.lead("node_id").over(Window.partitionBy("doc_id").orderBy("pos")).alias("ahead"))
    edge = lambda source, target, kind: F.when(F.col(source).isNotNull() & F.col(target).isNotNull(), F.struct(F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("type")))
    return ahead.select("doc_id", F.explode(F.array_compact(F.array(edge("parent", "node_id", "contains"), edge("node_id", "ahead", "next")))).alias("e")).select("doc_id", "e.*")


def graph_compare(s, d):
    """Each statement's nodes against those with continued paragraphs merged."""
    left = nodes(s, d)
    right = O.merge_pages(left)
    return G.compare(left, graph_edges(left), right, graph_edges(right))


def layout_issues(s, d):
    """Statements whose figures have no box and refer back to the heading that contains them."""
    each = nodes(s, d).withColumns({"reading_order": F.col("pos"), "bbox": F.when(F.col("type") != "figure", F.concat_ws(",", "page", "pos"))})
    back = each.filter("type = 'figure'").select("doc_id", F.col("node_id").alias("source"), F.col("parent").alias("target"), F.lit("references").alias("type"))
    return D.layout_issues(each, graph_edges(each).unionByName(back))


WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
COMPARE = f"""WITH {NODES}, {MERGED.replace("string_agg(text", "arg_min(parent, pos) AS parent, string_agg(text")},
sides AS (SELECT 'l' AS side, doc_id, node_id, parent, pos, text FROM nodes UNION ALL SELECT 'r', doc_id, node_id, parent, pos, text FROM mg),
ed AS (SELECT side, doc_id, parent AS source, node_id AS target, 'contains' AS type FROM sides WHERE parent IS NOT NULL UNION ALL SELECT * FROM (SELECT side, doc_id, node_id, lead(node_id) OVER (PARTITION BY side, doc_id ORDER BY pos) AS target, 'next' FROM sides) WHERE target IS NOT NULL),
nc AS (SELECT doc_id, count(*) FILTER (side = 'l') AS nl, count(*) FILTER (side = 'r') AS nr FROM sides GROUP BY 1),
hb AS (SELECT l.doc_id, count(*) AS nb, count(*) FILTER (l.parent IS NOT DISTINCT FROM r.parent) AS same FROM nodes l JOIN mg r ON r.doc_id = l.doc_id AND r.node_id = l.node_id GROUP BY 1),
ec AS (SELECT doc_id, count(*) FILTER (l) AS el, count(*) FILTER (r) AS er, count(*) FILTER (l AND r) AS eb FROM (SELECT doc_id, source, target, type, bool_or(side = 'l') AS l, bool_or(side = 'r') AS r FROM ed GROUP BY ALL) GROUP BY 1),
wc AS (SELECT doc_id, count(*) AS words, count(*) FILTER (l AND r) AS common FROM (SELECT doc_id, word, bool_or(side = 'l') AS l, bool_or(side = 'r') AS r FROM (SELECT side, doc_id, unnest({WORDS}) AS word FROM sides) GROUP BY ALL) GROUP BY 1),
al AS (SELECT doc_id, count(*) AS n FROM mg WHERE parent IS NULL AND NOT EXISTS (SELECT 1 FROM ed WHERE side = 'r' AND ed.doc_id = mg.doc_id AND (source = mg.node_id OR target = mg.node_id)) GROUP BY 1)
SELECT doc_id, round((0.4::DOUBLE * (1.0::DOUBLE - abs(nl - nr)::DOUBLE / greatest(nl, nr, 1)) + 0.3::DOUBLE * (same::DOUBLE / nl) + 0.3::DOUBLE * (coalesce(eb, 0)::DOUBLE / greatest(coalesce(el, 0), coalesce(er, 0), 1))) * 100.0::DOUBLE, 2) AS structural, round(common::DOUBLE / words * 100.0::DOUBLE, 2) AS textual,
  nr - nb AS nodes_added, nl - nb AS nodes_removed, coalesce(er - eb, 0) AS edges_added, coalesce(el - eb, 0) AS edges_removed, coalesce(n, 0) AS orphans FROM nc JOIN hb USING (doc_id) LEFT JOIN ec USING (doc_id) LEFT JOIN wc USING (doc_id) LEFT JOIN al USING (doc_id)"""

QUERIES = {
    "graph_compare": (graph_compare, COMPARE),
    "layout_issues": (
        layout_issues,
        f"""WITH {NODES}, fg AS (SELECT doc_id, parent, count(*) AS n FROM nodes WHERE type = 'figure' GROUP BY ALL)
SELECT doc_id, 'missing_bbox' AS issue, sum(n)::BIGINT AS n FROM fg GROUP BY doc_id
UNION ALL SELECT fg.doc_id, 'cycle', (count(*) + count(DISTINCT fg.parent))::BIGINT FROM fg JOIN nodes ON nodes.doc_id = fg.doc_id AND nodes.parent = fg.parent GROUP BY fg.doc_id""",
    ),
    "heading_paths": (heading_paths, f"WITH RECURSIVE {NODES}, {LEVELS} SELECT doc_id, node_id, level, array_to_string(path, ' > ') AS path, NULL::VARCHAR AS error FROM lev"),
    "section_groups": (
        section_groups,
        f"WITH RECURSIVE {NODES}, {LEVELS}, {whole_sections_sql('nodes')} SELECT doc_id, section, array_to_string(path, ' > ') AS path, array_to_string(headings, ',') AS headings, array_to_string(contents, ',') AS contents FROM sec",
    ),
    "section_records": (section_records, records_sql(whole_sections_sql) + " SELECT doc_id, chunk_id, array_to_string(node_ids, ',') AS node_ids, array_to_string(path, ' > ') AS path, array_to_string(children, ',') AS children FROM rec"),
    "chunk_graph": (chunk_graph(O.CHUNKS), degrade_sql(O.CHUNKS)),
    # At these limits documents of every stage occur.
    "degrade_chunks": (chunk_graph(40), degrade_sql(40)),
    "degrade_chunks_hard": (chunk_graph(24), degrade_sql(24)),
}
