"""Retrieval experts over headings, entities, tables and layout, evidence to candidates, fused contexts, two-pass retrieval, chunk indexes.

Keywords meet texts as whole tokens, in equi-joins; nothing compares all queries with all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators import search as S

#: The category of each raw type; any other is a paragraph.
CATEGORIES = {
    "heading": "heading", "heading_level_1": "heading", "heading_level_2": "heading", "heading_level_3": "heading", "heading_level_4": "heading",
    "title": "heading", "subtitle": "heading", "paragraph": "paragraph", "text": "paragraph", "body_text": "paragraph", "table": "table",
    "figure": "figure", "image": "figure", "list": "list", "list_item": "list", "bullet": "list", "caption": "caption", "footer": "footer",
    "header": "header", "equation": "equation", "formula": "equation",
}
NEAR_ZERO = 1e-12


def semantic_category(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in CATEGORIES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(kind)), F.lit("paragraph"))


def bbox(raw: Column) -> Column:
    """A box (x1, y1, x2, y2) from JSON text: an object with these keys, or a list of four; what is missing is 0 or 1. Null and anything else: the whole page."""
    as_list = F.from_json(raw, "array<double>")
    as_map = F.from_json(raw, "x1 double, y1 double, x2 double, y2 double")
    whole = {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}
    listed = F.ltrim(raw).startswith("[") & (F.size(as_list) >= 4)
    return F.struct(*[F.coalesce(F.when(listed, F.get(as_list, F.lit(i))).otherwise(as_map[k]), F.lit(v)).alias(k) for i, (k, v) in enumerate(whole.items())])


def keywords(queries: DataFrame, least: int = 4) -> DataFrame:
    """query_id, n, term: the different words of `least` letters or more of each query, and how many there are."""
    words = F.filter(F.array_distinct(T.tokens("text")), lambda w: F.length(w) >= least)
    return queries.select("query_id", words.alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("term"))


def heading_seeds(headings: DataFrame, terms: DataFrame, least: float = 0.1, top: int = 5) -> DataFrame:
    """query_id, doc_id, node_id, score: the share of a query's keywords in a heading, above `least`, the `top` best of each query. terms: as from keywords."""
    each = headings.select("doc_id", "node_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    scores = each.join(terms, "term").groupBy("query_id", "doc_id", "node_id", "n").agg(F.count("*").alias("c"))
    scores = scores.withColumn("score", F.round(F.col("c") / F.col("n"), 6)).filter(F.col("score") > least)
    return S.top(scores, "query_id", top, F.desc("score"), F.col("doc_id"), F.col("node_id")).select("query_id", "doc_id", "node_id", "score")


def expert_graph(headings: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, node_id, distance, score: seeds at distance 0, what one edge links to them at 1 with 0.5."""
    seeds = heading_seeds(headings, terms)
    both = edges.select("doc_id", F.col("source").alias("node_id"), F.col("target").alias("to")).union(edges.select("doc_id", "target", "source"))
    near = seeds.join(both, ["doc_id", "node_id"]).select("query_id", "doc_id", F.col("to").alias("node_id"), F.lit(1).alias("distance"), F.lit(0.5).alias("score"))
    found = seeds.select("query_id", "doc_id", "node_id", F.lit(0).alias("distance"), "score").union(near)
    best = F.min(F.struct("distance", -F.col("score")))
    return found.groupBy("query_id", "doc_id", "node_id").agg(best.alias("b")).select("query_id", "doc_id", "node_id", "b.distance", (-F.col("b")["col2"]).alias("score"))


def expert_entity(mentions: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, name, n_docs, n_with: entities named by a keyword, in how many documents, and how many others those mention. mentions: doc_id, name, distinct."""
    named = terms.select("query_id", "term").join(mentions.select("name").distinct().withColumn("term", F.lower("name")), "term").select("query_id", "name")
    wanted = named.select("name").distinct()
    where = mentions.join(wanted, "name").select("name", "doc_id")
    together = where.join(mentions.select("doc_id", F.col("name").alias("other")), "doc_id").filter("other <> name")
    stats = where.groupBy("name").agg(F.count("*").alias("n_docs")).join(together.groupBy("name").agg(F.countDistinct("other").alias("n_with")), "name", "left")
    return named.join(stats, "name").select("query_id", "name", "n_docs", F.coalesce("n_with", F.lit(0)).alias("n_with"))


def expert_table(tables: DataFrame, terms: DataFrame, wants_table: bool = False) -> DataFrame:
    """query_id, table_id, score: 0.8 times the share of keywords in the caption, 0.5 times the share of headers with one, 0.2 for a question after tables; above 0.2, 1 at most.

    tables: table_id, caption, headers (array).
    """
    caption = tables.select("table_id", F.explode(F.array_distinct(T.tokens("caption"))).alias("term")).join(terms, "term").groupBy("query_id", "table_id").agg((F.count("*") / F.first("n") * 0.8).alias("c"))
    heads = tables.select("table_id", F.size("headers").alias("k"), F.posexplode("headers").alias("pos", "h")).select("table_id", "k", "pos", F.explode(F.array_distinct(T.tokens("h"))).alias("term"))
    header = heads.join(terms, "term").groupBy("query_id", "table_id").agg((F.countDistinct("pos") / F.first("k") * 0.5).alias("h"))
    both = caption.join(header, ["query_id", "table_id"], "full_outer")
    score = F.coalesce("c", F.lit(0.0)) + F.coalesce("h", F.lit(0.0)) + (0.2 if wants_table else 0.0)
    return both.select("query_id", "table_id", F.round(F.least(score, F.lit(1.0)), 6).alias("score")).filter("score > 0.2")


def expert_layout(boxes: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, side, node_id, place: of each side of the page, the first `most` blocks that stand in its outer quarter. boxes: doc_id, node_id, pos, box."""
    b = F.col("box")
    sides = F.array(F.when(b["y1"] < 0.25, "top"), F.when(b["y2"] > 0.75, "bottom"), F.when(b["x1"] < 0.25, "left"), F.when(b["x2"] > 0.75, "right"))
    each = boxes.select("doc_id", "node_id", "pos", F.explode(F.array_compact(sides)).alias("side"))
    return each.select("doc_id", "side", "node_id", F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("pos")).alias("place")).filter(F.col("place") <= most)


def second_hop(headings: DataFrame, edges: DataFrame, queries: DataFrame, more: int = 5) -> DataFrame:
    """As expert_graph, with the keywords of each query and `more` of the first pass: the first in order that its seeds' texts have."""
    terms = keywords(queries)
    seeds = heading_seeds(headings, terms).select("query_id", "doc_id", "node_id").join(headings.select("doc_id", "node_id", "text"), ["doc_id", "node_id"])
    fresh = seeds.select("query_id", F.explode(F.filter(F.array_distinct(T.tokens("text")), lambda w: F.length(w) >= 4)).alias("term")).distinct().join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti")
    added = S.top(fresh, "query_id", more, F.col("term")).select("query_id", "term")
    both = terms.select("query_id", "term").union(added)
    return expert_graph(headings, edges, both.join(both.groupBy("query_id").agg(F.count("*").cast("int").alias("n")), "query_id").select("query_id", "n", "term"))


def candidates(evidence: DataFrame, chunk_nodes: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_id, score: the chunks that hold nodes of the evidence, with the best score. chunk_nodes: doc_id, node_id, chunk_id."""
    return evidence.join(chunk_nodes, ["doc_id", "node_id"]).groupBy("query_id", "doc_id", "chunk_id").agg(F.max("score").alias("score"))


def fuse_context(ranked: DataFrame, graph: DataFrame, budget: int = 4000) -> DataFrame:
    """query_id, n_chunks, n_nodes, truncated, context: sections, tables, then the rest by rank, and graph nodes that no chunk covers; `budget` words.

    ranked: query_id, rank, chunk_id, type, text, nodes (array of node ids); graph: query_id, node_id, text. Both hold what one
    query found, k entries at most.
    """
    kind = F.when(F.col("type").contains("heading"), 0).when(F.col("type").contains("table"), 1).otherwise(3)
    title = F.element_at(F.array(*[F.lit(x) for x in ("SECTIONS", "TABLES", "GRAPH EVIDENCE", "SUPPORTING EVIDENCE")]), F.col("kind") + 1)
    chunks = ranked.dropDuplicates(["query_id", "chunk_id"]).select("query_id", kind.alias("kind"), F.col("rank").cast("long").alias("o"), F.col("chunk_id").alias("id"), "text")
    covered = ranked.select("query_id", F.explode("nodes").alias("node_id")).distinct()
    bare = graph.dropDuplicates(["query_id", "node_id"]).join(covered, ["query_id", "node_id"], "left_anti")
    nodes = bare.select("query_id", F.lit(2).alias("kind"), F.row_number().over(Window.partitionBy("query_id").orderBy("node_id")).cast("long").alias("o"), F.col("node_id").alias("id"), "text")
    rows = chunks.unionByName(nodes).select("query_id", "kind", "o", "id", F.concat(F.lit("- "), "id", F.lit(": "), "text").alias("line"))
    parts = rows.groupBy("query_id", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "id", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n"))
    parts = parts.select("query_id", "kind", "n", F.concat(F.lit("=== "), title, F.lit(" ===\n"), "lines").alias("part"))
    whole = parts.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("kind") != 2, F.col("n"))), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).alias("n_nodes"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    words = F.filter(F.split("context", r"\s+"), lambda w: w != "")
    long = F.size(words) > budget
    return whole.select("query_id", "n_chunks", "n_nodes", long.alias("truncated"), F.when(long, F.concat(F.array_join(F.slice(words, 1, budget), " "), F.lit("\n... [TRUNCATED]"))).otherwise(F.col("context")).alias("context"))


def retrieve(lists: DataFrame, groups: DataFrame, weights: dict[str, float], k: int = 5) -> DataFrame:
    """query_id, place, doc_id, score, n_pool, n_added: two passes: fused lists, then those and what shares a group with the three best, k in the end.

    lists: query_id, source, rank, doc_id; groups: doc_id, group. What the second pass adds scores 0.7 of the least fused score.
    """
    fused = S.rrf(lists, weights)
    pool = fused.join(groups, "doc_id")
    first = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    head = first.filter(F.col("rank") <= k)
    best = first.filter((F.col("rank") <= 3) & F.col("group").isNotNull()).select("query_id", "group").distinct()
    least = head.groupBy("query_id").agg(F.min("score").alias("least"))
    more = first.filter(F.col("rank") > k).join(best, ["query_id", "group"], "left_semi").join(least, "query_id").select("query_id", "doc_id", F.round(F.least("score", F.col("least") * 0.7), 8).alias("score"), F.lit(1).alias("added"))
    both = head.select("query_id", "doc_id", "score", F.lit(0).alias("added")).unionByName(more)
    counts = both.groupBy("query_id").agg(F.count("*").alias("n_pool"), F.sum("added").alias("n_added"))
    return S.top(both, "query_id", k, F.desc("score"), F.col("doc_id")).select("query_id", F.col("rank").alias("place"), "doc_id", "score").join(counts, "query_id")


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """point_id, chunk_id, version, vector: the newest row of each chunk, without vectors that are (nearly) zero or null. Both tables: chunk_id, version, vector."""
    some = F.exists("vector", lambda x: F.abs(x) >= NEAR_ZERO)
    both = old.unionByName(new).filter(F.coalesce(some, F.lit(False)))
    newest = both.groupBy("chunk_id").agg(F.max_by(F.struct("version", "vector"), "version").alias("m"))
    return newest.select(F.substring(F.sha2(F.col("chunk_id").cast("string"), 256), 1, 32).alias("point_id"), "chunk_id", "m.version", "m.vector")


def collection_stats(points: DataFrame, by: str) -> DataFrame:
    """<by>, n, dimensions: points and the length of the longest vector of each collection."""
    return points.groupBy(by).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dimensions"))
