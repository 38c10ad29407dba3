"""Layout graphs of blocks: building, repairing, checking, walking, comparing. Nodes and edges of all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T
from docweft.shared import cut, none_in


def nodes(blocks: DataFrame) -> DataFrame:
    """doc_id, node_id, page, pos, type, text of each block."""
    kind = F.when(F.col("is_heading"), "heading").when(F.col("text").contains("|"), "table").otherwise("paragraph")
    return blocks.select("doc_id", F.format_string("p%d_n_block_%d", "page", "pos").alias("node_id"), "page", "pos", kind.alias("type"), "text")


def edges(nodes: DataFrame) -> DataFrame:
    """doc_id, source, target, type: next on a page, page_next from a page's last node to the next page's first, contains from the document."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    ahead = nodes.select("doc_id", F.col("node_id").alias("source"), "page", F.lead("node_id").over(own).alias("target"), F.lead("page").over(own).alias("next_page")).filter("target is not null")
    step = ahead.select("doc_id", "source", "target", F.when(F.col("page") == F.col("next_page"), "next").otherwise("page_next").alias("type"))
    root = nodes.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("type"))
    return step.unionByName(root)


def repair(nodes: DataFrame) -> DataFrame:
    """Node ids made unique (a repeated or missing id gets its place appended) and pages renumbered from 1 without gaps."""
    own = Window.partitionBy("doc_id", "node_id").orderBy("pos")
    again = F.col("node_id").isNull() | (F.row_number().over(own) > 1)
    page = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))
    name = F.when(again, F.concat_ws("_", F.coalesce("node_id", F.lit("node")), F.col("pos").cast("string"))).otherwise(F.col("node_id"))
    return nodes.select("doc_id", name.alias("node_id"), page.alias("page"), "pos")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, issue, n: repeated ids, pages out of order, edges to unknown nodes, nodes without an edge to another block."""
    twice = nodes.groupBy("doc_id", "node_id").agg(F.count("*").alias("c")).filter("c > 1").groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("issue", F.lit("duplicate_id"))
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("pos"))
    disorder = nodes.withColumn("b", before).filter("page < b").groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("issue", F.lit("page_order"))
    known = nodes.select("doc_id", F.col("node_id").alias("target"))
    dangling = edges.join(known, ["doc_id", "target"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("issue", F.lit("unknown_target"))
    walk = edges.filter("type <> 'contains'")
    met = walk.select("doc_id", F.col("source").alias("node_id")).union(walk.select("doc_id", "target"))
    orphans = nodes.join(met, ["doc_id", "node_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("issue", F.lit("orphan"))
    return twice.unionByName(disorder).unionByName(dangling).unionByName(orphans).select("doc_id", "issue", "n")


def profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, node counts by type and edge counts by type."""
    a = nodes.groupBy("doc_id").agg(*[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("heading", "table", "paragraph")])
    b = edges.groupBy("doc_id").agg(*[F.count_if(F.col("type") == k).alias(f"e_{k}") for k in ("next", "page_next", "contains")])
    return a.join(b, "doc_id", "left").fillna(0)


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select("doc_id", "node_id")
    return edges.join(ids.withColumnRenamed("node_id", "source"), ["doc_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["doc_id", "target"], "left_semi").select("doc_id", "source", "target", "type")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """doc_id, node_id, depth: what edges reach from seeds (doc_id, node_id), either way, in so many steps; least depth. A step joins only what the one before has found, and ends the walk if it finds nothing."""
    both = edges.select("doc_id", F.col("source").alias("a"), F.col("target").alias("b"))
    both = cut(both.union(both.select("doc_id", "b", "a")).distinct())
    front = seen = cut(seeds.select("doc_id", "node_id", F.lit(0).alias("depth")).distinct())
    for k in range(1, depth + 1):
        step = front.select("doc_id", F.col("node_id").alias("a")).join(both, ["doc_id", "a"]).select("doc_id", F.col("b").alias("node_id")).distinct()
        front = cut(step.join(seen, ["doc_id", "node_id"], "left_anti").withColumn("depth", F.lit(k)))
        if none_in(front):
            break
        seen = seen.unionByName(front)
    return seen


def expand(hits: DataFrame, nodes: DataFrame, factor: float = 0.7) -> DataFrame:
    """Each hit (query_id, doc_id, pos, score) and its neighbours one and two places away, at 0.8 and 0.8 * factor of its score; the best counts."""
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in ((0, 1.0), (-1, 0.8), (1, 0.8), (-2, 0.8 * factor), (2, 0.8 * factor))]))
    near = hits.withColumn("s", steps).select("query_id", "doc_id", (F.col("pos") + F.col("s.o")).alias("pos"), (F.col("score") * F.col("s.w")).alias("score"))
    return near.join(nodes.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi").groupBy("query_id", "doc_id", "pos").agg(F.round(F.max("score"), 5).alias("score"))


def parity(nodes: DataFrame) -> DataFrame:
    """Pairs of documents 2k and 2k + 1: similarity of node counts and of their sets of texts, nodes added and removed."""
    one = nodes.select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), "text").distinct()
    each = one.groupBy("pair", "text").agg(F.max((F.col("side") == 0).cast("int")).alias("a"), F.max((F.col("side") == 1).cast("int")).alias("b"))
    s = each.groupBy("pair").agg(F.sum("a").alias("left"), F.sum("b").alias("right"), F.sum(F.col("a") * F.col("b")).alias("common"))
    return s.select("pair", (F.col("right") - F.col("common")).alias("added"), (F.col("left") - F.col("common")).alias("removed"), F.round(F.least("left", "right") / F.greatest("left", "right"), 4).alias("structural"), F.round(F.col("common") / (F.col("left") + F.col("right") - F.col("common")), 4).alias("textual"))


def compare(left: DataFrame, left_edges: DataFrame, right: DataFrame, right_edges: DataFrame) -> DataFrame:
    """doc_id, structural, textual (percent, 2 dp), nodes_added, nodes_removed, edges_added, edges_removed, orphans of two graphs of each document (right against left).

    structural: 0.4 for how near the numbers of nodes are, 0.3 for the share of the left nodes that have the same parent on the right, 0.3 for the edges that both have out of the larger number of different
    ones. textual: the words that both have out of all their different ones. Orphans are right nodes without a parent and without an edge. Nodes: doc_id, node_id, parent, text; edges: doc_id, source,
    target, type. A side that lacks a document counts as empty.
    """
    # What each side says (k: 0 a node, 1 a node's parent, 2 a word, 3 an edge; a node also has the ends of edges) meets in groups of one document's rows, each table being read
    # once: nothing is shuffled for it where they are dealt by doc_id.
    none = F.lit(None).cast("string")

    def fact(side: str, k: int, a: Column, b: Column = none, c: Column = none, root: Column = F.lit(0), end: int = 0) -> Column:
        flags = [F.lit(int(side == x)).alias(x) for x in "lr"]
        return F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b"), c.alias("c"), *flags, root.alias("root"), F.lit(end).alias("end"))

    def of_nodes(d: DataFrame, side: str) -> DataFrame:
        node, parent = F.col("node_id"), F.col("parent")
        root = F.when(parent.isNull(), 1).otherwise(0) if side == "r" else F.lit(0)
        words = F.transform(F.array_distinct(T.tokens("text")), lambda w: fact(side, 2, w))
        return d.select("doc_id", F.explode(F.concat(F.array(fact(side, 0, node, root=root), fact(side, 1, node, parent)), F.coalesce(words, F.array()))).alias("f"))

    def of_edges(e: DataFrame, side: str) -> DataFrame:
        source, target = F.col("source"), F.col("target")
        ends = [fact("", 0, source, end=1), fact("", 0, target, end=1)] if side == "r" else []
        return e.select("doc_id", F.explode(F.array(fact(side, 3, source, target, F.col("type")), *ends)).alias("f"))

    facts = of_nodes(left, "l").unionByName(of_nodes(right, "r")).unionByName(of_edges(left_edges, "l")).unionByName(of_edges(right_edges, "r")).select("doc_id", "f.*")
    each = facts.groupBy("doc_id", "k", "a", "b", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.sum("root").alias("roots"), F.max("end").alias("end"))
    n = lambda k, c, when=F.lit(True): F.coalesce(F.sum(F.when((F.col("k") == k) & when, c)), F.lit(0))
    l, r, both, named = F.col("l"), F.col("r"), F.col("l") * F.col("r"), F.col("a").isNotNull()
    all_ = each.groupBy("doc_id").agg(
        n(0, l).alias("nl"), n(0, r).alias("nr"), n(0, both, named).alias("nb"), n(1, both, named).alias("same"), n(3, l).alias("el"), n(3, r).alias("er"), n(3, both).alias("eb"),
        n(2, F.lit(1)).alias("words"), n(2, both).alias("common"), n(0, F.col("roots"), ~named | (F.col("end") == 0)).alias("orphans"),
    ).filter("nl + nr > 0")
    count = 1.0 - F.abs(F.col("nl") - F.col("nr")) / F.greatest("nl", "nr", F.lit(1))
    hierarchy = F.when(F.col("nl") > 0, F.col("same") / F.col("nl")).otherwise(1.0)
    structural = (0.4 * count + 0.3 * hierarchy + 0.3 * (F.col("eb") / F.greatest("el", "er", F.lit(1)))) * 100.0
    textual = F.when(F.col("words") > 0, F.col("common") / F.col("words") * 100.0).otherwise(100.0)
    gap = lambda a, b, name: (F.col(a) - F.col(b)).alias(name)
    return all_.select("doc_id", F.round(structural, 2).alias("structural"), F.round(textual, 2).alias("textual"), gap("nr", "nb", "nodes_added"), gap("nl", "nb", "nodes_removed"), gap("er", "eb", "edges_added"), gap("el", "eb", "edges_removed"), "orphans")
