"""Expansion of found chunks over the relations of a chunk graph, hop by hop, for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.shared import cut, none_in

#: What a chunk keeps of its seed's score by the relation that leads to it, and what each further hop leaves of that; how many chunks a relation of a chunk leads to, and a query gets.
WEIGHTS = {"neighbor": 0.80, "parent": 0.90, "child": 0.75, "cross_ref": 0.60}
DECAY, A_RELATION, A_QUERY = 0.7, 10, 50
#: So many chunks that a hop starts from are sent to all tasks; more are joined by a shuffle.
FEW = 1_000_000


def block_relations(blocks: DataFrame, most: int = A_RELATION) -> DataFrame:
    """doc_id, pos, relation, to_doc, to_pos of blocks (doc_id, page, pos, text): the blocks before and after (neighbor), the first block of the page (parent) and from there the others (child), and blocks with
    the same text elsewhere (cross_ref). Of a text's blocks only the first most + 1 are led to, so a frequent text makes no pairs of all its blocks."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    page = F.min("pos").over(Window.partitionBy("doc_id", "page"))
    each = blocks.select("doc_id", "pos", F.lag("pos").over(own).alias("before"), F.lead("pos").over(own).alias("after"), page.alias("head"))
    to = lambda relation, pos: F.struct(F.lit(relation).alias("relation"), F.col("doc_id").alias("to_doc"), F.col(pos).alias("to_pos"))
    near = each.select("doc_id", "pos", F.inline(F.array(to("neighbor", "before"), to("neighbor", "after"), to("parent", "head")))).filter("to_pos is not null and to_pos <> pos")
    below = each.filter("head <> pos").select("doc_id", F.col("head").alias("pos"), F.lit("child").alias("relation"), F.col("doc_id").alias("to_doc"), F.col("pos").alias("to_pos"))
    key = blocks.select("doc_id", "pos", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"))
    first = key.withColumn("_r", F.row_number().over(Window.partitionBy("h", "h2").orderBy("doc_id", "pos"))).filter(F.col("_r") <= most + 1)  # ranks are cut in each task before the shuffle
    heads = first.select("h", "h2", F.col("doc_id").alias("to_doc"), F.col("pos").alias("to_pos"))
    same = key.join(heads, ["h", "h2"]).filter("doc_id <> to_doc or pos <> to_pos").select("doc_id", "pos", F.lit("cross_ref").alias("relation"), "to_doc", "to_pos")
    return near.unionByName(below).unionByName(same)


def expand_chunks(seeds: DataFrame, relations: DataFrame, depth: int = 1, limit: int = A_QUERY, most: int = A_RELATION) -> DataFrame:
    """query_id, place, doc_id, pos, score (5 dp), hop, relations (in order of names, by commas) of the seeds (query_id, doc_id, pos, score) and what up to `depth` hops reach, the `limit` best of each query.

    Of a chunk's relation the first `most` targets count; a hop ranks those of the chunks it starts from only, so that the blocks of a frequent text don't meet in one task. A chunk belongs to the hop that reaches it first; there its best score counts, and all relations that lead to it are merged. A score is that of the seed
    from which the best way comes, times the weight of the last relation, times DECAY for each hop after the first. Ties go to the smaller doc_id and pos.
    """
    first = Window.partitionBy("doc_id", "pos", "relation").orderBy("to_doc", "to_pos")
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    columns = ["query_id", "doc_id", "pos", "score", "origin", "hop", "relations"]
    front = cut(seeds.groupBy("query_id", "doc_id", "pos").agg(F.max("score").alias("score")).select("query_id", "doc_id", "pos", "score", F.col("score").alias("origin"), F.lit(0).alias("hop"), F.lit("original").alias("relations")))
    parts = [front]
    for hop in range(1, depth + 1):
        starts = front.select("doc_id", "pos").distinct()
        near = relations.join(F.broadcast(starts) if starts.limit(FEW + 1).count() <= FEW else starts, ["doc_id", "pos"], "left_semi")
        cut_off = near.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most).select("doc_id", "pos", "relation", "to_doc", "to_pos")
        step = front.join(cut_off, ["doc_id", "pos"]).select("query_id", F.col("to_doc").alias("doc_id"), F.col("to_pos").alias("pos"), "origin", "relation", (F.col("origin") * weight[F.col("relation")] * DECAY ** (hop - 1)).alias("score"))
        reached = step.groupBy("query_id", "doc_id", "pos").agg(F.max(F.struct("score", "origin")).alias("b"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))
        for known in parts:
            reached = reached.join(known.select("query_id", "doc_id", "pos"), ["query_id", "doc_id", "pos"], "left_anti")
        front = cut(reached.select("query_id", "doc_id", "pos", "b.score", "b.origin", F.lit(hop).alias("hop"), "relations"))
        if none_in(front):
            break
        parts.append(front)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    out = out.withColumn("score", F.round("score", 5))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "pos"))
    return out.withColumn("place", place).filter(F.col("place") <= limit).select("query_id", "place", "doc_id", "pos", "score", "hop", "relations")
