"""Connected components of links between documents, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import SMALL, cut, let_go, small


def _least(both: DataFrame, many: bool) -> DataFrame:
    """(u, m): the least of u and its neighbours. Partial minima come first, so a hub's links are not gathered for it. With many
    links it is a table of its own, which leaves a hub's rows in the join on u, which Spark can split."""
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return cut(least) if many else least


def large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.union(edges.select("v", "u"))
    return both.join(_least(both, many), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, many: bool = False) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = down.join(_least(down, many), "u")
    return found.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node either is a centre or has one link, to a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter("up > 1 or (up > 0 and down > 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every linked id and the least id that it can reach. edges: u, v (long).

    Null ends and loops are left out; repeated links count once; without links the result is empty. The steps end when all
    components are stars around their least id, after about the logarithm of the longest path.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    many = edges.count() > SMALL
    while not _all_stars(edges):
        larger = large_star(edges, many).distinct()
        edges = cut(small_star(cut(larger) if many else larger, many).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Of every band, so many further members are taken as pivots before all that is still apart is compared.
PIVOTS = 2


def none_in(df: DataFrame) -> bool:
    return not df.limit(1).count()


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after further links: only the graph of the components that they join goes through the steps. Without links nothing is done."""
    links = cut(links)
    if none_in(links):
        return found
    at = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"at_{c}"))
    between = links.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("at_u", "u").alias("u"), F.coalesce("at_v", "v").alias("v"))
    moved = small(cut(components(between)))  # no more than there are new links
    of = found.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    new = moved.join(found.select("id"), "id", "left_anti")
    return small(cut(of.select("id", F.coalesce("to", "component").alias("component")).union(new.select("id", "component"))))


def connected(
    members: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column] | None = None,
    sketched: Callable[[DataFrame], DataFrame] | None = None,
    like: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """(id, component) of the verified links among the members of each band; empty for no members or links. members: band, id, leader (the band's least id).

    verified takes pairs (u, v) and returns those that are links; near(a, b) tells from further columns of members (those of
    the two sides come in structs a and b) whether a pair can be one. Not all pairs of a band are made. First each id is
    compared with the least of its bands' leaders that it can be like, then with those leaders that are still in other
    components, then with one pivot of each band after the other, and at last with what is in another component even then, each
    pair in the first band that it shares. A pair that is never compared lies in one component, so components come out the same.

    From the pivots on, sharper sketches can be used: sketched takes the ids that it is about (a table with id) and returns them
    with the sketches' columns, of which like(a, b) tells whether a pair can be a link.
    """
    more = F.struct(*[c for c in members.columns if c not in ("band", "id", "leader")], F.lit(0).alias("_"))
    can = near or (lambda a, b: F.lit(True))

    def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left").withColumn("at", F.coalesce("component", "id")).drop("component")

    def to_leaders(at: DataFrame) -> DataFrame:
        """Pairs of members with leaders of their bands that lie in other components."""
        leaders = at.filter("id = leader").select(F.col("band").alias("b_band"), F.col("at").alias("b_at"), F.col("a").alias("b"))
        return at.join(leaders, (F.col("band") == F.col("b_band")) & (F.col("at") != F.col("b_at")) & can("a", "b")).select(F.col("id").alias("u"), F.col("leader").alias("v"))

    rows = members.select("band", "id", "leader", more.alias("a"))
    links = verified(cut(to_leaders(rows.withColumn("at", F.col("id"))).groupBy("u").agg(F.min("v").alias("v"))))
    found = small(cut(components(links)))
    found = merged(found, verified(cut(to_leaders(placed(rows, found)).distinct())))

    def still_apart(rows: DataFrame) -> DataFrame:
        """The rows of the bands whose members lie in different components."""
        at = placed(rows.drop("at"), found)
        apart = at.groupBy("band").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high").select("band")
        return cut(at.join(apart, "band"))

    other = lambda x: x.select(*[F.col(c).alias("b" if c == "a" else f"b_{c}") for c in x.columns])
    meet = (F.col("band") == F.col("b_band")) & (F.col("at") != F.col("b_at"))
    apart = still_apart(rows.filter("id <> leader").drop("leader"))  # all have been compared with the leaders
    if none_in(apart):
        return found
    # Most have met by chance: only those stay that can be like any one of the others. A semi-join makes no pairs.
    apart = cut(apart.join(other(apart), meet & can("a", "b"), "left_semi"))
    if none_in(apart):
        return found
    let_go(members.sparkSession)
    if sketched:
        sketches = sketched(cut(apart.select("id").distinct()))
        apart = cut(apart.drop("a").join(sketches.select("id", F.struct(*[c for c in sketches.columns if c != "id"]).alias("s")), "id"))
    can_be = like("s", "b_s") if sketched else can("a", "b")
    for k in range(PIVOTS):
        own = apart.groupBy("band").agg(F.min_by("id", F.xxhash64("id", F.lit(k))).alias("pivot"))
        pivots = cut(apart.join(own, "band").filter("id = pivot").drop("pivot"))
        pairs = apart.join(other(pivots), meet & can_be).select(F.col("id").alias("u"), F.col("b_id").alias("v"))
        found = merged(found, verified(cut(pairs.distinct())))
        apart = still_apart(apart)
        if none_in(apart):
            return found
    let_go(members.sparkSession)
    bands = apart.groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("bands"))  # no more than an id has
    apart = cut(apart.join(bands, "id"))
    first = F.array_intersect("bands", "b_bands")[0] == F.col("band")
    pairs = apart.join(other(apart), meet & (F.col("id") > F.col("b_id")) & can_be & first).select(F.col("id").alias("u"), F.col("b_id").alias("v"))
    return merged(found, verified(cut(pairs)))
