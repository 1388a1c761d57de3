"""The concept graph: families, hops, degrees, bundles, walks and inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored

#: Which levels each relation may join.
EDGE_RULES = (("SCDC", "has_ingredient", "IN"), ("SCD", "consists_of", "SCDC"), ("IN", "has_tradename", "BN"), ("SCD", "has_tradename", "SBD"), ("SBD", "has_ingredient", "BN"))


def family_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges whose ends are active concepts of the levels that a rule allows, not loops; distinct."""
    c = concepts.where(~F.col("suppress").isin("Y", "O", "E")).select("rxcui", "tty")
    e = edges.where(F.col("source") != F.col("target")).distinct()
    e = e.join(c.select(F.col("rxcui").alias("source"), F.col("tty").alias("s_tty")), "source").join(c.select(F.col("rxcui").alias("target"), F.col("tty").alias("t_tty")), "target")
    allowed = F.lit(False)
    for s, r, t in EDGE_RULES:
        allowed = allowed | ((F.col("s_tty") == s) & (F.col("rela") == r) & (F.col("t_tty") == t))
    return e.where(allowed).select("source", "rela", "target", "s_tty", "t_tty")


def neighbours(of: DataFrame, edges: DataFrame, concepts: DataFrame, rela: str | None = None, outgoing: bool = True, tty: str | None = None) -> DataFrame:
    """rxcui, near: one hop from the concepts `of` (rxcui), over edges of a kind and direction, to a level."""
    here, there = ("source", "target") if outgoing else ("target", "source")
    e = edges if rela is None else edges.where(F.col("rela") == rela)
    e = e.select(F.col(here).alias("rxcui"), F.col(there).alias("near"))
    out = of.select("rxcui").join(e, "rxcui")
    if tty:
        out = out.join(concepts.where(F.col("tty") == tty).select(F.col("rxcui").alias("near")), "near", "left_semi")
    return out.select("rxcui", "near").distinct()


def degrees(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """rxcui, tty, n_out, n_in; both ends of an edge are counted in one grouping."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("rxcui"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("rxcui"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    n = ends.groupBy("e.rxcui").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))
    return concepts.join(n, "rxcui", "left").select("rxcui", "tty", F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"))


def bundled(edges: DataFrame, concepts: DataFrame, least: int = 6) -> DataFrame:
    """center, direction, rela, tty, n, collapsed, members of each concept's neighbours of degree one: groups of `least`
    or more collapse; of smaller groups the members are named."""
    ends = edges.select(F.col("source").alias("center"), F.lit("out").alias("direction"), "rela", F.col("target").alias("near")).unionByName(edges.select(F.col("target").alias("center"), F.lit("in").alias("direction"), "rela", F.col("source").alias("near")))
    degree = ends.groupBy("near").agg(F.count(F.lit(1)).alias("degree"))
    leaves = degree.where(F.col("degree") == 1).select("near").join(concepts.select(F.col("rxcui").alias("near"), "tty"), "near")
    of, each = ["center", "direction", "rela", "tty"], ends.join(leaves, "near")
    n = each.groupBy(*of).agg(F.count(F.lit(1)).alias("n"))
    few = each.join(n.where(F.col("n") < least).select(*of), of, "left_semi")  # members of small groups alone are gathered
    members = few.groupBy(*of).agg(F.array_join(F.array_sort(F.collect_set("near")), "|").alias("members"))
    return n.join(members, of, "left").select(*of, "n", (F.col("n") >= least).alias("collapsed"), "members")


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """rxcui, depth of all concepts within so many hops of the start, in either direction, at their least depth. Each round
    joins the newest ones only, leaves out those that were met, and is a written table; the walk ends where a round finds none."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    seen = front = stored(start.select("rxcui").distinct().withColumn("depth", F.lit(0)), "front")
    for k in range(1, depth + 1):
        found = front.join(both, F.col("rxcui") == F.col("a")).select(F.col("b").alias("rxcui")).distinct().join(seen.select("rxcui"), "rxcui", "left_anti").withColumn("depth", F.lit(k))
        front = stored(found, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def paged(rows: DataFrame, branch: list[str], order: list[Column], page: int, size: int = 9) -> DataFrame:
    """The page of each branch, from 0; a branch that has no such page shows its first."""
    w = Window.partitionBy(*branch)
    n = F.count(F.lit(1)).over(w)
    rows = rows.withColumn("__n", n).withColumn("__rn", F.row_number().over(w.orderBy(*order)))
    at = F.when(F.col("__n") > page * size, page).otherwise(0)
    return rows.where((F.col("__rn") > at * size) & (F.col("__rn") <= (at + 1) * size)).withColumn("page", at.cast("int")).drop("__n", "__rn")


def implied_specificity(names: DataFrame, group: str, name: str) -> DataFrame:
    """group, name, parents: how many other names of the group have a proper part of its words. A part's words all stand in the whole, so it
    is found by the one of them that fewest names of the group have, and array functions decide; words that all names have pair nothing."""
    w = names.select(group, name, F.array_distinct(F.split(F.lower(name), " ")).alias("w")).distinct()
    each = w.select(group, name, "w", F.explode("w").alias("word"))
    held = each.groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(held, [group, "word"]).groupBy(group, name, "w").agg(F.min(F.struct("n", "word")).alias("k"))
    part = rarest.select(group, F.col(name).alias("part"), F.col("w").alias("part_words"), "k.word")
    inside = (F.size("part_words") < F.size("w")) & (F.size(F.array_except("part_words", "w")) == 0)
    n = each.join(part, [group, "word"]).where(inside).groupBy(group, name).agg(F.count(F.lit(1)).alias("parents"))
    return w.join(n, [group, name], "left").select(group, name, F.coalesce("parents", F.lit(0)).cast("long").alias("parents"))


def ancestors(tree: DataFrame) -> DataFrame:
    """id, ancestor, depth, each node its own at depth 0, up the whole parent chain; a cycle ends where it would come round."""
    up = tree.select(F.col("id").alias("node"), F.col("parent_id").alias("next"))
    out = level = tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.col("parent_id").alias("next"), F.array("id").alias("met"))
    while True:
        level = level.where(F.col("next").isNotNull() & ~F.array_contains("met", F.col("next"))).select("id", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.array_append("met", F.col("next")).alias("met"))
        level = level.join(up, F.col("ancestor") == F.col("node"), "left").select("id", "ancestor", "depth", "next", "met")
        level = stored(level, "level")  # else a level would compute all those before it again
        if level.isEmpty():
            return out.select("id", "ancestor", "depth")
        out = out.unionByName(level)


def inherited_roles(grants: DataFrame, ancestry: DataFrame) -> DataFrame:
    """user_id, role, facility_id: what holds at a facility by grants on it or above it."""
    g = grants.select("user_id", "role", F.col("facility_id").alias("ancestor")).distinct()
    return ancestry.join(g, "ancestor").select("user_id", "role", F.col("id").alias("facility_id")).distinct()


def role_counts(grants: DataFrame, ancestry: DataFrame) -> DataFrame:
    """facility_id, users: how many distinct users hold a grant (user_id, facility_id) on a facility or above it; those with grants of no user only have 0.

    Of a user's grants on one path only the uppermost counts (in a cycle the one on the smallest id), so each place has its own number of users
    and a facility's is the sum up its path; users and facilities are never paired. Facilities with several parents at some place
    of their path, where users may come by two ways, count their pairs.
    """
    up = ancestry.select("id", "ancestor", "depth").distinct()
    g = grants.select("user_id", F.col("facility_id").alias("place")).distinct()
    above = up.where("depth > 0").select("id", "ancestor").distinct()
    back = above.select(F.col("ancestor").alias("id"), F.col("id").alias("ancestor"), F.lit(True).alias("round"))
    over = above.join(back, ["id", "ancestor"], "left").where(F.col("round").isNull() | (F.col("ancestor") < F.col("id"))).select(F.col("id").alias("place"), "ancestor")
    held = g.join(over, "place").select("user_id", "place", "ancestor").join(g.select("user_id", F.col("place").alias("ancestor")), ["user_id", "ancestor"], "left_semi")
    own = g.join(held.select("user_id", "place"), ["user_id", "place"], "left_anti").groupBy(F.col("place").alias("ancestor")).agg(F.count("user_id").alias("users"))
    forked = up.groupBy("id", "depth").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").distinct()
    sums = up.select("id", "ancestor").distinct().join(forked, "id", "left_anti").join(own, "ancestor").groupBy(F.col("id").alias("facility_id")).agg(F.sum("users").alias("users"))
    pairs = up.join(forked, "id", "left_semi").select("id", "ancestor").distinct().join(g.withColumnRenamed("place", "ancestor"), "ancestor")
    return sums.unionByName(pairs.groupBy(F.col("id").alias("facility_id")).agg(F.count_distinct("user_id").alias("users")))
