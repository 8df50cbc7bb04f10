"""Which trees to draw: groups of people, who a child is drawn under, roots, bloodlines.

Schemas: people (id, fetched, gender, year, family_categories), edges (a, b, relation, confidence), members (spec, id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.operators.identity import top_value
from kinloom.operators.traverse import fixpoint, reachable
from kinloom.plans.storage import written

T = Thresholds()


def family_specs(people: DataFrame, families: DataFrame, least: int = T.family_size, overlap: float = T.component_overlap) -> DataFrame:
    """(spec, kind, id): categories with enough people, and components with enough articles that those cover to less
    than ``overlap``. ``families`` is (family, id)."""
    c = people.select("id", F.explode("family_categories").alias("spec")).distinct()
    big = c.groupBy("spec").count().filter(F.col("count") >= least).select("spec")
    categories = written(c.join(big, "spec").select("spec", F.lit("category").alias("kind"), "id"), "specs")
    covered = categories.select("id").distinct().withColumn("covered", F.lit(1))
    articles = families.join(people.filter("fetched").select("id"), "id").join(covered, "id", "left")
    n = articles.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count("covered").alias("c"))
    free = n.filter((F.col("n") >= least) & (F.col("c") / F.col("n") < overlap)).select("family")
    components = families.join(free, "family").select(F.col("family").alias("spec"), F.lit("component").alias("kind"), "id")
    return categories.unionByName(components)


def _live(edges: DataFrame, relation: str) -> DataFrame:
    return edges.filter((F.col("relation") == relation) & (F.col("confidence") >= T.min_confidence)).select("a", "b")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def inside(edges: DataFrame, members: DataFrame, relation: str) -> DataFrame:
    """(spec, a, b): live edges of a relation with both ends in a group."""
    e = _live(edges, relation)
    return e.join(members.select("spec", F.col("id").alias("a")), "a").join(members.select("spec", F.col("id").alias("b")), ["spec", "b"]).select("spec", "a", "b")


def owners(people: DataFrame, edges: DataFrame, members: DataFrame, married_in: DataFrame | None = None) -> DataFrame:
    """(spec, child, owner): the parent that a child is drawn under. First come parents who are no grandparents
    recorded as parents, did not marry in, have an article, are male, are earlier; the smallest id decides ties."""
    p = written(inside(edges, members, "parent"), "trees")
    of = p.select("spec", F.col("a").alias("child"), F.col("b").alias("parent"))
    # a parent who has another parent of the child among their children comes last
    # found from edges between parents, which are few, and not from pairs of parents of a child
    between = p.select("spec", F.col("a").alias("q"), F.col("b").alias("parent")).join(of.select("spec", F.col("parent").alias("q")).distinct(), ["spec", "q"], "left_semi")
    grand = between.join(of.withColumnRenamed("parent", "q"), ["spec", "q"]).join(of, ["spec", "child", "parent"], "left_semi")
    grand = grand.select("spec", "child", "parent").distinct().withColumn("late", F.lit(1))
    ranked = of.join(grand, ["spec", "child", "parent"], "left").join(people.select(F.col("id").alias("parent"), "fetched", "gender", "year"), "parent", "left")
    if married_in is not None:
        ranked = ranked.join(married_in.select("spec", F.col("id").alias("parent"), F.lit(1).alias("wed_in")), ["spec", "parent"], "left")
    else:
        ranked = ranked.withColumn("wed_in", F.lit(None).cast("int"))
    order = [F.coalesce("late", F.lit(0)), F.coalesce("wed_in", F.lit(0)), (~F.coalesce("fetched", F.lit(False))).cast("int"),
             (F.coalesce("gender", F.lit("")) != "m").cast("int"), F.col("year").asc_nulls_last(), F.col("parent")]
    first = F.row_number().over(Window.partitionBy("spec", "child").orderBy(*order))
    return ranked.withColumn("r", first).filter("r = 1").select("spec", "child", F.col("parent").alias("owner"))


def choose_roots(people: DataFrame, edges: DataFrame, members: DataFrame, married_in: DataFrame | None = None) -> DataFrame:
    """(spec, id, place): people without a parent in the group who own a child, and whose spouse does not descend in it;
    of spouses who are both roots, the earlier in the order of articles, men, years, ids."""
    p = inside(edges, members, "parent")
    children = p.select("spec", F.col("a").alias("id")).distinct()
    wed = written(_both_ways_in(inside(edges, members, "spouse")), "trees")
    own = owners(people, edges, members, married_in).select("spec", F.col("owner").alias("id")).distinct()
    beside = wed.join(children.withColumnRenamed("id", "b"), ["spec", "b"]).select("spec", F.col("a").alias("id")).distinct()
    roots = own.join(children, ["spec", "id"], "left_anti").join(beside, ["spec", "id"], "left_anti")
    if married_in is not None:
        roots = roots.join(married_in.select("spec", "id"), ["spec", "id"], "left_anti")
    roots = roots.join(people.select("id", "fetched", "gender", "year"), "id", "left")
    order = [(~F.coalesce("fetched", F.lit(False))).cast("int"), (F.coalesce("gender", F.lit("")) != "m").cast("int"), F.col("year").asc_nulls_last(), F.col("id")]
    placed = written(roots.withColumn("place", F.row_number().over(Window.partitionBy("spec").orderBy(*order))).select("spec", "id", "place"), "trees")
    # a root goes if a spouse before it stays; chains of such roots are short, and settle from the front
    ahead = wed.join(placed.withColumnRenamed("id", "a"), ["spec", "a"]).join(placed.select("spec", F.col("id").alias("b"), F.col("place").alias("before")), ["spec", "b"])
    ahead = written(ahead.filter("before < place").select("spec", F.col("a").alias("id"), F.col("b").alias("other")), "trees")
    stay = written(placed.join(ahead, ["spec", "id"], "left_anti"), "trees")
    while True:
        out = ahead.join(stay.select("spec", F.col("id").alias("other")), ["spec", "other"]).select("spec", "id").distinct()
        open_ahead = ahead.join(out, ["spec", "id"], "left_anti").join(out.withColumnRenamed("id", "other"), ["spec", "other"], "left_anti")
        undecided = placed.join(out, ["spec", "id"], "left_anti")
        now = written(undecided.join(open_ahead, ["spec", "id"], "left_anti"), "trees")
        if now.count() == stay.count():
            return now
        stay = now


def _both_ways_in(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select("spec", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def bloodline(people: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): up from ``seeds`` (node) along fathers, down to all children, and the spouses of all these."""
    p = written(_live(edges, "parent"), "trees")
    fathers = written(p.join(people.filter("gender = 'm'").select(F.col("id").alias("b")), "b", "left_semi"), "trees")
    up = reachable(fathers.select(F.col("a").alias("source"), F.col("b").alias("target")), seeds)
    down = reachable(p.select(F.col("b").alias("source"), F.col("a").alias("target")), up)
    wed = _both_ways(_live(edges, "spouse")).join(down.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node"))
    return down.unionByName(wed).distinct()


def bloodlines(people: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(spec, id): ``bloodline`` of each group's own seeds (spec, id), all groups at once."""
    p = written(_live(edges, "parent"), "trees")
    fathers = written(p.join(people.filter("gender = 'm'").select(F.col("id").alias("b")), "b", "left_semi"), "trees")
    key, split = F.concat("spec", F.lit("\0"), "id").alias("node"), F.split("node", "\0", 2)

    def walk(start: DataFrame, step: DataFrame, own: str, other: str) -> DataFrame:
        def on(known: DataFrame) -> DataFrame:
            at = known.select(split[0].alias("spec"), split[1].alias(own))
            return at.join(step, own).select("spec", F.col(other).alias("id")).select(key)

        return fixpoint(start, on)

    down = walk(walk(seeds.select(key), fathers, "a", "b"), p, "b", "a").select(split[0].alias("spec"), split[1].alias("id"))
    wed = _both_ways(_live(edges, "spouse")).join(down.withColumnRenamed("id", "a"), "a").select("spec", F.col("b").alias("id"))
    return down.unionByName(wed).distinct()


def family_labels(people: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec, label) of (spec, kind, id): the category, or for components the most frequent surname of the members (the
    smallest on a tie), as categories are called; the group's number goes with a label that others have too, and
    stands for one that nobody gives."""
    named = specs.filter("kind = 'component'").join(people.select("id", "surname"), "id").filter(F.length("surname") > 0)
    modal = top_value(named, "spec", "surname").select("spec", F.concat(F.lit("משפחת "), "surname").alias("modal"))  # fixed value: how families are called
    each = specs.select("spec", "kind").distinct().join(modal, "spec", "left")
    each = each.withColumn("label", F.when(F.col("kind") == "component", F.col("modal")).otherwise(F.col("spec")))
    shared = each.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    told = F.when(F.col("label").isNull(), F.col("spec")).when((F.col("n") > 1) & (F.col("kind") == "component"), F.concat("label", F.lit(" ("), "spec", F.lit(")"))).otherwise(F.col("label"))
    return each.join(shared, "label", "left").select("spec", told.alias("label"))


def ancestor_subjects(slots: DataFrame, least: int = 3) -> DataFrame:
    """(person): people with enough known ancestors for a chart. ``slots`` is (person, slot, ancestor)."""
    return slots.groupBy("person").agg(F.countDistinct("slot").alias("n")).filter(F.col("n") >= least).select("person")
