"""Edges that follow from others. Every rule looks at edges above the threshold and adds only edges that are not there.

Schemas: people (id, gender, name, surname, linked), edges (a, b, relation, confidence, ...); relation says what b is to a.
Rules run in a fixed order, each on the result of the one before. The rule on siblings looks at parents known before it
(one round), so that its result does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.operators.fusion import canonical_ends
from kinloom.plans.storage import written

T = Thresholds()


def coparents(parents: DataFrame) -> DataFrame:
    """(a, b): the father and the mother of children that have exactly one of each. ``parents`` is (child, parent, gender)."""
    m, f = F.col("gender") == "m", F.col("gender") == "f"
    end = lambda fold, test, name: fold(F.when(test, F.col("parent"))).alias(name)
    one = parents.groupBy("child").agg(end(F.min, m, "a"), end(F.max, m, "a2"), end(F.min, f, "b"), end(F.max, f, "b2"))
    return one.filter("a = a2 AND b = b2").select("a", "b").distinct()


def unique_candidates(pairs: DataFrame, by: list[str], candidate: str) -> DataFrame:
    """Rows whose group ``by`` has exactly one candidate."""
    n = pairs.groupBy(*by).agg(F.max(candidate).alias("__other"), F.min(candidate).alias(candidate))
    return n.filter(F.col("__other") == F.col(candidate)).drop("__other")


def _new(pairs: DataFrame, relation: str, confidence: float | Column, edges: DataFrame) -> DataFrame:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    rows = canonical_ends(pairs.select("a", "b", F.lit(relation).alias("relation"), conf.alias("confidence"))).filter("a <> b")
    rows = rows.groupBy("a", "b", "relation").agg(F.max("confidence").alias("confidence"))
    return rows.join(edges.select("a", "b", "relation"), ["a", "b", "relation"], "left_anti")


def _added(edges: DataFrame, new: DataFrame) -> DataFrame:
    flags = F.array(F.lit("inferred"), F.lit("no_ref"))
    return edges.unionByName(new.withColumns({"inferred": F.lit(True), "flags": flags}), allowMissingColumns=True)


def infer(people: DataFrame, edges: DataFrame, min_confidence: float = T.min_confidence) -> tuple[DataFrame, DataFrame]:
    """(people, edges) with what follows: co-parents are spouses, siblings share parents, a child-in-law and a child of
    the same in-law are spouses if only one fits, in-laws are parents of the spouse, or else of an unnamed child."""
    g = people.select("id", "gender")

    def live(e: DataFrame, relation: str) -> DataFrame:
        return e.filter((F.col("relation") == relation) & (F.col("confidence") >= min_confidence)).select("a", "b", "confidence")

    def parents(e: DataFrame) -> DataFrame:
        return live(e, "parent").select(F.col("a").alias("child"), F.col("b").alias("parent"), "confidence").join(
            g.withColumnsRenamed({"id": "parent"}), "parent", "left"
        )

    def spouses(e: DataFrame) -> DataFrame:
        s = live(e, "spouse").select("a", "b")
        return s.unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    # co-parents
    edges = written(_added(edges, _new(coparents(parents(edges)), "spouse", T.inferred, edges)), "infer")

    # siblings
    s = live(edges, "sibling").select("a", "b")
    s = s.unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    p = written(parents(edges), "infer")
    have = p.filter("gender IS NOT NULL").select(F.col("child").alias("b"), "gender").distinct()
    from_sibling = s.join(p.filter(F.col("confidence") >= T.sibling_parent).withColumnRenamed("child", "a"), "a").select("b", "parent", "gender")
    free = from_sibling.join(have, (from_sibling["b"] == have["b"]) & (from_sibling["gender"] == have["gender"]), "left_anti")
    # of several parents of one gender the smallest id is taken
    free = free.groupBy("b", "gender").agg(F.min("parent").alias("parent"))
    edges = written(_added(edges, _new(free.select(F.col("b").alias("a"), F.col("parent").alias("b")), "parent", T.inferred, edges)), "infer")

    # child-in-law and child of one in-law
    laws, kids, wed = live(edges, "parent_in_law").select("a", "b"), live(edges, "parent").select(F.col("a").alias("y"), "b"), spouses(edges)
    married = wed.select(F.col("a").alias("id")).distinct()
    attributes = people.select("id", "gender", "surname", F.col("id").startswith("~").alias("bare"))
    x = laws.withColumnRenamed("a", "x").join(married.withColumnRenamed("id", "x"), "x", "left_anti")
    y = kids.join(married.withColumnRenamed("id", "y"), "y", "left_anti")
    pair = x.join(y, "b").filter("x <> y")
    pair = pair.join(attributes.withColumnsRenamed({"id": "x", "gender": "gx", "surname": "sx", "bare": "bx"}), "x", "left")
    pair = pair.join(attributes.withColumnsRenamed({"id": "y", "gender": "gy", "surname": "sy", "bare": "by"}), "y", "left")
    pair = pair.filter("gx IS NULL OR gy IS NULL OR gx <> gy")
    mutual = live(edges, "parent").select(F.col("a").alias("x"), F.col("b").alias("p")).join(laws.select(F.col("a").alias("y"), F.col("b").alias("p")), "p")
    pair = pair.join(mutual.select("x", "y").distinct().withColumn("mutual", F.lit(True)), ["x", "y"], "left")
    name = (F.col("gy") == "f") & (F.length("sx") > 0) & (F.col("sx") == F.col("sy")) & F.col("by")
    pair = pair.withColumn("c", F.when(F.col("mutual"), T.inferred_mutual_in_law).when(name, T.inferred_married_name)).filter("c IS NOT NULL")
    single = unique_candidates(pair, ["x", "b"], "y").join(pair, ["x", "b", "y"])
    new = _new(single.select(F.col("x").alias("a"), F.col("y").alias("b"), "c"), "spouse", F.col("c"), edges) if "c" in single.columns else None
    edges = written(_added(edges, new), "infer")

    # in-laws are parents of the spouse; without a spouse, of a child without a name
    wed, p = spouses(edges), written(parents(edges), "infer")
    laws = live(edges, "parent_in_law").select(F.col("a").alias("person"), F.col("b").alias("law"))
    laws = laws.join(g.withColumnsRenamed({"id": "law", "gender": "lg"}), "law", "left")
    of_spouse = laws.join(wed.withColumnsRenamed({"a": "person", "b": "spouse"}), "person")
    same = p.select(F.col("child").alias("spouse"), F.col("gender").alias("lg")).filter("lg IS NOT NULL").distinct()
    free = of_spouse.join(same, ["spouse", "lg"], "left_anti").groupBy("spouse", "lg").agg(F.min("law").alias("law"))
    new = _new(free.select(F.col("spouse").alias("a"), F.col("law").alias("b")), "parent", T.inferred, edges)
    alone = laws.join(wed.select(F.col("a").alias("person")).distinct(), "person", "left_anti")
    alone = alone.join(g.withColumnsRenamed({"id": "person", "gender": "pg"}), "person", "left")
    child = F.when(F.col("pg") == "m", "f").when(F.col("pg") == "f", "m")
    label = F.when(child == "f", "בת").when(child == "m", "בן").otherwise("בן/בת")
    alone = written(alone.withColumns({"gender": child, "name": label, "id": F.concat(F.lit("~"), label, F.lit("@"), "law", F.lit(":inlaw:"), "person")}), "infer")
    virtual = alone.select("id", "gender", "name").distinct().join(people.select("id"), "id", "left_anti")
    people = people.unionByName(virtual, allowMissingColumns=True)
    edges = _added(edges, new)
    edges = _added(edges, _new(alone.select(F.col("id").alias("a"), F.col("law").alias("b")), "parent", T.inferred, edges))
    edges = _added(edges, _new(alone.select(F.col("id").alias("a"), F.col("person").alias("b")), "spouse", T.inferred, edges))
    return people, written(edges, "infer")
