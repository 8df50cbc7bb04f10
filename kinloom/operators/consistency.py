"""Rules that lower the confidence of edges which cannot be true, and flag people.

Schemas: people (id, gender, born, died: years or null), edges (a, b, relation, confidence, inferred, flags, alias_only,
n_evidence). Each rule is a join that marks edges; marked edges get a flag and a cap. Rules see what rules before them
have lowered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.operators.traverse import break_cycles
from kinloom.plans.storage import written

T = Thresholds()
SOLID = 0.5


def parent_years(child_born: Column, child_died: Column, parent_born: Column, parent_died: Column) -> Column:
    """too_late, posthumous or null: whether the years of a parent and a child can be true."""
    late = (child_born < parent_born + T.parent_gap) | (child_died < parent_born)
    after = child_born > parent_died + T.posthumous
    return F.when(F.coalesce(late, F.lit(False)), "too_late").when(F.coalesce(after, F.lit(False)), "posthumous")


def capped(edges: DataFrame, marked: DataFrame, flag: str, cap: float = T.rule_cap) -> DataFrame:
    """``edges`` with ``flag`` and ``cap`` on those in ``marked`` (a, b, relation); a null cap only flags."""
    m = marked.select("a", "b", "relation").distinct().withColumn("__m", F.lit(True))
    out = edges.join(m, ["a", "b", "relation"], "left")
    lower = F.when(F.col("__m"), F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")) if cap is not None else F.col("confidence")
    flags = F.when(F.col("__m"), F.array_append(F.coalesce("flags", F.array().cast("array<string>")), F.lit(flag))).otherwise(F.col("flags"))
    return written(out.withColumns({"confidence": lower, "flags": flags}).drop("__m"), "consistency")


def several_parents(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, gender): people with more than one father or mother among the solid edges."""
    p = _parents(edges).join(people.select(F.col("id").alias("b"), "gender"), "b")
    return p.groupBy(F.col("a").alias("id"), "gender").agg(F.countDistinct("b").alias("n")).filter("n > 1 AND gender IS NOT NULL").select("id", "gender")


def flagged_people(people: DataFrame, edges: DataFrame) -> DataFrame:
    """``people`` with flags: several_fathers, several_mothers, by the edges that rules have left."""
    named = F.when(F.col("gender") == "m", "several_fathers").otherwise("several_mothers")
    own = several_parents(people, edges).groupBy("id").agg(F.sort_array(F.collect_set(named)).alias("__flags"))
    old = F.col("flags") if "flags" in people.columns else F.array().cast("array<string>")
    out = people.join(own, "id", "left").withColumn("flags", F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce("__flags", F.array().cast("array<string>")))))
    return out.drop("__flags")


def _parents(edges: DataFrame, least: float = SOLID) -> DataFrame:
    return edges.filter((F.col("relation") == "parent") & (F.col("confidence") >= least))


def _solid(edges: DataFrame, relation: str) -> DataFrame:
    return edges.filter((F.col("relation") == relation) & (F.col("confidence") >= SOLID) & ~F.col("inferred") & ~F.coalesce("alias_only", F.lit(False)))


def repair(people: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` after all rules, in order."""
    who = lambda end: people.select(F.col("id").alias(end), F.col("gender").alias(f"g_{end}"), F.col("born").alias(f"born_{end}"), F.col("died").alias(f"died_{end}"))
    with_years = lambda e: e.join(who("a"), "a", "left").join(who("b"), "b", "left")

    edges = capped(edges, edges.filter("relation = 'parent' AND a = b"), "self", None)
    years = parent_years(F.col("born_a"), F.col("died_a"), F.col("born_b"), F.col("died_b"))
    judged = written(with_years(edges.filter("relation = 'parent'")).withColumn("why", years).filter("why IS NOT NULL"), "consistency")
    edges = capped(edges, judged.filter("why = 'too_late'"), "parent_born_too_late")
    edges = capped(edges, judged.filter("why = 'posthumous'"), "parent_died_before_birth")

    fathers = _parents(edges).join(people.select(F.col("id").alias("b"), "gender"), "b").filter("gender = 'm'")
    alias = F.coalesce("alias_only", F.lit(False))
    mixed = fathers.groupBy("a").agg(F.bool_or(~alias).alias("solid"), F.bool_or(alias).alias("alias")).filter("solid AND alias")
    edges = capped(edges, fathers.filter(alias).join(mixed, "a", "left_semi"), "father_by_alias")

    siblings = with_years(edges.filter(f"relation = 'sibling' AND confidence >= {SOLID}"))
    edges = capped(edges, siblings.filter(F.abs(F.col("born_a") - F.col("born_b")) > T.sibling_gap), "siblings_far_apart")

    p = _parents(edges)
    first = p.select(F.col("a").alias("grandchild"), F.col("b").alias("a")).join(people.select(F.col("id").alias("grandchild"), "born"), "grandchild")
    first = first.groupBy("a").agg(F.min("born").alias("first_born"))
    early = p.join(first, "a").join(people.select(F.col("id").alias("b"), F.col("born").alias("born_b")), "b")
    edges = capped(edges, early.filter(F.col("first_born") < F.col("born_b") + T.grandparent_gap), "grandchild_before_grandparent")

    par = edges.filter("relation = 'parent'").withColumn("alias_any", alias)
    par = break_cycles(par, T.cycle_cap)
    edges = capped(edges, par.filter("in_cycle"), "cycle", T.cycle_cap)

    solid = written(_solid(edges, "parent").select("a", "b"), "consistency")
    grand = solid.select("a", F.col("b").alias("p")).join(solid.select(F.col("a").alias("p"), "b"), "p").filter("p <> b")
    edges = capped(edges, _parents(edges).join(grand.select("a", "b").distinct(), ["a", "b"], "left_semi"), "grandparent_as_parent")
    wed = _solid(edges, "spouse").select(F.col("a").alias("p"), F.col("b").alias("s"))
    wed = wed.unionByName(wed.select(F.col("s").alias("p"), F.col("p").alias("s")))
    via = solid.select("a", F.col("b").alias("p")).join(wed, "p").join(solid.select(F.col("a").alias("s"), "b"), "s").filter("p <> b AND s <> b")
    edges = capped(edges, _parents(edges).join(via.select("a", "b").distinct(), ["a", "b"], "left_semi"), "grandparent_as_parent")

    wed = with_years(edges.filter("relation = 'spouse'"))
    edges = capped(edges, wed.filter("g_a = g_b"), "spouses_of_one_gender")
    wed = edges.filter("relation = 'spouse'").select("a", "b")
    either = wed.unionByName(wed.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return capped(edges, edges.filter("relation = 'parent'").join(either, ["a", "b"], "left_semi"), "parent_and_spouse", None)
