"""People of the graph: who is in it, when they were probably born, and which mentions are one person across pages.

Schemas: people (id, name, fetched, gender, born, died: years or null, surname, separated), edges (a, b, relation,
confidence, evidence, alias_only, ...). Unlinked people have ids that begin with ``~``. Results are mappings (old, new),
so that one remap does the rewriting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.functions.names import key_words, plain_surname
from kinloom.functions.text import display_name
from kinloom.operators.fusion import noisy_or
from kinloom.operators.identity import merge_in_slots, remap, separate_namesakes
from kinloom.plans.storage import written

T = Thresholds()


def upsert_people(pages: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, name, fetched, gender): pages, and the ends of relations that no page stands for. Pages come first; of
    several mentions the first by ``order`` names the person, an empty name gives the id without its mark and anchor.

    ``pages`` is (id, name, gender), ``relations`` (person, relative, person_name, relative_name, person_gender,
    relative_gender, order).
    """
    rows = [pages.select("id", "name", "gender", F.lit(True).alias("fetched"), F.lit(-1).cast("long").alias("order"), F.lit(0).alias("side"))]
    for side, end in enumerate(("person", "relative")):
        rows.append(relations.select(
            F.col(end).alias("id"), F.col(f"{end}_name").alias("name"), F.col(f"{end}_gender").alias("gender"), F.lit(False).alias("fetched"),
            F.col("order").cast("long").alias("order"), F.lit(side).alias("side"),
        ))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).filter("id IS NOT NULL")
    first = every.groupBy("id").agg(F.min(F.struct("order", "side", "name", "gender")).alias("f"), F.bool_or("fetched").alias("fetched"))
    bare = F.when(F.col("id").startswith("~"), F.split(F.substr("id", F.lit(2)), "@", 2)[0]).otherwise(display_name(F.col("id")))
    name = F.coalesce(F.nullif(F.when(~F.col("f.name").startswith("~"), F.col("f.name")), F.lit("")), bare)
    return first.select("id", name.alias("name"), "fetched", F.col("f.gender").alias("gender"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def estimated_births(people: DataFrame, edges: DataFrame, rounds: int = 2, generation: int = T.generation) -> DataFrame:
    """(id, estimate): the own year of birth, else the earliest of a spouse's, else a generation before the earliest
    child, else a generation after the latest parent; children and parents count with estimates of the round before."""
    own = people.select("id", "born")
    wed = _both_ways(edges.filter("relation = 'spouse'"))
    beside = wed.join(own.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("born").alias("spouse"))
    sure = written(own.join(beside, "id", "left").select("id", F.coalesce("born", "spouse").alias("sure")), "births")
    parent = edges.filter("relation = 'parent'").select(F.col("a").alias("child"), F.col("b").alias("parent")).distinct()
    now = own.withColumnRenamed("born", "estimate")
    for _ in range(rounds):
        known = now.filter("estimate IS NOT NULL")
        below = parent.join(known.withColumnRenamed("id", "child"), "child").groupBy(F.col("parent").alias("id")).agg((F.min("estimate") - generation).alias("below"))
        above = parent.join(known.withColumnRenamed("id", "parent"), "parent").groupBy(F.col("child").alias("id")).agg((F.max("estimate") + generation).alias("above"))
        joined = sure.join(below, "id", "left").join(above, "id", "left")
        now = written(joined.select("id", F.coalesce("sure", "below", "above").cast("int").alias("estimate")), "births")
    return now


def _named(people: DataFrame) -> DataFrame:
    """People with the words of their name up to a maiden name; articles are named by their title."""
    name = F.when(F.col("id").startswith("~"), F.col("name")).otherwise(display_name(F.col("id")))
    words = key_words(F.split(name, r"\s+לבית\s+", 2)[0])
    return people.withColumn("words", words).withColumns({"first": F.try_element_at("words", F.lit(1)), "last": F.try_element_at("words", F.lit(-1))})


def _articles(named: DataFrame) -> DataFrame:
    return named.filter("fetched AND NOT startswith(id, '~')")


def _surname_counts(named: DataFrame) -> DataFrame:
    """(last, pages): how many articles have a surname."""
    s = plain_surname(F.col("surname"))
    return _articles(named).filter(F.length("surname") > 0).groupBy(s.alias("last")).agg(F.count(F.lit(1)).alias("pages"))


def _male(gender: Column) -> Column:
    return F.coalesce(gender == "m", F.lit(False))


def _relatives(people: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Neighbours (a, b), parents (child, parent), fathers (id, fathers) and certain fathers (id, certain)."""
    near = _both_ways(edges)
    parent = edges.filter("relation = 'parent'").select(F.col("a").alias("child"), F.col("b").alias("parent"), F.coalesce("alias_only", F.lit(False)).alias("weak"))
    male = parent.join(people.select(F.col("id").alias("parent"), "gender"), "parent").filter("gender = 'm'")
    fathers = male.groupBy(F.col("child").alias("id")).agg(F.collect_set("parent").alias("fathers"))  # a handful each
    certain = male.filter("NOT weak").groupBy(F.col("child").alias("id")).agg(F.collect_set("parent").alias("certain"))
    return near, parent.select("child", "parent").distinct(), fathers, certain


def _two_generations(pairs: DataFrame, parent: DataFrame) -> DataFrame:
    """(x, y) of ``pairs`` where one is a grandparent of the other."""
    over = pairs.join(parent.select(F.col("parent").alias("x"), F.col("child").alias("c")), "x").join(parent.select(F.col("child").alias("y"), F.col("parent").alias("c")), ["y", "c"])
    under = pairs.join(parent.select(F.col("parent").alias("y"), F.col("child").alias("c")), "y").join(parent.select(F.col("child").alias("x"), F.col("parent").alias("c")), ["x", "c"])
    return over.select("x", "y").unionByName(under.select("x", "y")).distinct()


def _far(a: str, b: str) -> Column:
    return F.coalesce(F.abs(F.col(a) - F.col(b)) > T.name_year_window, F.lit(False))


def merge_middle_names(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(old, new): unlinked men whose name of three words or more is an article's with further names in the middle.

    The surname must be rare and no given name, and one article only may fit. Mentions of one name are judged together:
    one that contradicts the article (a relative of it, another father, a child before its time, a grandparent, years
    too far apart) is somebody else, and then others are only merged if they are certainly far from that one in time.
    """
    named = written(_named(people), "merge")
    given = _articles(named).filter("first IS NOT NULL").select(F.col("first").alias("last")).distinct()
    rare = _surname_counts(named).filter(F.col("pages") <= T.rare_surname).select("last")
    art = _articles(named).filter(F.size("words") >= 2).select("first", "last", F.col("id").alias("y"), F.col("words").alias("own"), F.col("born").alias("born_y"))
    bare = named.filter(F.col("id").startswith("~") & _male(F.col("gender")) & (F.size("words") >= 3)).join(given, "last", "left_anti").join(rare, "last", "left_semi")
    inside = (F.size(F.array_except("own", "words")) == 0) & (F.size(F.array_distinct("own")) < F.size(F.array_distinct("words")))
    fit = bare.select("first", "last", "words", F.col("id").alias("x")).join(art, ["first", "last"]).filter(inside)
    one = fit.groupBy("words").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("words", "y")
    pairs = written(fit.join(one, ["words", "y"]).select("words", "x", "y", "born_y"), "merge")

    near, parent, fathers, certain = _relatives(people, edges)
    births = estimated_births(people, edges)
    bad = [pairs.join(near.withColumnsRenamed({"a": "x", "b": "y"}), ["x", "y"], "left_semi").select("x", "y"), _two_generations(pairs.select("x", "y"), parent)]
    judged = pairs.join(fathers.withColumnRenamed("id", "x"), "x", "left").join(certain.withColumnRenamed("id", "y"), "y", "left")
    kids = parent.join(people.select(F.col("id").alias("child"), "born"), "child").groupBy(F.col("parent").alias("x")).agg(F.min("born").alias("first_child"))
    judged = judged.join(kids, "x", "left").join(births.withColumnsRenamed({"id": "x", "estimate": "ex"}), "x", "left").join(births.withColumnsRenamed({"id": "y", "estimate": "ey"}), "y", "left")
    other_father = F.coalesce(~F.arrays_overlap("fathers", "certain"), F.lit(False))
    too_early = F.coalesce(F.col("first_child") < F.col("born_y") + T.parent_gap, F.lit(False))
    bad.append(judged.filter(other_father | too_early | _far("ex", "ey")).select("x", "y"))
    clash = bad[0].unionByName(bad[1]).unionByName(bad[2]).distinct().withColumn("clash", F.lit(True))
    judged = written(judged.select("words", "x", "y", "ex").join(clash, ["x", "y"], "left"), "merge")
    # years of those who are somebody else: a set of years is small; a missing year rules everything out
    others = judged.filter("clash").groupBy("words").agg(F.collect_set("ex").alias("years"), F.count_if(F.col("ex").isNull()).alias("unknown"))
    left = judged.filter("clash IS NULL").join(others, "words", "left")
    clear = F.col("years").isNull() | ((F.col("unknown") == 0) & F.col("ex").isNotNull() & F.forall("years", lambda e: F.abs(e - F.col("ex")) > T.name_year_window))
    return left.filter(clear).select(F.col("x").alias("old"), F.col("y").alias("new")).distinct()


def merge_full_names(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(old, new): pairs of people without an article, of one name that exactly two have.

    Either the whole name of three words or more is equal, and any article has that surname; or one name is the other
    with names in the middle, and the surname is rare. Neither may be a woman, one must be a man, and nothing may
    contradict: a direct relation, a separation, years, generations, other fathers (but common children settle that).
    Of a pair a linked one is kept, then the longer name, then one with a parent, then the smaller id.
    """
    named = written(_named(people).withColumn("separated", F.coalesce("separated", F.lit(False))), "merge")
    given = _articles(named).filter("first IS NOT NULL").select(F.col("first").alias("last")).distinct()
    counts = _surname_counts(named)
    loose = named.filter((F.col("id").startswith("~") | ~F.col("fetched")) & (F.size("words") >= 2)).join(given, "last", "left_anti").join(counts, "last")
    facts = F.struct("id", "words", "gender", "separated")

    def twos(rows: DataFrame, *by: str) -> DataFrame:
        two = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id"), facts.alias("f"))).alias("p"), F.max(F.struct(F.col("id"), facts.alias("f"))).alias("q"))
        return two.filter("n = 2").select(F.col("p.f").alias("p"), F.col("q.f").alias("q"))

    exact = twos(loose.filter(F.size("words") >= 3), "words").withColumn("tier", F.lit(0))
    part = lambda a, b: F.size(F.array_except(a, b)) == 0
    nested = twos(loose.filter(F.col("pages") <= T.rare_surname), "first", "last").filter(part("p.words", "q.words") | part("q.words", "p.words")).withColumn("tier", F.lit(1))
    pairs = exact.unionByName(nested).withColumns({"x": F.col("p.id"), "y": F.col("q.id")})
    woman = lambda c: F.coalesce(F.col(c) == "f", F.lit(False))
    pairs = pairs.filter(~woman("p.gender") & ~woman("q.gender") & (_male(F.col("p.gender")) | _male(F.col("q.gender"))) & ~F.col("p.separated") & ~F.col("q.separated"))
    pairs = written(pairs, "merge")

    near, parent, fathers, _ = _relatives(people, edges)
    births = estimated_births(people, edges)
    xy = pairs.select("x", "y").distinct()
    shared = xy.join(parent.select(F.col("parent").alias("x"), "child"), "x").join(parent.select(F.col("parent").alias("y"), "child"), ["y", "child"]).select("x", "y").distinct()
    judged = xy.join(births.withColumnsRenamed({"id": "x", "estimate": "ex"}), "x", "left").join(births.withColumnsRenamed({"id": "y", "estimate": "ey"}), "y", "left")
    judged = judged.join(fathers.withColumnsRenamed({"id": "x", "fathers": "fx"}), "x", "left").join(fathers.withColumnsRenamed({"id": "y", "fathers": "fy"}), "y", "left")
    judged = judged.join(shared.withColumn("shared", F.lit(True)), ["x", "y"], "left")
    strangers = F.col("shared").isNull() & F.coalesce(~F.arrays_overlap("fx", "fy"), F.lit(False))
    bad = judged.filter(strangers | _far("ex", "ey")).select("x", "y")
    bad = bad.unionByName(xy.join(near.withColumnsRenamed({"a": "x", "b": "y"}), ["x", "y"], "left_semi")).unionByName(_two_generations(xy, parent)).distinct()
    child = parent.select(F.col("child").alias("id")).distinct().withColumn("placed", F.lit(1))
    fine = pairs.join(bad, ["x", "y"], "left_anti")
    for c, k in (("x", "px"), ("y", "py")):
        fine = fine.join(child.withColumnsRenamed({"id": c, "placed": k}), c, "left")
    rank = lambda c, k: F.struct(F.col(f"{c}.id").startswith("~").alias("bare"), (-F.size(f"{c}.words")).alias("short"), F.col(k).isNull().alias("alone"), F.col(f"{c}.id").alias("id"))
    keep, drop = F.least(rank("p", "px"), rank("q", "py")), F.greatest(rank("p", "px"), rank("q", "py"))
    out = written(fine.select("tier", drop["id"].alias("old"), keep["id"].alias("new")), "merge")
    # one that goes by its whole name is no longer there for a nested one
    gone = out.filter("tier = 0").select("old")
    later = out.filter("tier = 1").join(gone, "old", "left_anti").join(gone.withColumnRenamed("old", "new"), "new", "left_anti")
    return out.filter("tier = 0").select("old", "new").unionByName(later.select("old", "new")).groupBy("old").agg(F.min("new").alias("new"))


def fuse_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (a, b, relation): evidence put together, confidence of all its evidence, weak only if all is."""
    columns = edges.columns
    piece = F.explode_outer("evidence")
    rows = edges.select("a", "b", "relation", "confidence", F.coalesce("alias_only", F.lit(False)).alias("alias_only"), piece.alias("piece"))
    one = rows.groupBy("a", "b", "relation").agg(
        F.array_sort(F.array_compact(F.collect_set("piece"))).alias("evidence"), F.max("confidence").alias("most"), F.bool_and("alias_only").alias("alias_only"),
    )
    sure = F.expr("evidence")
    scored = one.withColumn("p", F.explode_outer(sure)).groupBy("a", "b", "relation").agg(noisy_or(F.col("p.confidence")).alias("fused")) if _has_confidence(edges) else None
    out = one if scored is None else one.join(scored, ["a", "b", "relation"])
    confidence = F.col("most") if scored is None else F.greatest("most", F.round(F.coalesce("fused", "most"), 2))
    out = out.select("a", "b", "relation", confidence.alias("confidence"), "alias_only", "evidence")
    rest = [c for c in columns if c not in out.columns]
    if rest:  # other fields of the first edge
        first = edges.groupBy("a", "b", "relation").agg(F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), F.to_json(F.struct(*rest)))).alias("r"))
        out = out.join(first, ["a", "b", "relation"]).select(*out.columns, *[F.col(f"r.{c}").alias(c) for c in rest])
    return out.select(columns)


def _has_confidence(edges: DataFrame) -> bool:
    return "confidence" in edges.schema["evidence"].dataType.elementType.fieldNames()


def apply_mapping(people: DataFrame, edges: DataFrame, mapping: DataFrame, weak: bool = False) -> tuple[DataFrame, DataFrame]:
    """(people, edges) after replacing ``old`` by ``new``; ``weak`` marks the evidence of moved edges as resolved by name.
    The kept person takes a longer name from those that it replaces, if it has no article itself."""
    mapping = written(mapping, "mapping")
    if weak:
        moved = mapping.select(F.col("old").alias("__id"), F.lit(True).alias("__m"))
        for end in ("a", "b"):
            edges = edges.join(moved.withColumnsRenamed({"__id": end, "__m": f"__{end}"}), end, "left")
        hit = F.col("__a").isNotNull() | F.col("__b").isNotNull()
        marked = F.transform("evidence", lambda v: v.withField("alias", F.lit(True)))
        edges = edges.withColumns({"evidence": F.when(hit, marked).otherwise(F.col("evidence")), "alias_only": F.when(hit, True).otherwise(F.col("alias_only"))}).drop("__a", "__b")
    longest = mapping.join(people.select(F.col("id").alias("old"), "name"), "old").groupBy("new").agg(F.max(F.struct(F.length("name").alias("n"), "name")).alias("l"))
    kept = people.join(mapping.select(F.col("old").alias("id")), "id", "left_anti").join(longest.withColumnRenamed("new", "id"), "id", "left")
    name = F.when(F.col("id").startswith("~") & (F.coalesce("l.n", F.lit(0)) > F.length("name")), F.col("l.name")).otherwise(F.col("name"))
    people = written(kept.withColumn("name", name).select(people.columns), "merged")
    return people, written(fuse_edges(remap(edges, mapping)), "merged")


def merge_all(people: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole schedule: namesakes apart, slots, names across pages, slots, namesakes again, slots."""

    def slots(p: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
        return apply_mapping(p, e, merge_in_slots(p, e, T.slot_year_window, estimated_births(p, e)))

    def across(p: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
        p, e = apply_mapping(p, e, merge_middle_names(p, e), weak=True)
        return apply_mapping(p, e, merge_full_names(p, e))

    def apart(p: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
        before = p.select("id")
        p, e = separate_namesakes(p, e)
        fresh = p.join(before.withColumn("__old", F.lit(True)), "id", "left")
        p = written(fresh.withColumn("separated", F.coalesce("separated", F.lit(False)) | F.col("__old").isNull()).drop("__old"), "merged")
        return p, e

    steps: tuple[Callable, ...] = (apart, slots, across, slots, apart, slots)
    for step in steps:
        people, edges = step(people, edges)
    return people, edges
