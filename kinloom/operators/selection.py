"""Who belongs into a tree: surnames of a family, the person it is named after, those who married in, relatives without
an article, trees that say nothing new, links between trees, and the rows that describe a tree.

Schemas: people (id, name, surname, fetched), edges (a, b, relation, confidence), members (spec, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.functions.names import similar_surname
from kinloom.functions.text import disambiguator, display_name
from kinloom.operators.trees import inside
from kinloom.plans.storage import written

T = Thresholds()
# How families and their trees are titled, and titles before the name of a person.
FAMILY_PREFIXES = ("משפחת ", "עץ משפחת ")
NAMED_TITLES = ('כ"ק ', "רבי ", "הרב ", "ר' ")


def without_article(ident: Column, fetched: Column) -> Column:
    """Unlinked, or linked to a page that does not exist."""
    return ident.startswith("~") | ~F.coalesce(fetched, F.lit(False))


def base_of(label: Column) -> Column:
    """What a family is called by: its label without "family of"; null if it isn't called so."""
    out = F.lit(None).cast("string")
    for prefix in FAMILY_PREFIXES:
        out = F.when(label.startswith(prefix), F.trim(F.substr(label, F.lit(len(prefix) + 1)))).otherwise(out)
    return F.nullif(out, F.lit(""))


def family_surnames(people: DataFrame, members: DataFrame, labels: DataFrame, similar=similar_surname) -> DataFrame:
    """(spec, surname): the label's surname if a member has one like it, else the most frequent of the members (the
    smallest on a tie), else the label's; and all members' surnames that are like the chosen one. ``labels`` is (spec, label)."""
    own = members.join(people.select("id", "surname"), "id").filter(F.length("surname") > 0)
    count = written(own.groupBy("spec", "surname").agg(F.count(F.lit(1)).alias("n")), "surnames")
    base = labels.select("spec", base_of(F.col("label")).alias("base")).filter("base IS NOT NULL")
    fits = count.join(base, "spec").filter(similar(F.col("base"), F.col("surname"))).select("spec", "base").distinct()
    first = Window.partitionBy("spec").orderBy(F.desc("n"), "surname")
    modal = count.withColumn("r", F.row_number().over(first)).filter("r = 1").select("spec", F.col("surname").alias("modal"))
    chosen = labels.select("spec").join(fits.withColumnRenamed("base", "fit"), "spec", "left").join(modal, "spec", "left").join(base, "spec", "left")
    chosen = written(chosen.select("spec", F.coalesce("fit", "modal", "base").alias("main")).filter("main IS NOT NULL"), "surnames")
    alike = count.join(chosen, "spec").filter(similar(F.col("surname"), F.col("main"))).select("spec", "surname")
    return chosen.select("spec", F.col("main").alias("surname")).unionByName(alike).distinct()


def label_person(people: DataFrame, members: DataFrame, labels: DataFrame, similar=similar_surname) -> DataFrame:
    """(spec, id): the article that a family is named after, where its label is no member's surname and one article only
    has it as title, shown name or addition in parentheses; or, with an article before it, begins with it and a place."""
    base = labels.filter(F.col("label").startswith(FAMILY_PREFIXES[0])).select("spec", base_of(F.col("label")).alias("base")).filter("base IS NOT NULL")
    common = members.join(people.select("id", "surname"), "id").join(base, "spec").filter(similar(F.col("base"), F.col("surname"))).select("spec").distinct()
    base = written(base.join(common, "spec", "left_anti"), "labels")
    art = people.filter("fetched").select("id", display_name(F.col("id")).alias("shown"), disambiguator(F.col("id")).alias("extra"))
    extra = F.array(F.col("extra"), *[F.when(F.col("extra").startswith(t), F.substr("extra", F.lit(len(t) + 1))) for t in NAMED_TITLES])
    keys = art.select("id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("id", "shown"), extra)))).alias("base")).distinct()
    exact = base.join(keys, "base").select("spec", "id").distinct()
    place = art.select("id", F.regexp_extract("id", r"^(ה\S+(?: \S+)*?) מ", 1).alias("base")).filter("base <> ''")
    vague = base.join(exact, "spec", "left_anti").filter(F.col("base").startswith("ה")).join(place, "base").select("spec", "id").distinct()
    both = exact.unionByName(vague)
    return both.groupBy("spec").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other").select("spec", "id")


def married_in(people: DataFrame, edges: DataFrame, members: DataFrame, surnames: DataFrame, similar=similar_surname) -> DataFrame:
    """(spec, id): members who came into the family by marriage. They have a spouse in it; and either they bear another
    name and the spouse descends in it, or is of its name; or they bear its name, but only the spouse descends in it."""
    up = written(inside(edges, members, "parent").select("spec", F.col("a").alias("id")).distinct(), "married")
    wed = inside(edges, members, "spouse")
    wed = written(wed.unionByName(wed.select("spec", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "married")
    names = members.join(people.select("id", "surname"), "id").filter(F.length("surname") > 0).join(surnames.withColumnRenamed("surname", "of"), "spec")
    named = written(names.filter(similar(F.col("surname"), F.col("of"))).select("spec", "id").distinct(), "married")

    def flag(rows: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
        return rows.join(of.withColumnRenamed("id", column).withColumn(name, F.lit(True)), ["spec", column], "left")

    rows = flag(flag(flag(flag(wed, up, "b", "spouse_up"), named, "b", "spouse_named"), up, "a", "own_up"), named, "a", "own_named")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    each = rows.groupBy("spec", F.col("a").alias("id")).agg(*[any_of(c) for c in ("spouse_up", "spouse_named", "own_up", "own_named")])
    stranger = ~F.col("own_named") & F.when(F.col("own_up"), F.col("spouse_up")).otherwise(F.col("spouse_up") | F.col("spouse_named"))
    namesake = F.col("own_named") & ~F.col("own_up") & F.col("spouse_up")
    return each.filter(stranger | namesake).select("spec", "id")


def with_unlinked_relatives(people: DataFrame, edges: DataFrame, members: DataFrame, no_parents_of: DataFrame | None = None) -> DataFrame:
    """(spec, id): members, and their parents, children and spouses without an article; not the parents of those in
    ``no_parents_of`` (spec, id)."""
    e = edges.filter(F.col("relation").isin("parent", "spouse") & (F.col("confidence") >= T.min_confidence)).select("a", "b", "relation")
    bare = people.filter(without_article(F.col("id"), F.col("fetched"))).select("id")
    new = []
    for own, other in (("a", "b"), ("b", "a")):
        near = e.join(bare.withColumnRenamed("id", other), other, "left_semi").join(members.select("spec", F.col("id").alias(own)), own)
        if no_parents_of is not None:
            child = no_parents_of.select("spec", F.col("id").alias("a"), F.lit("parent").alias("relation"))
            near = near.join(child, ["spec", "a", "relation"], "left_anti")
        new.append(near.select("spec", F.col(other).alias("id")))
    return members.select("spec", "id").unionByName(new[0]).unionByName(new[1]).distinct()


def drop_redundant_roots(nodes: DataFrame, marriages: DataFrame, people: DataFrame) -> DataFrame:
    """``nodes`` (spec, root, person, has_children, is_root) without the trees in which everybody but the root is shown
    as a spouse in another tree of the group, if the root has no article or nobody but the root has children.
    ``marriages`` is (spec, root, spouse)."""
    shown = marriages.filter("spouse IS NOT NULL").select("spec", F.col("root").alias("other"), F.col("spouse").alias("person")).distinct()
    below = nodes.filter("NOT is_root")
    elsewhere = below.join(shown, ["spec", "person"]).filter("other <> root").select("spec", "root", "person").distinct().withColumn("twice", F.lit(1))
    each = below.join(elsewhere, ["spec", "root", "person"], "left").groupBy("spec", "root").agg(
        (F.count(F.lit(1)) == F.count("twice")).alias("all_twice"), F.bool_or("has_children").alias("grand"),
    )
    each = each.join(people.select(F.col("id").alias("root"), "fetched"), "root", "left")
    gone = each.filter(F.col("all_twice") & (~F.coalesce("fetched", F.lit(False)) | ~F.col("grand")))
    return nodes.join(gone.select("spec", "root"), ["spec", "root"], "left_anti")


def cross_links(built: DataFrame, existing: DataFrame) -> DataFrame:
    """(person, trees): the sorted titles of the trees that each person is in; trees are few a person.
    Both inputs are (person, title)."""
    both = existing.select("person", "title").unionByName(built.select("person", "title")).distinct()
    return both.groupBy("person").agg(F.sort_array(F.collect_list("title")).alias("trees"))


def tree_records(nodes: DataFrame, people: DataFrame, size: DataFrame) -> DataFrame:
    """(tree_id, people, articles, generations, width, height): a row about each tree. ``nodes`` is (tree_id, person,
    depth), ``size`` (tree_id, width, height)."""
    n = nodes.join(people.select(F.col("id").alias("person"), "fetched"), "person", "left").groupBy("tree_id").agg(
        F.countDistinct("person").alias("people"), F.countDistinct(F.when(F.col("fetched"), F.col("person"))).alias("articles"),
        (F.max("depth") + 1).alias("generations"),
    )
    return n.join(size, "tree_id", "left")
