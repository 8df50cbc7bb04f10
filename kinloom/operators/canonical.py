"""Which pages are people, and what link targets really are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.traverse import follow_redirects


@dataclass(frozen=True)
class PersonRules:
    """Patterns of titles and categories; the first test that decides, decides."""

    title_never: str
    category_yes: str
    category_no: str
    title_weak: str
    text_yes: str
    text_chars: int = 1500


def is_person_page(title: Column, categories: Column, text: Column, rules: PersonRules) -> Column:
    """No by title; yes by a category that speaks for and not against it; no if there are other categories; else by text."""
    some = F.coalesce(F.size(categories) > 0, F.lit(False))
    good = F.exists(categories, lambda c: c.rlike(rules.category_yes) & ~c.rlike(rules.category_no))
    said = F.substring(F.coalesce(text, F.lit("")), 1, rules.text_chars).rlike(rules.text_yes)
    return (
        F.when(title.rlike(rules.title_never), False)
        .when(F.coalesce(good, F.lit(False)), True)
        .when(some, False)
        .when(title.rlike(rules.title_weak), False)
        .otherwise(said)
    )


def unresolved_targets(relations: DataFrame, known: DataFrame, resolution: DataFrame) -> DataFrame:
    """(target): linked ends of relations that are neither pages nor resolved yet."""
    ends = relations.select(F.explode(F.array("person", "relative")).alias("target")).filter(~F.col("target").startswith("~"))
    return ends.distinct().join(known.select(F.col("title").alias("target")), "target", "left_anti").join(resolution.select("target"), "target", "left_anti")


def canonicalise(relations: DataFrame, resolution: DataFrame, people: DataFrame, gendered: DataFrame) -> DataFrame:
    """Relations with both ends at the end of their redirects, and has_article set.

    ``resolution`` is (target, to, exists), ``people`` (title) the pages of people, ``gendered`` (id) the ends whose
    gender is known. A relation goes if an end exists, is no person's page and has no gender; ends that fall together go.
    """
    ends = follow_redirects(resolution.filter("to IS NOT NULL").select(F.col("target").alias("source"), F.col("to").alias("target")))
    exists = resolution.select(F.col("target").alias("id"), "exists")
    person = people.select(F.col("title").alias("id")).distinct().withColumn("person_page", F.lit(True))
    out = relations
    for end in ("person", "relative"):
        m = ends.select(F.col("source").alias(end), F.col("target").alias("__to"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
        e = exists.withColumnsRenamed({"id": end, "exists": "__exists"})
        p = person.withColumnsRenamed({"id": end, "person_page": "__page"})
        g = gendered.select(F.col("id").alias(end)).distinct().withColumn("__gender", F.lit(True))
        out = out.join(e, end, "left").join(p, end, "left").join(g, end, "left")
        page = F.coalesce("__page", F.lit(False))
        thing = F.coalesce("__exists", F.lit(False)) & ~page & ~F.coalesce("__gender", F.lit(False))
        out = out.filter(~thing | F.col(end).startswith("~")).withColumn(f"{end}_has_article", page).drop("__exists", "__page", "__gender")
    return out.filter("person <> relative")
