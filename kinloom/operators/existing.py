"""Trees that the site has already: found by four probes, read, and turned into who is in which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text as tx

# How titles of trees begin.
TREE_PREFIXES = ("עץ משפחת", "עץ משפחה של", "עץ משפחה -", "עץ משפחה –", "עץ משפחה")
DRAFT, TEMPLATE = 2, 10


def bare_title(title: Column) -> Column:
    """The title without its namespace."""
    return F.regexp_replace(title, r"^[^:]*:", "")


def family_hint(title: Column) -> Column:
    """What a tree's title says about its family: no namespace, no "family tree of", no subpage."""
    prefix = "^(?:" + "|".join(TREE_PREFIXES) + r")\s*"
    return F.regexp_replace(F.trim(F.regexp_replace(bare_title(title), prefix, "")), r"/.*$", "")


def tree_titled(title: Column) -> Column:
    out = F.lit(False)
    for p in TREE_PREFIXES:
        out = out | bare_title(title).startswith(p)
    return out


def find_trees(pages: DataFrame, category: str, templates: tuple[str, ...], phrase: str = '"עץ משפחת"') -> DataFrame:
    """(title, ns, sources, draft): pages that are trees, each once with all probes that found it.

    ``pages`` is (title, ns, categories, uses, wikitext), with ``uses`` the templates that it names. Probes are the
    category, use of a tree template (by templates and pages that are titled as trees), the title, and the text (by
    pages that are titled as trees). A page of the category, with a tree template, or with a tree's title is a tree.
    """
    used = F.array_intersect("uses", F.array(*[F.lit(t) for t in templates]))
    titled = tree_titled(F.col("title"))
    some = F.col("wikitext").contains(phrase.strip('"'))
    found = F.concat(
        F.when(F.array_contains("categories", category), F.array(F.lit("category"))).otherwise(F.array().cast("array<string>")),
        F.when((F.col("ns") == TEMPLATE) | titled, F.transform(used, lambda t: F.concat(F.lit("embeds:"), t))).otherwise(F.array().cast("array<string>")),
        F.when(titled, F.array(F.lit("prefix"))).otherwise(F.array().cast("array<string>")),
        F.when(titled & some, F.array(F.lit("search"))).otherwise(F.array().cast("array<string>")),
    )
    rows = pages.select("title", "ns", F.explode(found).alias("source"), (F.size(used) > 0).alias("uses_tree"), titled.alias("titled"))
    each = rows.groupBy("title").agg(F.max("ns").alias("ns"), F.sort_array(F.collect_set("source")).alias("sources"), F.bool_or("uses_tree").alias("u"), F.bool_or("titled").alias("t"))
    return each.filter(F.col("u") | F.col("t") | F.array_contains("sources", "category")).select("title", "ns", "sources", (F.col("ns") == DRAFT).alias("draft"))


def tree_contents(trees: DataFrame, pages: DataFrame, row: str) -> DataFrame:
    """(title, persons, rows, width): the linked people, sorted, and the grid's rows and widest row, of each tree.
    ``row`` is the name of the row template; a cell is an unnamed parameter."""
    text = tx.normalize_quotes(tx.strip_comments(F.coalesce("wikitext", F.lit(""))))
    body = trees.select("title").join(pages.select("title", text.alias("text")), "title")
    marks = F.regexp_extract_all("text", F.lit(r"(?m)^\s*\{\{\s*" + row + r"\s*\|(.*)\}\}\s*$"), F.lit(1))
    free = F.transform(marks, lambda m: F.regexp_replace(F.regexp_replace(m, r"\[\[[^\]]*\]\]", "L"), r"\{\{[^{}]*\}\}", "T"))
    widths = F.transform(free, lambda m: F.size(F.filter(F.split(m, r"\|", -1), lambda c: ~c.contains("="))))
    people = F.array_sort(F.array_distinct(F.transform(tx.wikilinks(F.col("text")), lambda l: l["target"])))
    return body.select("title", people.alias("persons"), F.size(widths).alias("rows"), F.coalesce(F.array_max(widths), F.lit(0)).alias("width"))


def person_trees(trees: DataFrame, contents: DataFrame) -> DataFrame:
    """(person, title): who is in which tree; drafts don't count."""
    live = trees.filter("NOT draft").select("title")
    return contents.join(live, "title", "left_semi").select(F.explode("persons").alias("person"), "title").distinct()
