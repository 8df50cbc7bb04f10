"""What stands in the boxes of a tree: labels, spouses, sources, relatives in other families, what is left out.

A box is a row of ``shown`` (tree_id, person, role: member or spouse, depth, partner: of spouses). All of it is joins and
aggregates by (tree_id, person); lists are a handful long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.functions.text import disambiguator, display_name
from kinloom.plans.storage import written

T = Thresholds()
# Words in boxes, by gender where there are two.
WIFE_OF, HUSBAND_LABEL = "אשת", "אשתו:"
CHILD_WORD, SIBLING_WORD, PARENT_WORD = {"f": "בת", "m": "בן"}, {"f": "אחות", "m": "אח"}, {"f": "אם", "m": "אב"}
IN_LAW_WORD = {"f": "גיסתו", "m": "גיסו"}
ANONYMOUS, MORE_BELOW, MORE_CHILDREN, CHILDREN = "ללא ערך", "(יש צאצאים נוספים)", "ילדים נוספים", "ילדים"
TEMPLATE_SPACE = "תבנית:"
BREAK = "<br />"


def _small(text: Column) -> Column:
    return F.concat(F.lit(f"{BREAK}<small>"), text, F.lit("</small>"))


def _word(words: dict[str, str], gender: Column, default: str | None = None) -> Column:
    return F.when(gender == "f", words["f"]).when(gender == "m", words["m"]).otherwise(F.lit(default))


def sanitize_ref(ref: Column) -> Column:
    """A footnote inside a template parameter: bars outside links and templates are written as a template."""
    held = F.regexp_extract_all(ref, F.lit(r"\[\[[^\[\]]*\]\]|\{\{[^{}]*\}\}"), F.lit(0))
    free = F.transform(F.split(ref, r"\[\[[^\[\]]*\]\]|\{\{[^{}]*\}\}", -1), lambda p: F.replace(p, F.lit("|"), F.lit("{{!}}")))
    return F.array_join(F.zip_with(free, held, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def person_label(ident: Column, name: Column, born: Column, died: Column, years: bool = True) -> Column:
    """A link to the article, under its shown name, with the addition of its title and years in small print; unlinked
    people have their name alone. ``born`` and ``died`` are as written, or null."""
    linked = ~ident.startswith("~")
    shown, extra = display_name(ident), F.nullif(disambiguator(ident), F.lit(""))
    link = F.concat(F.lit("[["), F.when(shown != ident, F.concat(ident, F.lit("|"), shown)).otherwise(ident), F.lit("]]"))
    span = F.when(born.isNotNull() | died.isNotNull(), F.concat(F.coalesce(born, F.lit("?")), F.when(died.isNotNull(), F.concat(F.lit("–"), died)).otherwise("")))
    parts = F.array_compact(F.array(F.when(linked, extra), span if years else F.lit(None).cast("string")))
    note = F.when(F.size(parts) > 0, _small(F.array_join(parts, " · "))).otherwise("")
    return F.concat(F.when(linked, link).otherwise(F.coalesce(name, F.lit(""))), note)


def tree_links(person_trees: DataFrame) -> DataFrame:
    """(person, tree, link): links to the trees, which are templates, that people are in. ``person_trees`` is (person, title)."""
    t = person_trees.filter(F.col("title").startswith(TEMPLATE_SPACE)).distinct()
    link = F.concat(F.lit("([["), "title", F.lit("|"), F.substr("title", F.lit(len(TEMPLATE_SPACE) + 1)), F.lit("]])"))
    return t.select("person", F.col("title").alias("tree"), link.alias("link"))


def _link_for(rows: DataFrame, links: DataFrame, person: str) -> DataFrame:
    """``rows`` with link: to the first tree that ``person`` is in, other than the row's own."""
    near = rows.join(links.withColumnRenamed("person", person), person).filter(F.col("tree") != F.col("tree_id"))
    first = near.groupBy("tree_id", person).agg(F.min(F.struct("tree", "link"))["link"].alias("link"))
    return rows.join(first, ["tree_id", person], "left")


def article_relatives(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, relative): for people without an article a parent with one, men first, or else a sibling."""
    e = edges.filter(F.col("confidence") >= T.min_confidence)
    up = e.filter("relation = 'parent'").select(F.col("a").alias("id"), F.lit(0).alias("rank"), F.lit("parent").alias("kind"), F.col("b").alias("relative"))
    s = e.filter("relation = 'sibling'")
    beside = [s.select(F.col(x).alias("id"), F.lit(1).alias("rank"), F.lit("sibling").alias("kind"), F.col(y).alias("relative")) for x, y in (("a", "b"), ("b", "a"))]
    rows = up.unionByName(beside[0]).unionByName(beside[1]).join(people.filter("fetched").select(F.col("id").alias("relative"), "gender"), "relative")
    first = F.min(F.struct("rank", (F.coalesce("gender", F.lit("")) != "m").alias("woman"), "relative", "kind"))
    out = rows.groupBy("id").agg(first.alias("f"))
    return out.join(people.filter("fetched").select("id"), "id", "left_anti").select("id", "f.kind", "f.relative")


def spouse_phrases(inline: DataFrame, people: DataFrame, edges: DataFrame, links: DataFrame, hide: bool = True) -> DataFrame:
    """(tree_id, person, spouses): the spouses without a box, in words. ``inline`` is (tree_id, person, spouse, place).

    Women are "wife of" theirs, men have "his wife". A spouse without an article is, with ``hide``, named only as child
    or sibling of someone with one, and left out without such. A link to the tree of the spouse's family follows.
    """
    g = people.select("id", "name", "fetched", "gender")
    rows = inline.join(g.select(F.col("id").alias("person"), F.col("gender").alias("own")), "person", "left")
    rows = rows.join(g.withColumnsRenamed({"id": "spouse", "name": "sname", "fetched": "sfetched", "gender": "sgender"}), "spouse", "left")
    rows = rows.join(article_relatives(people, edges).withColumnRenamed("id", "spouse"), "spouse", "left")
    gender = F.coalesce("sgender", F.when(F.col("own") == "m", "f").when(F.col("own") == "f", "m"))
    word = F.when(F.col("kind") == "parent", _word(CHILD_WORD, gender)).otherwise(_word(SIBLING_WORD, gender))
    none = F.lit(None).cast("string")
    secret = F.lit(hide) & ~F.coalesce("sfetched", F.lit(False))
    told = F.when(secret, F.concat_ws(" ", word, person_label(F.col("relative"), none, none, none, years=False))).otherwise(person_label(F.col("spouse"), F.col("sname"), none, none, years=False))
    told = F.when(secret & (F.col("relative").isNull() | word.isNull()), none).otherwise(told)
    rows = rows.withColumns({"told": told, "of": F.when(secret, F.col("relative")).otherwise(F.col("spouse"))}).filter("told IS NOT NULL")
    rows = _link_for(rows, links, "of")
    wife = (F.col("own") == "f") | (F.col("own").isNull() & F.coalesce(F.col("sgender") == "m", F.lit(False)))
    phrase = F.concat_ws(" ", F.when(F.coalesce(wife, F.lit(False)), WIFE_OF).otherwise(HUSBAND_LABEL), "told", "link")
    return rows.groupBy("tree_id", "person").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", phrase.alias("p"))))["p"], "; ").alias("spouses"))


def sources(shown: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """(tree_id, person, refs): the first footnotes of why someone stands there: as child, or as spouse of the partner.
    ``edges`` has evidence with refs."""
    notes = lambda rel: edges.filter(F.col("relation") == rel).select("a", "b", F.posexplode("evidence").alias("at", "v")).select("a", "b", "at", F.posexplode("v.refs").alias("no", "ref"))
    child = shown.filter("role = 'member' AND depth > 0").join(notes("parent").withColumnRenamed("a", "person"), "person")
    wed = notes("spouse")
    wed = wed.unionByName(wed.select(F.col("b").alias("a"), F.col("a").alias("b"), "at", "no", "ref"))
    spouse = shown.filter("role = 'spouse'").join(wed.withColumnsRenamed({"a": "person", "b": "partner"}), ["person", "partner"])
    rows = child.select("tree_id", "person", "b", "at", "no", "ref").unionByName(spouse.select("tree_id", "person", F.col("partner").alias("b"), "at", "no", "ref"))
    once = rows.groupBy("tree_id", "person", "ref").agg(F.min(F.struct("b", "at", "no")).alias("o"))
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("tree_id", "person").orderBy("o", "ref"))).filter(F.col("r") <= most)
    return first.groupBy("tree_id", "person").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "ref")))["ref"], sanitize_ref), "").alias("refs"))


def in_law_lines(shown: DataFrame, people: DataFrame, edges: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """(tree_id, person, laws): siblings-in-law with an article who are not in the tree, of members with an article."""
    e = edges.filter((F.col("relation") == "sibling_in_law") & (F.col("confidence") >= T.min_confidence)).select("a", "b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    art = people.filter("fetched").select("id", "gender")
    rows = shown.filter("role = 'member'").select("tree_id", "person").join(art.select(F.col("id").alias("person")), "person", "left_semi")
    rows = rows.join(e.withColumnsRenamed({"a": "person", "b": "law"}), "person").join(art.withColumnRenamed("id", "law"), "law")
    rows = rows.join(shown.select("tree_id", F.col("person").alias("law")), ["tree_id", "law"], "left_anti")
    rows = _link_for(rows, links, "law").withColumn("r", F.row_number().over(Window.partitionBy("tree_id", "person").orderBy("law"))).filter(F.col("r") <= most)
    none = F.lit(None).cast("string")
    line = F.concat_ws(" ", F.concat(_word(IN_LAW_WORD, F.col("gender"), IN_LAW_WORD["m"]), F.lit(":")), person_label(F.col("law"), none, none, none, years=False), "link")
    return rows.groupBy("tree_id", "person").agg(F.array_join(F.sort_array(F.collect_list(F.struct("r", line.alias("l"))))["l"], "; ").alias("laws"))


def box_contents(shown: DataFrame, inline: DataFrame, people: DataFrame, edges: DataFrame, person_trees: DataFrame,
                 anonymous: DataFrame | None = None, hide: bool = True) -> DataFrame:
    """(tree_id, person, role, content): the wikitext of every box.

    ``shown`` may also have extra (names of children in text), truncated, note and has_children. ``anonymous`` (tree_id,
    person) are shown as what they are, not who. ``people`` is (id, name, fetched, gender, born, died: as written).
    """
    links = written(tree_links(person_trees), "links")
    add = {"extra": F.array().cast("array<string>"), "truncated": F.lit(False), "note": F.lit(None).cast("string"), "has_children": F.lit(False)}
    shown = written(shown.withColumns({c: v for c, v in add.items() if c not in shown.columns}), "shown")
    rows = shown.join(people.withColumnRenamed("id", "person").select("person", "name", "fetched", "gender", "born", "died"), "person", "left")
    if anonymous is not None:
        rows = rows.join(anonymous.select("tree_id", "person", F.lit(True).alias("secret")), ["tree_id", "person"], "left")
    else:
        rows = rows.withColumn("secret", F.lit(None).cast("boolean"))
    rows = rows.join(spouse_phrases(inline, people, edges, links, hide), ["tree_id", "person"], "left")
    rows = rows.join(sources(shown, edges), ["tree_id", "person"], "left").join(in_law_lines(shown, people, edges, links), ["tree_id", "person"], "left")
    rows = _link_for(rows, links, "person")
    kin = F.when((F.col("role") == "member") & (F.col("depth") > 0), _word(CHILD_WORD, F.col("gender"))).otherwise(_word(PARENT_WORD, F.col("gender")))
    unnamed = F.when(kin.isNotNull(), F.concat(kin, F.lit(f" ({ANONYMOUS})"))).otherwise(ANONYMOUS)
    label = F.when(F.col("secret"), unnamed).otherwise(person_label(F.col("person"), F.col("name"), F.col("born"), F.col("died")))
    member = F.col("role") == "member"
    line = lambda test, text: F.coalesce(F.when(test, _small(text)), F.lit(""))
    children = F.concat(F.when(F.col("has_children"), MORE_CHILDREN).otherwise(CHILDREN), F.lit(": "), F.array_join("extra", ", "))
    content = F.concat(
        label, line(member & F.col("spouses").isNotNull(), F.col("spouses")), F.coalesce("refs", F.lit("")), line(~member & F.col("link").isNotNull(), F.col("link")),
        line(member & F.col("laws").isNotNull(), F.col("laws")), line(member & (F.size("extra") > 0), children), line(member & F.col("truncated"), F.lit(MORE_BELOW)),
        line(member & F.col("note").isNotNull(), F.col("note")),
    )
    return rows.select("tree_id", "person", "role", content.alias("content"))
