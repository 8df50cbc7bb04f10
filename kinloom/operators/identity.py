"""Entity resolution: anchored ids, alias index, slots, matching inside slots, remapping, families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.functions.names import alias_key, names_match, names_may_match
from kinloom.functions.text import display_name
from kinloom.operators.fusion import canonical_ends
from kinloom.operators.graph import connected_components
from kinloom.plans.storage import written


def unique_alias_index(aliases: DataFrame) -> DataFrame:
    """(alias, title, kind): aliases that stand for one title only; kind nick beats name. Input (alias, title, kind)."""
    n = aliases.filter(F.length("alias") >= 3).groupBy("alias").agg(
        F.max("title").alias("other"), F.min("title").alias("title"), F.max("kind").alias("kind")
    )
    return n.filter("title = other").drop("other")


def page_aliases(pages: DataFrame) -> DataFrame:
    """(alias, title, kind) of (title, redirects, bold): the shown name and its form without titles as names; other
    titles that lead to the page, additions in parentheses after a name, and bold words of its lead as nicks."""
    title = F.col("title")
    names = F.array(display_name(title), alias_key(display_name(title)))
    nicks = F.concat(F.coalesce("redirects", F.array().cast("array<string>")), F.coalesce("bold", F.array().cast("array<string>")))
    kinds = F.concat(F.transform(names, lambda a: F.struct(a.alias("alias"), F.lit("name").alias("kind"))), F.transform(nicks, lambda a: F.struct(a.alias("alias"), F.lit("nick").alias("kind"))))
    rows = pages.select("title", F.explode(kinds).alias("k")).select(F.trim("k.alias").alias("alias"), "title", "k.kind")
    return rows.filter(F.length("alias") >= 3).distinct()


def resolve_aliases(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """``mentions`` (name, in_prose, ...) with title and alias: the page that an unlinked name stands for, if one does.
    Names, unlike nicks, count in running text alone. ``index`` is ``unique_alias_index``: one row an alias."""
    key = mentions.withColumn("__k", alias_key(F.col("name")))
    found = None
    for c, at in (("name", "__t0"), ("__k", "__t1")):
        hit = index.select(F.col("alias").alias(c), F.col("title").alias(at), F.col("kind").alias(f"{at}_kind"))
        key = key.join(hit, c, "left")
        ok = F.when((F.col(f"{at}_kind") == "nick") | F.col("in_prose"), F.col(at))
        found = ok if found is None else F.coalesce(found, ok)
    return key.withColumn("title", found).withColumn("alias", F.col("title").isNotNull()).drop("__k", "__t0", "__t1", "__t0_kind", "__t1_kind")


def anchored_ids(relations: DataFrame) -> DataFrame:
    """Relations whose unlinked ends (``~name``) carry an anchor and a role, so that namesakes stay apart.

    The anchor is the other end if it is linked, else the page; the role is child or parent on parent edges, else the
    relation. One unlinked name in one sentence of a page is one person: parent rows come first and give the id. The
    person end always shares it, the relative end only if its name stands once in the sentence.
    """
    linked = lambda c: ~F.col(c).startswith("~")
    anchor = F.when(linked("relative"), F.col("relative")).when(linked("person"), F.col("person")).otherwise(F.col("source_page"))
    role = lambda end: F.when(F.col("relation") == "parent", "child" if end == "person" else "parent").otherwise(F.col("relation"))
    own = lambda end: F.concat(F.col(end), F.lit("@"), anchor, F.lit(":"), role(end))
    times = (F.length("evidence") - F.length(F.replace("evidence", F.substring("relative", F.lit(2), F.length("relative")), F.lit("")))) / F.greatest(F.length("relative") - 1, F.lit(1))
    rows = relations.withColumn("__row", F.monotonically_increasing_id())
    ends = []
    for n, (end, shares) in enumerate((("person", F.lit(True)), ("relative", times == 1))):
        ends.append(rows.filter(~linked(end)).select(
            "__row", F.lit(end).alias("end"), F.col(end).alias("name"), "source_page", "evidence", own(end).alias("id"), shares.alias("shares"),
            F.struct((F.col("relation") != "parent").alias("later"), "order", F.lit(n).alias("side"), "method", "relation", "person", "relative").alias("at"),
        ))
    every = ends[0].unionByName(ends[1])
    first = every.filter("shares").groupBy("source_page", "evidence", "name").agg(F.min(F.struct("at", "id")).alias("f"))
    first = first.select("source_page", "evidence", "name", F.col("f.id").alias("shared"))
    fixed = every.join(first, ["source_page", "evidence", "name"], "left")
    fixed = fixed.withColumn("id", F.when(F.col("shares"), F.coalesce("shared", "id")).otherwise(F.col("id")))
    by_row = fixed.groupBy("__row").agg(F.max(F.when(F.col("end") == "person", F.col("id"))).alias("p"), F.max(F.when(F.col("end") == "relative", F.col("id"))).alias("r"))
    out = rows.join(by_row, "__row", "left")
    return out.withColumns({"person": F.coalesce("p", "person"), "relative": F.coalesce("r", "relative")}).drop("p", "r", "__row")


def slots(edges: DataFrame) -> DataFrame:
    """(id, kind, other): the places of people in families, with those that follow from co-parents and siblings."""
    e = edges.select("a", "b", "relation")
    row = lambda rel, i, kind, o: e.filter(F.col("relation") == rel).select(F.col(i).alias("id"), F.lit(kind).alias("kind"), F.col(o).alias("other"))
    direct = [row("parent", "a", "child_of", "b"), row("parent", "b", "parent_of", "a")]
    direct += [row(r, i, r, o) for r in ("spouse", "sibling") for i, o in (("a", "b"), ("b", "a"))]
    parents = e.filter("relation = 'parent'").select(F.col("a").alias("child"), F.col("b").alias("parent"))
    co = parents.join(parents.withColumnRenamed("parent", "p2"), "child").filter("parent <> p2")
    co = co.select(F.col("parent").alias("id"), F.lit("spouse").alias("kind"), F.col("p2").alias("other"))
    sib = direct[4].unionByName(direct[5]).join(parents.withColumnRenamed("child", "other"), "other")
    sib = sib.select("id", F.lit("child_of").alias("kind"), F.col("parent").alias("other"))
    out = direct[0]
    for d in (*direct[1:], co, sib):
        out = out.unionByName(d)
    return out.distinct()


def block_pairs(rows: DataFrame, block: list[str], node: str, match: Column) -> DataFrame:
    """(u, v): rows of one block that match; ``match`` may use columns of ``x`` and ``y``. Only equal blocks are joined."""
    x, y = rows.alias("x"), rows.alias("y")
    on = F.col(f"x.{node}") < F.col(f"y.{node}")
    for c in block:
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return x.join(y, on & match).select(F.col(f"x.{node}").alias("u"), F.col(f"y.{node}").alias("v")).distinct()


def near_pairs(rows: DataFrame, block: list[str], node: str, text: str) -> DataFrame:
    """(u, v): rows of one block whose texts differ in one character at most. Two such texts have a form in common that
    lacks one character, or one is such a form of the other; so rows meet on those forms, not each with each."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    forms = F.array_distinct(F.concat(F.array(text), F.transform(at, lambda k: F.concat(F.substr(text, F.lit(1), k - 1), F.substr(text, k + 1)))))
    each = rows.select(*block, node, text, F.explode(forms).alias("__form"))
    x, y = each.alias("x"), each.alias("y")
    on = (F.col("x.__form") == F.col("y.__form")) & (F.col(f"x.{node}") < F.col(f"y.{node}"))
    for c in block:
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    close = F.levenshtein(F.col(f"x.{text}"), F.col(f"y.{text}"), 1).between(0, 1)
    return x.join(y, on & close).select(F.col(f"x.{node}").alias("u"), F.col(f"y.{node}").alias("v")).distinct()


def matching_in_slots(placed: DataFrame, year_window: int, match: Callable[[Column, Column], Column] = names_match) -> DataFrame:
    """(u, v, bare): rows of one slot, the first unlinked, whose names match and whose births, if known, are within the
    window; of two unlinked ones the smaller id comes first. ``placed`` is (id, name, born, slot, bare).

    Names are compared, not rows: each two names of a slot once, whatever the number of rows that have them, and then the
    rows meet on names that match. No names come to a comparison in Python that cannot match: ``names_may_match`` bounds
    the similarity from above.
    """
    bare = placed.filter("bare")
    own, other = bare.select("slot", "name").distinct().alias("x"), placed.select("slot", "name").distinct().alias("y")
    first, second = F.col("x.name"), F.col("y.name")
    alike = own.join(other, (F.col("x.slot") == F.col("y.slot")) & names_may_match(first, second)).filter(match(first, second))
    alike = alike.select(F.col("x.slot").alias("slot"), first.alias("own"), second.alias("other"))
    x = bare.select("slot", F.col("name").alias("own"), F.col("id").alias("u"), F.col("born").alias("born_u")).join(alike, ["slot", "own"]).alias("x")
    y = placed.select("slot", F.col("name").alias("other"), F.col("id").alias("v"), F.col("born").alias("born_v"), "bare").alias("y")
    near = F.coalesce(F.abs(F.col("born_u") - F.col("born_v")) <= year_window, F.lit(True))
    on = (F.col("x.slot") == F.col("y.slot")) & (F.col("x.other") == F.col("y.other")) & (F.col("u") != F.col("v")) & (~F.col("bare") | (F.col("u") < F.col("v"))) & near
    return x.join(y, on).select("u", "v", "bare").distinct()


def merge_in_slots(people: DataFrame, edges: DataFrame, year_window: int = 40, births: DataFrame | None = None) -> DataFrame:
    """(old, new): unlinked people to be replaced. ``people`` is (id, name, born: year or null); ``births`` (id, estimate)
    stands in for years that are not known.

    Within a slot, unlinked people with matching names and births within the window are one. A group that matches one
    person with an article becomes that person, else its longest name (most words, longest, shortest id).
    """
    known = people.select("id", "name", "born")
    if births is not None:
        known = known.join(births.select("id", "estimate"), "id", "left").select("id", "name", F.coalesce("born", "estimate").alias("born"))
    placed = slots(edges).join(known, "id")
    key = F.concat_ws("\u0001", "kind", "other")
    placed = written(placed.withColumn("slot", key).withColumn("bare", F.col("id").startswith("~")), "slots")
    pairs = written(matching_in_slots(placed, year_window), "slots")
    groups = connected_components(pairs.filter("bare").select("u", "v"), written)
    known = pairs.filter("NOT bare").select(F.col("u").alias("node"), "v")
    members = people.filter(F.col("id").startswith("~")).select(F.col("id").alias("node"), "name").join(groups, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    size = F.struct(F.size(F.split("name", r"\s+")).alias("w"), F.length("name").alias("n"), (-F.length("node")).alias("s"), "node")
    best = members.groupBy("component").agg(F.max(size).alias("best"))
    article = members.join(known, "node").groupBy("component").agg(F.countDistinct("v").alias("n"), F.min("v").alias("v")).filter("n = 1")
    chosen = best.join(article, "component", "left").select("component", F.coalesce("v", "best.node").alias("new"))
    return members.join(chosen, "component").filter("node <> new").select(F.col("node").alias("old"), "new")


def remap(rows: DataFrame, mapping: DataFrame, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``rows`` with both ends replaced by ``mapping`` (old, new), once; loops go, symmetric ends are ordered anew."""
    for end in ends:
        m = mapping.select(F.col("old").alias(end), F.col("new").alias("__new"))
        rows = rows.join(m, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return canonical_ends(rows, *ends).filter(F.col(ends[0]) != F.col(ends[1]))


def top_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, the smallest on a tie; nulls don't count."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key).agg(F.max("n").alias("n"))
    return n.join(best, [key, "n"]).groupBy(key, "n").agg(F.min(value).alias(value)).select(key, value, "n")


def families(people: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(family, id): components of two people at least over parent and spouse edges; families are numbered by articles,
    then size, then their smallest member. ``people`` is (id, fetched)."""
    solid = edges.filter(F.col("relation").isin("parent", "spouse") & (F.col("confidence") >= least))
    parts = written(connected_components(solid.select(F.col("a").alias("u"), F.col("b").alias("v")), written), "families")
    size = parts.join(people.select(F.col("id").alias("node"), "fetched"), "node", "left").groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.coalesce(F.col("fetched").cast("int"), F.lit(0))).alias("articles")
    ).filter("size >= 2")
    # numbers go through all families: sorted in ranges, counted in each, and on from what the ranges before have
    order = [F.desc("articles"), F.desc("size"), F.col("component")]
    ranged = written(size.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "families")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row a range
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    named = ranged.withColumn("at", within).join(F.broadcast(starts), "range").withColumn("family", F.concat(F.lit("F"), (F.col("start") + F.col("at")).cast("string")))
    return parts.join(named, "component").select("family", F.col("node").alias("id"), "size", "articles")


def _descends(children: DataFrame, depth: int) -> DataFrame:
    """(top, node): who descends from whom within ``depth`` generations. ``children`` is (parent, child)."""
    level = written(children.select(F.col("parent").alias("top"), F.col("child").alias("node")).distinct(), "descends")
    every = level
    step = children.select(F.col("parent").alias("node"), F.col("child").alias("next"))
    for _ in range(depth - 1):
        level = level.join(step, "node").select("top", F.col("next").alias("node")).distinct().join(every, ["top", "node"], "left_anti")
        level = written(level, "descends")
        if level.isEmpty():
            break
        every = written(every.unionByName(level), "descends")
    return every


def conflicting_mentions(people: DataFrame, edges: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(article, page): pages whose mentions of an article must mean a namesake.

    ``people`` is (id, fetched, gender, born, died); ``edges`` has evidence (array of structs with source_page, alias).
    A parent edge conflicts if the parent descends from the child; if the article as parent is too young for the child or
    a grandchild, or died before; if the article as child is too old for the parent, or is a child by alias only and
    another father is certain. Siblings conflict if their births are too far apart. What an article's own page says counts.
    """
    e = edges.filter("relation IN ('parent', 'sibling') AND NOT inferred").select("a", "b", "relation", F.coalesce("alias_only", F.lit(False)).alias("weak"), F.array_distinct("evidence.source_page").alias("pages"))
    years = lambda end: people.select(F.col("id").alias(end), F.col("fetched").alias(f"fetched_{end}"), F.col("gender").alias(f"gender_{end}"), F.col("born").alias(f"born_{end}"), F.col("died").alias(f"died_{end}"))
    e = written(e.join(years("a"), "a", "left").join(years("b"), "b", "left"), "namesakes")
    p = e.filter("relation = 'parent'")
    below = _descends(p.filter("NOT weak").select(F.col("b").alias("parent"), F.col("a").alias("child")), t.descendant_depth)
    loops = p.join(below.select(F.col("top").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_semi").select("a", "b").withColumn("loop", F.lit(True))
    first = p.groupBy(F.col("b").alias("a")).agg(F.min("born_a").alias("first_child"))
    fathers = p.filter("NOT weak AND gender_b = 'm'").groupBy("a").agg(F.collect_set("b").alias("fathers"))  # a handful each
    judged = p.join(loops.distinct(), ["a", "b"], "left").join(first, "a", "left").join(fathers, "a", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    loop, young = yes(F.col("loop")), yes(F.col("born_a") < F.col("born_b") + t.parent_gap)
    as_parent = loop | young | yes(F.col("first_child") < F.col("born_b") + t.grandparent_gap) | yes(F.col("born_a") > F.col("died_b") + t.posthumous)
    other = yes(F.exists("fathers", lambda f: f != F.col("b")))
    as_child = loop | young | (F.col("weak") & yes(F.col("gender_b") == "m") & other)
    far = yes(F.abs(F.col("born_a") - F.col("born_b")) > t.sibling_gap)
    sides = [judged.filter(as_parent).select(F.col("b").alias("article"), "pages", F.col("fetched_b").alias("f")),
             judged.filter(as_child).select(F.col("a").alias("article"), "pages", F.col("fetched_a").alias("f"))]
    sides += [e.filter(F.col("relation") == "sibling").filter(far).select(F.col(x).alias("article"), "pages", F.col(f"fetched_{x}").alias("f")) for x in ("a", "b")]
    bad = sides[0]
    for s in sides[1:]:
        bad = bad.unionByName(s)
    own = F.col("pages") == F.array("article")
    return bad.filter(~F.col("article").startswith("~") & yes(F.col("f")) & ~own).select("article", F.explode("pages").alias("page")).distinct()


def separate_namesakes(people: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, edges): edges with evidence of a conflicting mention move to a person without an article, ``~name@page:alias``.

    Of several pages the smallest names the person; the first end is moved, if both conflict.
    """
    bad = written(conflicting_mentions(people, edges).filter("article <> page"), "namesakes")
    keyed = edges.filter("NOT inferred").select("a", "b", "relation", F.explode(F.array_distinct("evidence.source_page")).alias("page"))
    hit = None
    for place, end in enumerate(("a", "b")):
        h = keyed.join(bad.withColumnRenamed("article", end), [end, "page"], "left_semi").select("a", "b", "relation", F.struct(F.lit(place).alias("place"), "page").alias("h"))
        hit = h if hit is None else hit.unionByName(h)
    hit = written(hit.groupBy("a", "b", "relation").agg(F.min("h").alias("h")), "namesakes")
    moved = edges.join(hit, ["a", "b", "relation"], "left")
    article = F.when(F.col("h.place") == 0, F.col("a")).when(F.col("h.place") == 1, F.col("b"))
    moved = moved.withColumn("__new", F.concat(F.lit("~"), display_name(article), F.lit("@"), F.col("h.page"), F.lit(":alias")))
    new = moved.filter("h IS NOT NULL").select(F.col("__new").alias("id"), display_name(article).alias("name"), article.alias("of")).distinct()
    new = new.join(people.select(F.col("id").alias("of"), "gender"), "of", "left").groupBy("id", "name").agg(F.min("gender").alias("gender"))
    people = people.unionByName(new.withColumn("fetched", F.lit(False)).join(people.select("id"), "id", "left_anti"), allowMissingColumns=True)
    calm = F.transform("evidence", lambda v: v.withField("alias", F.lit(False)))
    changed = moved.withColumns({
        "a": F.when(F.col("h.place") == 0, F.col("__new")).otherwise(F.col("a")), "b": F.when(F.col("h.place") == 1, F.col("__new")).otherwise(F.col("b")),
        "evidence": F.when(F.col("h").isNotNull(), calm).otherwise(F.col("evidence")),
        "alias_only": F.when(F.col("h").isNotNull(), False).otherwise(F.col("alias_only")),
    }).drop("h", "__new")
    return people, written(canonical_ends(changed), "namesakes")
