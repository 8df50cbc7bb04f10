"""Command line: each command is a Spark job that reads tables of the work folder and writes others.

    python -m kinloom.cli --work DIR fetch --client module:function --titles FILE
    python -m kinloom.cli --work DIR all
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import text as tx
from kinloom.functions.names import mention_surname, surname_of, year
from kinloom.operators import (
    ancestors,
    boxes,
    canonical,
    consistency,
    coverage,
    existing,
    extraction,
    forest,
    fusion,
    identity,
    incremental,
    inference,
    layout,
    merging,
    model_extraction,
    selection,
    traverse,
    trees,
)
from kinloom.sinks import files, outputs
from kinloom.sources import wiki

ROLES = {"father": ("אב",), "mother": ("אם",), "parents": ("הורים",), "spouse": ("בן זוג", "בת זוג", "בני זוג"), "children": ("ילדים",), "siblings": ("אחים",)}
BORN, DIED = ("תאריך לידה", "לידה"), ("תאריך פטירה", "פטירה")
# Template fields that hold other names of a person.
NICKNAMES = ("כינוי", "כינויים", "שם נוסף", "ידוע גם בשם")
#: What pages are people, unless --rules names a JSON file with the fields of ``canonical.PersonRules``.
RULES = canonical.PersonRules(
    title_never=r"\((?:פירושונים|שם)\)$|^(?:תבנית|קטגוריה|קובץ|פורטל|משתמש):",
    category_yes=r"^(?:אישים|רבנים|רבניות|חסידים|שלוחים|נשים|משפחת |צאצאי )",
    category_no=r"^(?:ספר|ניגון|מוסד|ישיב|בית |בתי )",
    title_weak=r"^(?:יום|שנת|פרשת|ערב) ",
    text_yes=r"(?<![א-ת])(?:נולד|נולדה|בנו של|בתו של)(?![א-ת])",
)


class Work:
    """Tables below a folder. ``save`` replaces a table as a whole: the old one goes only once the new one stands in its
    place, and a run that ends in between finds the old one again."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def load(self, name: str) -> DataFrame:
        self.has(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def load_or(self, name: str, schema: str) -> DataFrame:
        """The table, or one without rows."""
        return self.load(name) if self.has(name) else self.spark.createDataFrame([], schema)

    def has(self, name: str) -> bool:
        at, fs = self._fs(name)
        before = self._fs(f"{name}.old")[0]
        if not fs.exists(at) and fs.exists(before):
            fs.rename(before, at)
        return fs.exists(at)

    def _fs(self, name: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(context._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}.new")
        (new, fs), (at, _), (before, _) = self._fs(f"{name}.new"), self._fs(name), self._fs(f"{name}.old")
        if self.has(name):
            fs.delete(before, True)
            fs.rename(at, before)
        fs.rename(new, at)
        fs.delete(before, True)
        return self.load(name)


def fetch(w: Work, a: argparse.Namespace) -> int:
    """Pages of a list of titles, of a category, or of what changed on the site. Failures of earlier runs are asked for
    again, and those of this run once more after --wait; pages that are there, or that the site does not have, stay unless
    --refresh. 2 if any failed."""
    w.spark.dataSource.register(wiki.WikiList)
    began = datetime.now(timezone.utc).replace(tzinfo=None)
    pages = w.load_or("pages", wiki.PAGE_SCHEMA)
    listing = lambda kind, of: w.spark.read.format("wiki_list").options(client=a.client, list=kind, of=of, ns="0", spacing=a.spacing).load().select("title")
    refresh = a.refresh
    if a.titles:
        wanted = wiki.titles_file(w.spark, a.titles)
    elif a.category:
        wanted = listing("category", a.category)
    else:
        last = w.load("checked").first() if w.has("checked") else None
        oldest = pages.agg(F.min("fetched_at")).first()[0]
        start = incremental.since(last["at"] if last else None, [oldest] if oldest else [])
        if start is None:
            return 0
        wanted = incremental.changed(listing("changes", start.strftime("%Y-%m-%dT%H:%M:%SZ")), pages.select("title"), "title")
        refresh = True
    have = pages.select(F.col("requested_title").alias("title")).unionByName(pages.select("title"))
    failed, missing = w.load_or("failures", "title string, error string"), w.load_or("missing", "title string")
    todo = w.save(incremental.pending(wanted.distinct(), have, failed, missing, "title", refresh), "todo").select("title")
    spacing = float(a.spacing)
    got = w.save(wiki.lookup(todo, a.client, spacing, a.parallel), "fetched")
    again = got.filter("status = 'failed'").select(F.col("requested_title").alias("title"))
    if not again.isEmpty():
        time.sleep(float(a.wait))
        second = w.save(wiki.lookup(again, a.client, spacing, a.parallel), "fetched_again")
        got = w.save(got.filter("status <> 'failed'").unionByName(second), "fetched")
    new = got.filter("status = 'ok'").select(pages.columns).dropDuplicates(["title"])
    w.save(incremental.upsert(pages, new, ["title"]), "pages")
    w.save(missing.select("title").unionByName(got.filter("status = 'missing'").select(F.col("requested_title").alias("title"))).distinct(), "missing")
    left = w.save(got.filter("status = 'failed'").select(F.col("requested_title").alias("title"), "error"), "failures")
    if not (a.titles or a.category):
        w.save(w.spark.createDataFrame([(began,)], "at timestamp"), "checked")
    return 2 if not left.isEmpty() else 0


def extract(w: Work, a: argparse.Namespace) -> int:
    """Relations of pages of people, with the answers of a model if --model names its factory."""
    pages = w.load("pages").select("title", "wikitext", "categories", "requested_title", "redirect_to", "revid")
    rules = RULES
    if a.rules:
        rules = canonical.PersonRules(**json.loads("\n".join(r["value"] for r in w.spark.read.text(a.rules).collect())))  # a file of six fields
    once = pages.dropDuplicates(["title"])
    people = once.filter(canonical.is_person_page(F.col("title"), F.col("categories"), F.col("wikitext"), rules))
    known = w.save(people.select("title"), "persons")
    people = people.join(known, "title", "left_semi")
    texts = once.select(tx.plain(tx.strip_templates(tx.strip_comments(F.coalesce("wikitext", F.lit(""))))).alias("text"))
    lexicon = extraction.lexicon_of(known, texts, a.lexicon)
    if lexicon is not None:
        lexicon = w.save(lexicon, "lexicon")
    nicks = people.select("title", F.explode(tx.templates(tx.strip_comments(F.col("wikitext")))).alias("t")).select("title", F.explode("t.params").alias("field", "value"))
    nicks = nicks.filter(F.col("field").isin(*NICKNAMES)).groupBy("title").agg(F.flatten(F.collect_list(F.split(tx.plain(F.col("value")), r"<br\s*/?>|[,;/]"))).alias("bold"))
    moved = pages.filter("redirect_to IS NOT NULL").groupBy(F.col("redirect_to").alias("title")).agg(F.collect_set("requested_title").alias("redirects"))
    named = known.join(moved, "title", "left").join(nicks, "title", "left")
    index = w.save(identity.unique_alias_index(identity.page_aliases(named)), "aliases")
    found = extraction.extract(people.select("title", "wikitext"), ROLES, lexicon, known if lexicon is not None else None, index)
    if a.model:
        module, _, name = a.model.partition(":")
        cache = w.load("model_cache") if w.has("model_cache") else None
        asked = model_extraction.asked(people.select("title", "revid", "wikitext"), cache)
        answers = w.save(model_extraction.ask(asked, getattr(importlib.import_module(module), name)), "model_answers")
        cache = w.save(model_extraction.updated_cache(cache, answers), "model_cache")
        found = found.unionByName(model_extraction.relations(cache, known))
    w.save(found, "relations")
    w.save(extraction.page_years(people, BORN, DIED), "years")
    return 0


def resolve(w: Work, a: argparse.Namespace) -> int:
    """Ends of relations follow redirects to where these lead; links that no page answers are looked up, if --client is
    given, and ends that are pages of things go."""
    pages, relations = w.load("pages"), w.load("relations")
    moved = pages.filter("redirect_to IS NOT NULL").select(F.col("requested_title").alias("target"), F.col("redirect_to").alias("to"), F.lit(True).alias("exists"))
    resolution = incremental.upsert(w.load_or("resolution", "target string, to string, exists boolean"), moved.dropDuplicates(["target"]), ["target"])
    resolution = w.save(resolution, "resolution")
    if a.client:
        known = pages.select("title").unionByName(pages.select(F.col("requested_title").alias("title")))
        open_links = canonical.unresolved_targets(relations, known, resolution).select(F.col("target").alias("title"))
        told = w.save(wiki.lookup(open_links, a.client, float(a.spacing), a.parallel), "looked_up").filter("status <> 'failed'")
        told = told.select(F.col("requested_title").alias("target"), F.when(F.col("title") != F.col("requested_title"), F.col("title")).alias("to"), (F.col("status") == "ok").alias("exists"))
        resolution = w.save(incremental.upsert(resolution, told, ["target"]), "resolution")
    there = pages.select(F.col("title").alias("target"), F.lit(None).cast("string").alias("to"), F.lit(True).alias("exists")).distinct()
    both = resolution.unionByName(there.join(resolution.select("target"), "target", "left_anti"))
    people = w.load("persons") if w.has("persons") else pages.select("title")
    # a page that is no person's may still be one's by the title that stands before its link
    titled = relations.select(F.explode(F.array("person", "relative")).alias("id"), "evidence").filter("NOT startswith(id, '~') AND contains(evidence, concat('[[', id))")
    before = F.expr("substring_index(evidence, concat('[[', id), 1)")
    gendered = titled.filter(extraction.honorific_gender(before).isNotNull()).select("id").distinct()
    w.save(canonical.canonicalise(relations, both, people, gendered), "resolved")
    return 0


def graph(w: Work, a: argparse.Namespace) -> int:
    relations = identity.anchored_ids(w.load("resolved" if w.has("resolved") else "relations"))
    pages = w.load("pages").select("title", "wikitext", "categories").dropDuplicates(["title"])
    if w.has("persons"):
        pages = pages.join(w.load("persons"), "title", "left_semi")
    text = F.coalesce("wikitext", F.lit(""))
    lead, votes = tx.plain(F.split(text, r"\n==", 2)[0]), extraction.gender_votes(text)
    voted = F.when((votes["m"] >= 2) & (votes["m"] > votes["f"]), "m").when((votes["f"] >= 2) & (votes["f"] > votes["m"]), "f")
    gender = F.coalesce(extraction.gender_of_title(F.col("title"), lead), voted)
    facts = pages.select(F.col("title").alias("id"), tx.display_name(F.col("title")).alias("name"), gender.alias("gender"), "categories")
    bare = relations.withColumns({f"{end}_{k}": F.lit(None).cast("string") for end in ("person", "relative") for k in ("name", "gender")})
    people = merging.upsert_people(facts, bare).join(facts.select("id", "categories"), "id", "left")
    years = w.load("years").select(F.col("title").alias("id"), F.col("born").alias("born_text"), F.col("died").alias("died_text"))
    people = people.join(years, "id", "left").withColumns({
        "born": year(F.col("born_text")), "died": year(F.col("died_text")), "surname": F.when(F.col("id").startswith("~"), mention_surname(F.col("name"))).otherwise(surname_of(F.col("id"))),
        "separated": F.lit(False), "family_categories": F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: c.startswith(selection.FAMILY_PREFIXES[0])),
    })
    people = w.save(people.withColumn("year", F.coalesce("born", "died")).withColumn("linked", ~F.col("id").startswith("~")), "mentioned")
    people, edges = merging.merge_all(people, fusion.fuse_relations(relations))
    people, edges = inference.infer(people, edges)
    edges = consistency.repair(people, edges.withColumn("n_evidence", F.coalesce(F.size("evidence"), F.lit(0))))
    w.save(consistency.flagged_people(people, edges), "people")
    w.save(edges, "edges")
    w.save(identity.families(w.load("people"), w.load("edges")), "families")
    return 0


def existing_trees(w: Work, a: argparse.Namespace) -> int:
    """Trees of the site among the pages of the work folder, and how far they cover the families."""
    pages = w.load("pages").withColumn("uses", F.transform(tx.nested_templates(F.col("wikitext")), lambda t: t["name"]))
    ns = F.when(F.col("title").startswith(boxes.TEMPLATE_SPACE), existing.TEMPLATE).otherwise(0)
    pages = pages.withColumn("ns", ns.cast("int")).dropDuplicates(["title"])
    found = w.save(existing.find_trees(pages, outputs.TREE_CATEGORY, tuple(a.template)), "existing_trees")
    inside = w.save(existing.person_trees(found, existing.tree_contents(found, pages, a.row)), "person_trees")
    if w.has("families"):
        members = w.load("families").select("family", F.col("id").alias("person"))
        trees_ = inside.select(F.col("title").alias("tree"), "person").join(found.select(F.col("title").alias("tree"), "draft"), "tree")
        w.save(coverage.best_coverage(members, trees_), "coverage")
    return 0


def render(w: Work, a: argparse.Namespace) -> int:
    """Trees of all families, or of --family, or below --root; or ancestors (--ancestors-for, --ancestors)."""
    people, edges = w.load("people"), w.load("edges")
    if a.ancestors_for or a.ancestors:
        return pedigrees(w, a, people, edges)
    specs = trees.family_specs(people, w.load("families"))
    labels = w.save(trees.family_labels(people, specs), "labels")
    if a.family:
        labels = labels.filter(F.col("label") == a.family)
    hide = not a.include_unlinked
    members = specs.select("spec", "id").join(labels.select("spec"), "spec", "left_semi")
    # a group that is named after a person is that person's bloodline
    seeds = w.save(selection.label_person(people, members, labels), "label_people")
    blood = trees.bloodlines(people, edges, seeds)
    members = members.join(seeds.select("spec"), "spec", "left_anti").unionByName(blood).distinct()
    members = selection.with_unlinked_relatives(people, edges, members)
    live = edges.filter(F.col("confidence") >= trees.T.min_confidence)
    article = people.filter(~selection.without_article(F.col("id"), F.col("fetched"))).select(F.col("id").alias("node"))
    if hide:
        parents, wed = (live.filter(F.col("relation") == r) for r in ("parent", "spouse"))
        kept = traverse.kept_without_article(parents.select(F.col("a").alias("child"), F.col("b").alias("parent")), wed.select("a", "b"), article)
        seen = w.save(article.unionByName(kept).distinct(), "visible").select(F.col("node").alias("id"))
        members = members.join(seen, "id", "left_semi")
    members = w.save(members.select("spec", "id"), "members")
    wed_in = selection.married_in(people, edges, members, selection.family_surnames(people, members, labels))
    roots = trees.choose_roots(people, edges, members, wed_in).filter(F.col("place") <= trees.T.roots_per_spec)
    roots = roots.filter(F.col("id") == a.root) if a.root else roots
    known = article.select(F.col("node").alias("id"), F.lit(True).alias("named"))
    shown_name = tx.display_name(F.regexp_replace("id", "^~|@.*$", ""))
    called = F.when(F.coalesce("named", F.lit(not hide)), shown_name).otherwise(F.col("place").cast("string"))
    roots = roots.join(known, "id", "left").join(labels, "spec")
    roots = w.save(roots.select(F.concat_ws(" – ", "label", called).alias("tree_id"), "spec", F.col("id").alias("person")), "roots")
    below = forest.families_below(people, edges, trees.owners(people, edges, members, wed_in))
    nodes, marriages = forest.grow_trees(roots, below, people, forest.bare_children(people, edges), forest.budget_of(a.max_nodes), a.max_depth)
    nodes, marriages = w.save(nodes, "nodes"), w.save(marriages, "marriages")
    # trees that only show again who is married into another one
    has = nodes.select("tree_id", F.col("parent_node").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    flagged = nodes.join(has, ["tree_id", "node_id"], "left").join(roots.select("tree_id", "spec", F.col("person").alias("root")), "tree_id")
    flagged = flagged.select("spec", "root", "person", F.coalesce("has_children", F.lit(False)).alias("has_children"), (F.col("depth") == 0).alias("is_root"))
    beside = marriages.join(roots.select("tree_id", "spec", F.col("person").alias("root")), "tree_id").select("spec", "root", "spouse")
    telling = selection.drop_redundant_roots(flagged, beside, people).select("spec", "root").distinct()
    nodes = w.load("nodes").join(roots.join(telling.withColumnRenamed("root", "person"), ["spec", "person"], "left_semi").select("tree_id"), "tree_id", "left_semi")
    split = w.save(forest.split_trees(nodes, marriages, people, a.max_nodes, hide=hide), "split")
    named = people.join(known, "id", "left").select("id", F.coalesce("named", F.lit(not hide)).alias("named"))
    couples = split.select("tree_id", "node_id", "person", "depth", F.posexplode("spouses").alias("marriage", "spouse"))
    couples = couples.join(named.withColumnRenamed("id", "spouse"), "spouse", "left").withColumn("named", F.coalesce("named", F.lit(not hide)))
    couples = w.save(couples, "couples")
    boxed = F.col("named") & (F.col("depth") == 0)  # spouses of roots have boxes; those of others are words in theirs
    cells = w.save(layout.chart_cells(split, couples.filter(boxed).select("tree_id", "node_id", "marriage", "spouse")), "cells")
    none = F.lit(None).cast("string")
    shown = split.select("tree_id", "person", F.lit("member").alias("role"), "depth", none.alias("partner"), F.col("folded").alias("extra"), "note")
    husbands = couples.filter(boxed).select("tree_id", F.col("spouse").alias("person"), F.lit("spouse").alias("role"), "depth", F.col("person").alias("partner"),
                                            F.array().cast("array<string>").alias("extra"), none.alias("note"))
    husbands = husbands.join(split.select("tree_id", "person"), ["tree_id", "person"], "left_anti").dropDuplicates(["tree_id", "person"])
    inline = couples.filter(~boxed).select("tree_id", "person", F.col("marriage").alias("place"), "spouse")
    titles = split.select("tree_id").distinct().withColumns({"title": F.col("tree_id"), "subtitle": F.lit("")})
    told = people.drop("born", "died").withColumnsRenamed({"born_text": "born", "died_text": "died"})
    built = split.select("person", F.concat(F.lit(boxes.TEMPLATE_SPACE), "tree_id").alias("title"))
    inside = w.load_or("person_trees", "person string, title string").select("person", "title")
    w.save(selection.cross_links(built, inside), "cross_links")
    anonymous = split.select("tree_id", "person").join(known.select(F.col("id").alias("person")), "person", "left_anti").distinct() if hide else None
    contents = boxes.box_contents(shown.unionByName(husbands), inline, told, edges, inside.unionByName(built).distinct(), anonymous, hide)
    place = split.groupBy("tree_id", "person").agg(F.min("node_id").alias("place"))
    last = F.lit(2**31 - 1)  # boxes of spouses come after those of members
    contents = w.save(contents.join(place, ["tree_id", "person"], "left").withColumn("place", F.coalesce("place", last)), "contents")
    outputs.write_texts(outputs.previews(cells, contents, titles, a.site), f"{w.folder}/out_previews")
    rows = layout.chart_wikitext(cells, contents, a.start, a.row, a.end)
    page = rows.join(titles, "tree_id").select(
        F.concat(tx.slug(F.col("title")), F.lit(".wiki")).alias("name"),
        outputs.tree_page(F.col("title"), F.col("text"), F.array().cast("array<string>"), F.array().cast("array<string>")).alias("text"),
    )
    outputs.write_texts(page, f"{w.folder}/out_trees")
    if a.files:
        w.spark.dataSource.register(files.TextFiles)
        both = page.unionByName(w.spark.read.schema("name string, text string").json(f"{w.folder}/out_previews"))
        both.write.format("text_files").mode("overwrite").option("path", a.files).save()
    notes = contents.select("tree_id", F.explode(F.regexp_extract_all("content", F.lit(tx.REF), F.lit(0))).alias("ref")).groupBy("tree_id").agg(F.countDistinct("ref").cast("int").alias("n"))
    w.save(selection.tree_records(split.select("tree_id", "person", "depth"), people, layout.chart_size(cells, notes)), "trees_index")
    report(w, split, edges, known, hide)
    return 0


def pedigrees(w: Work, a: argparse.Namespace, people: DataFrame, edges: DataFrame) -> int:
    """The ancestors of --ancestors-for, or of everybody with an article who has enough of them, as a template and as a chart."""
    parent = edges.filter(f"relation = 'parent' AND confidence >= {trees.T.min_confidence}").select(F.col("a").alias("child"), F.col("b").alias("parent"))
    parent = parent.join(people.select(F.col("id").alias("parent"), "gender"), "parent")
    article = people.filter(~selection.without_article(F.col("id"), F.col("fetched"))).select(F.col("id").alias("ancestor"))
    start = w.spark.createDataFrame([(a.ancestors_for,)], "node string") if a.ancestors_for else article.select(F.col("ancestor").alias("node"))
    slots = ancestors.with_grandparents(traverse.ancestor_slots(parent, start, a.generations), edges, people)
    slots = w.save(slots if a.ancestors_for else slots.join(trees.ancestor_subjects(slots), "person", "left_semi"), "ancestors")
    told = slots if a.include_unlinked else slots.join(article, "ancestor", "left_semi")
    params = {r["slot"]: r["slot"] for r in slots.select("slot").distinct().orderBy(F.length("slot"), "slot").collect()}  # 2 ** generations at most
    text = outputs.ahnentafel(told, people, a.template_name, params).select(F.col("person").alias("name"), "text")
    cells = w.save(ancestors.chart_cells(slots, a.generations), "ancestor_cells")
    shown = cells.filter("kind = 'box'").select("tree_id", F.col("ref").alias("person")).distinct()
    shown = shown.join(people.select(F.col("id").alias("person"), "name", "born_text", "died_text"), "person", "left").join(article.select(F.col("ancestor").alias("person"), F.lit(True).alias("named")), "person", "left")
    label = boxes.person_label(F.col("person"), F.col("name"), F.col("born_text"), F.col("died_text"))
    content = F.when(F.col("named") | F.lit(a.include_unlinked), label).otherwise(boxes.ANONYMOUS)
    charts = layout.chart_wikitext(cells, shown.select("tree_id", "person", content.alias("content")), a.start, a.row, a.end)
    text = text.unionByName(charts.select(F.concat("tree_id", F.lit(" (chart)")).alias("name"), "text"))
    outputs.write_texts(text, f"{w.folder}/out_ancestors")
    return 0


def report(w: Work, split: DataFrame, edges: DataFrame, known: DataFrame, hide: bool) -> None:
    """The review of each tree: its edges, and how it compares with trees that exist. With ``hide``, edges of people without
    an article are left out, as their names are in the trees."""
    if hide:
        for end in ("a", "b"):
            edges = edges.join(known.select(F.col("id").alias(end)), end, "left_semi")
    listed = outputs.review_edges(split.select("tree_id", "person"), edges)
    label = F.split("tree_id", " – ")[0]
    rows = split.select("tree_id", F.col("tree_id").alias("title"), label.alias("label")).distinct()
    cover = w.load_or("coverage", "family string, status string, tree string, score double").select("family", "status", "tree", "score")
    cover = cover.join(w.load("labels"), cover["family"] == F.col("spec")).select(F.col("label").alias("family"), "status", "tree", "score").dropDuplicates(["family"])
    texts = outputs.review_report(rows, listed, cover)
    outputs.write_texts(texts.select(F.concat(tx.slug(F.col("tree_id")), F.lit(".html")).alias("name"), "text"), f"{w.folder}/out_review")


def everything(w: Work, a: argparse.Namespace) -> int:
    """fetch (with --client), extract, resolve, graph, existing, render. Trouble with the site, links or existing trees is
    told, and the rest goes on; 2 if pages could not be fetched."""
    status = 0
    for name in (*(("fetch",) if a.client and (a.titles or a.category) else ()), "extract", "resolve", "graph", "existing", "render"):
        try:
            status = max(status, COMMANDS[name](w, a))
        except Exception as e:  # noqa: BLE001
            if name not in ("resolve", "existing"):
                raise
            print(f"{name}: {e}", file=sys.stderr)
    return status


def calibrate(w: Work, a: argparse.Namespace) -> int:
    """The most frequent templates and their parameters, over all pages."""
    t = w.load("pages").select(F.explode(tx.nested_templates(F.col("wikitext"))).alias("t"))
    counted = t.groupBy(F.col("t.name").alias("template")).count().orderBy(F.desc("count"), "template").limit(a.top)
    fields = t.select(F.col("t.name").alias("template"), F.explode(F.map_keys("t.params")).alias("field")).groupBy("template", "field").count()
    w.save(fields.join(F.broadcast(counted.select("template")), "template").orderBy("template", F.desc("count"), "field"), "calibration")
    counted.show(a.top, truncate=False)
    return 0


def upload(w: Work, a: argparse.Namespace) -> int:
    """Out of scope: nothing is ever sent from here. A dry run lists what would be; anything else is refused with 3."""
    if a.yes:
        print("uploads are not part of this engine", file=sys.stderr)
        return 3
    w.load("trees_index").select("tree_id").orderBy("tree_id").show(1000, truncate=False)
    return 0


COMMANDS: dict[str, Callable[[Work, argparse.Namespace], int]] = {
    "fetch": fetch, "extract": extract, "resolve": resolve, "graph": graph, "existing": existing_trees, "render": render, "all": everything,
    "calibrate": calibrate, "upload": upload,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinloom")
    p.add_argument("--work", required=True, help="folder of tables, which all executors reach")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        c = sub.add_parser(name, help=(f.__doc__ or name).split("\n")[0])
        if name in ("fetch", "resolve", "all"):
            c.add_argument("--client", required=name == "fetch", help="module:function that calls the site")
            c.add_argument("--spacing", default="1.0", help="seconds between calls to the site, of all tasks together")
            c.add_argument("--parallel", type=int, default=1)
        if name in ("fetch", "all"):
            c.add_argument("--titles")
            c.add_argument("--category")
            c.add_argument("--refresh", action="store_true")
            c.add_argument("--wait", default="30", help="seconds before failures are tried again")
        if name in ("extract", "all"):
            c.add_argument("--lexicon", type=int, default=extraction.T.strict_lexicon, help="titles that a lexicon of names needs")
            c.add_argument("--rules", help="JSON file of the patterns that tell pages of people")
            c.add_argument("--model", help="module:function that makes the model")
        if name in ("existing", "render", "all"):
            c.add_argument("--template", action="append", default=[])
            c.add_argument("--row", default="עץ משפחה")
        if name in ("render", "all"):
            c.add_argument("--family")
            c.add_argument("--root")
            c.add_argument("--files", help="folder that gets a file for each tree and preview, and their index")
            c.add_argument("--include-unlinked", action="store_true", help="name people without an article")
            c.add_argument("--max-depth", type=int)
            c.add_argument("--max-nodes", type=int, default=trees.T.tree_nodes)
            c.add_argument("--ancestors-for")
            c.add_argument("--ancestors", action="store_true", help="of everybody with enough known ancestors")
            c.add_argument("--generations", type=int, default=4)
            c.add_argument("--template-name", default="אילן יוחסין")
            c.add_argument("--site", default="")
            c.add_argument("--start", default="עץ משפחה/התחלה")
            c.add_argument("--end", default="עץ משפחה/סוף")
        if name == "calibrate":
            c.add_argument("--top", type=int, default=40)
        if name == "upload":
            c.add_argument("--yes", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return COMMANDS[a.command](Work(spark or SparkSession.builder.getOrCreate(), a.work), a)


if __name__ == "__main__":
    sys.exit(main())
