"""Building trees: who stands below whom, within a budget; and splitting trees that are too large or too wide.

Trees grow level by level for all families at once: a level is a join of the last one with the children that its people
own. Each node has a path of marriage and child numbers, so that the order of a walk from the top is the order of paths,
and a budget is a number of rows. Only splitting, which has to draw, works tree by tree, on a few hundred nodes at most.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.functions.names import HONORIFICS
from kinloom.functions.text import normalize_quotes
from kinloom.operators.layout import Node, forest, trees_of
from kinloom.plans.storage import written

T = Thresholds()
LEAST_BUDGET, MOST_NODES = 400, 8
#: Levels that are read apart before they are written as one table.
MOST_LEVELS = 12
NODES = "tree_id string, node_id int, parent_node int, marriage int, child int, person string, depth int"
# How a tree of descendants is titled, and the note where it was cut off.
BRANCH = "{} – צאצאי {}"
NOTE = "[[תבנית:{}|צאצאיו – עץ נפרד]]"


def budget_of(nodes: int = T.tree_nodes) -> int:
    """How many people a tree may have before it is split."""
    return max(nodes * MOST_NODES, LEAST_BUDGET)


def _one_word(name: Column) -> Column:
    return F.size(F.filter(F.split(normalize_quotes(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: (w != "") & ~w.isin(*HONORIFICS))) <= 1


def bare_children(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): unlinked people of one word, without spouse and children. They are text in their parent's box."""
    e = edges.filter(F.col("confidence") >= T.min_confidence)
    busy = e.filter("relation = 'spouse'").select(F.explode(F.array("a", "b")).alias("id")).unionByName(e.filter("relation = 'parent'").select(F.col("b").alias("id")))
    return people.filter(F.col("id").startswith("~") & _one_word(F.col("name"))).select("id").join(busy.distinct(), "id", "left_anti")


def families_below(people: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(spec, owner, child, spouse, marriage, place): the children of each owner, dealt to marriages.

    A child's marriage is the one with another parent of it who is the owner's spouse, else with another parent of
    another gender; else with the only spouse. Marriages come in the order of their first child, children by year.
    ``owners`` is (spec, child, owner), people (id, gender, year).
    """
    e = edges.filter(F.col("confidence") >= T.min_confidence)
    parent = e.filter("relation = 'parent'").select(F.col("a").alias("child"), F.col("b").alias("other")).distinct()
    wed = e.filter("relation = 'spouse'").select("a", "b")
    wed = written(wed.unionByName(wed.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "wed")
    gender = people.select("id", "gender")
    other = owners.join(parent, "child").filter("other <> owner")
    other = other.join(wed.select(F.col("a").alias("owner"), F.col("b").alias("other"), F.lit(True).alias("wed")), ["owner", "other"], "left")
    other = other.join(gender.withColumnsRenamed({"id": "owner", "gender": "g"}), "owner", "left").join(gender.withColumnsRenamed({"id": "other", "gender": "h"}), "other", "left")
    may = F.col("wed").isNotNull() | F.coalesce(F.col("g") != F.col("h"), F.lit(True))
    chosen = other.filter(may).groupBy("spec", "child").agg(F.min(F.struct(F.col("wed").isNull().alias("later"), "other")).alias("c"))
    only = wed.groupBy(F.col("a").alias("owner")).agg(F.min("b").alias("only"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    kids = owners.join(chosen, ["spec", "child"], "left").join(only, "owner", "left")
    kids = kids.join(people.select(F.col("id").alias("child"), "year"), "child", "left").withColumn("spouse", F.coalesce("c.other", "only"))
    kids = written(kids.select("spec", "owner", "child", "spouse", "year"), "kids")
    key = F.struct(F.col("year").isNull().alias("late"), "year", "child")
    first = kids.groupBy("spec", "owner", "spouse").agg(F.min(key).alias("first"))
    childless = owners.select("spec", "owner").distinct().join(wed.withColumnRenamed("a", "owner"), "owner").select("spec", "owner", F.col("b").alias("spouse"))
    childless = childless.join(first.select("spec", "owner", "spouse"), ["spec", "owner", "spouse"], "left_anti").withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    order = Window.partitionBy("spec", "owner").orderBy(F.col("spouse").isNull(), F.col("first").isNull(), "first", "spouse")
    numbered = first.unionByName(childless).withColumn("marriage", F.row_number().over(order) - 1).drop("first")
    place = F.row_number().over(Window.partitionBy("spec", "owner", "spouse").orderBy(key)) - 1
    same = ["spec", "owner"]
    placed = kids.withColumn("place", place).withColumnRenamed("spouse", "__s")
    out = numbered.join(placed, (numbered["spec"] == placed["spec"]) & (numbered["owner"] == placed["owner"]) & numbered["spouse"].eqNullSafe(placed["__s"]), "left")
    return out.select(*[numbered[c] for c in same], "child", "spouse", "marriage", F.coalesce("place", F.lit(0)).alias("place"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def grow_trees(roots: DataFrame, below: DataFrame, people: DataFrame, bare: DataFrame, budget: int, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, marriages) of trees from ``roots`` (tree_id, spec, person) over ``below`` (see ``families_below``).

    nodes: NODES and extra (names of bare children), truncated. Within the budget come first those that are reached by
    linked people alone, as a walk from the top meets them; then unlinked children and what is below them, by depth.
    """
    kids = below.filter("child IS NOT NULL")
    text = kids.join(bare.withColumnRenamed("id", "child"), "child", "left_semi").join(people.select(F.col("id").alias("child"), "name"), "child", "left")
    extra = text.groupBy("spec", F.col("owner").alias("person")).agg(F.sort_array(F.collect_list(F.struct("marriage", "place", "name")))["name"].alias("extra"))
    kids = written(kids.join(bare.withColumnRenamed("id", "child"), "child", "left_anti"), "kids")
    level = roots.select("tree_id", "spec", "person", F.array().cast("array<int>").alias("path"), F.lit(None).cast("array<int>").alias("up"), F.lit(None).cast("int").alias("marriage"),
                         F.lit(None).cast("int").alias("child"), F.lit(0).alias("depth"), F.lit(False).alias("late"))
    level = written(level, "level")
    levels, cut = [level], None
    order = Window.partitionBy("tree_id").orderBy("late", F.when(F.col("late"), F.col("depth")).otherwise(0), "path")
    while max_depth is None or level.first() is not None:
        every = _together(levels)
        seen = every.select("tree_id", "person")
        # more people only push others back, so whoever is beyond the budget now stays there, with all below
        full = every.groupBy("tree_id").count().filter(F.col("count") > budget).select("tree_id")
        beyond = every.join(full, "tree_id", "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") > budget)
        level = level.join(beyond.select("tree_id", "path"), ["tree_id", "path"], "left_anti")
        step = level.select("tree_id", "spec", F.col("person").alias("owner"), F.col("path").alias("up"), "depth", "late").join(kids, ["spec", "owner"])
        step = step.select(
            "tree_id", "spec", F.col("child").alias("person"), F.concat("up", F.array(F.col("marriage").cast("int"), F.col("place").cast("int"))).alias("path"),
            "up", "marriage", F.col("place").alias("child"), (F.col("depth") + 1).alias("depth"), (F.col("late") | F.col("child").startswith("~")).alias("late"),
        ).join(seen, ["tree_id", "person"], "left_anti")
        if max_depth is not None and int(level.agg(F.max("depth")).first()[0] or 0) >= max_depth:
            cut = step.select("tree_id", F.col("up").alias("path")).distinct()
            break
        level = written(step, "level")
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) > MOST_LEVELS:
            levels = [written(_together(levels), "level")]
    ranked = written(_together(levels).withColumn("rank", F.row_number().over(order)), "ranked")
    kept = ranked.filter(F.col("rank") <= budget)
    lost = ranked.filter(F.col("rank") > budget).select("tree_id", F.col("up").alias("path")).distinct()
    lost = (lost if cut is None else lost.unionByName(cut)).distinct().withColumn("truncated", F.lit(True))
    number = F.row_number().over(Window.partitionBy("tree_id").orderBy("path")) - 1
    kept = written(kept.withColumn("node_id", number), "kept")
    up = kept.select("tree_id", F.col("path").alias("up"), F.col("node_id").alias("parent_node"))
    nodes = kept.join(up, ["tree_id", "up"], "left").join(lost, ["tree_id", "path"], "left").join(extra, ["spec", "person"], "left")
    nodes = nodes.select("tree_id", "node_id", "parent_node", "marriage", "child", "person", "depth", F.coalesce("extra", F.array().cast("array<string>")).alias("extra"),
                         F.coalesce("truncated", F.lit(False)).alias("truncated"))
    wed = below.filter("spouse IS NOT NULL").select("spec", F.col("owner").alias("person"), "marriage", "spouse").distinct()
    marriages = kept.select("tree_id", "spec", "person", "node_id").join(wed, ["spec", "person"]).select("tree_id", "node_id", "marriage", "spouse")
    return nodes, marriages


@dataclass
class Piece:
    """One tree of those that a tree is split into: where it was cut from, notes and text in people's boxes."""

    title: str
    roots: list[Node]
    origin: str | None = None
    notes: dict[str, str] = field(default_factory=dict)
    folded: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class _Spot:
    """A node of a piece, its size with all below, and the list that it stands in."""

    node: Node
    size: int
    beside: list[Node]
    parent: Node | None


def _spots(roots: list[Node]) -> list[_Spot]:
    """All nodes from the top down; sizes are summed on the way back up."""
    out = [_Spot(r, 1, roots, None) for r in roots]
    for spot in out:  # grows while it is read
        out += [_Spot(kid, 1, kids, spot.node) for _, kids in spot.node.marriages for kid in kids]
    place = {id(s.node): s for s in out}
    for spot in reversed(out):
        if spot.parent is not None:
            place[id(spot.parent)].size += spot.size
    return out


def _width(roots: list[Node]) -> int:
    return forest(copy.deepcopy(roots)).width  # drawing changes its nodes


def _branch(piece: Piece, spots: list[_Spot], may_head: Callable[[str], bool], least: int) -> _Spot | None:
    """What leaves a piece next: a root beside the largest one, or else a branch that leaves enough behind; the largest."""
    tops = spots[: len(piece.roots)]
    total, main = sum(t.size for t in tops), max(tops, key=lambda t: t.size)
    large = [s for s in spots if s.size > least and may_head(s.node.person)]
    others = [s for s in large if s.parent is None and s is not main]
    inner = [s for s in large if s.node.depth and s.parent is not None and total - s.size >= least + 1]
    return max(others or inner, key=lambda s: s.size, default=None)


def split_tree(title: str, roots: list[Node], name: Callable[[str], str], may_head: Callable[[str], bool], most: int = T.tree_nodes, widest: int = T.tree_width, least: int = T.branch_size) -> list[Piece]:
    """The pieces of a tree. A piece that has too many people or is too wide loses, again and again, a whole root or a
    branch of more than ``least`` people (see ``_branch``), which becomes a piece of its own and leaves a note if it was a
    branch; where there is none, the deepest of its unlinked people without children become text in their parents' boxes."""
    times: Counter[str] = Counter()

    def titled(of: Piece, person: str) -> str:
        base = BRANCH.format(of.title.split(" – ")[0], name(person))
        times[base] += 1
        return base if times[base] == 1 else f"{base} ({times[base]})"

    pieces = [Piece(title, roots)]
    for piece in pieces:  # grows while it is read
        while True:
            spots = _spots(piece.roots)
            if len(spots) <= most and _width(piece.roots) <= widest:
                break
            cut = _branch(piece, spots, may_head, least)
            if cut is not None:
                head = cut.node
                if cut.parent is None:
                    piece.roots = [r for r in piece.roots if r is not head]
                    fresh = Piece(titled(piece, head.person), [head], piece.title)
                else:
                    fresh = Piece(titled(piece, head.person), [Node(head.person, 0, head.marriages)], piece.title)
                    piece.notes[head.person] = NOTE.format(fresh.title)
                    for spot in _spots(fresh.roots)[1:]:
                        spot.node.depth -= head.depth
                    head.marriages = [(spouse, []) for spouse, _ in head.marriages]
                pieces.append(fresh)
                continue
            loose = [s for s in spots if s.parent is not None and s.size == 1 and s.node.person.startswith("~")]
            if not loose:
                break
            deepest = max(s.node.depth for s in loose)
            for s in (s for s in loose if s.node.depth == deepest):
                piece.folded.setdefault(s.parent.person, []).append(s.node.person)
                s.beside[:] = [kid for kid in s.beside if kid is not s.node]
    return pieces


def split_trees(nodes: DataFrame, marriages: DataFrame, people: DataFrame, most: int = T.tree_nodes, widest: int = T.tree_width, least: int = T.branch_size, hide: bool = False) -> DataFrame:
    """NODES of the trees after splitting, with origin (the tree it was cut from), note, folded (children put into text)
    and spouses (by marriage). ``people`` is (id, name) and, for ``hide``, fetched: then nobody without an article gives a
    tree its title. A tree's people are a few hundred, and go to its task with it."""
    bare = ~F.coalesce(F.col("fetched"), F.lit(False)) if hide else F.lit(False)
    named = nodes.join(people.select(F.col("id").alias("person"), "name", bare.alias("bare")), "person", "left")
    schema = f"{NODES}, origin string, note string, folded array<string>, spouses array<string>"

    def one(key, mine: pd.DataFrame, wed: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        if mine.empty:
            return pd.DataFrame(columns=columns)
        names = dict(zip(mine["person"], mine["name"], strict=True))
        shown = lambda p: names.get(p) or p.split("@", 1)[0].lstrip("~")
        secret = set(mine["person"][mine["bare"].fillna(hide).astype(bool)])
        head = lambda p: p not in secret and (not p.startswith("~") or len([w for w in shown(p).split() if w not in HONORIFICS]) > 1)
        rows = []
        for piece in split_tree(key[0], trees_of(mine, wed), shown, head, most, widest, least):
            n = 0
            todo = [(r, None, None, None) for r in piece.roots]
            while todo:
                x, up, m, c = todo.pop(0)
                text = [shown(p) for p in piece.folded.get(x.person, [])]
                rows.append((piece.title, n, up, m, c, x.person, x.depth, piece.origin, piece.notes.get(x.person), text, [s for s, _ in x.marriages if s]))
                todo += [(k, n, i, j) for i, (_, kids) in enumerate(x.marriages) for j, k in enumerate(kids)]
                n += 1
        return pd.DataFrame(rows, columns=columns).astype({"parent_node": "Int32", "marriage": "Int32", "child": "Int32"})

    return named.groupBy("tree_id").cogroup(marriages.groupBy("tree_id")).applyInPandas(one, schema)
