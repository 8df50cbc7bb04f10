"""Charts of ancestors: who stands in which place of the pedigree, and the tiles of its drawing.

Places are numbered as in a heap: the person is 1, the father of n is 2 n, the mother 2 n + 1. All charts are drawn at once:
columns of a generation come from those of the one above by one aggregation, so a chart of g generations takes g of them,
whatever the number of people. A row of the table is a place; there are 2 ** (generations + 1) for a person at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import Thresholds
from kinloom.operators.layout import BOX

T = Thresholds()
PAIR = 9  # fixed value: tiles from one couple of the top row to the next


def with_grandparents(slots: DataFrame, edges: DataFrame, people: DataFrame) -> DataFrame:
    """``slots`` (person, slot, ancestor) with grandparents whose side is known in places that no parent leads to; of
    several, the smallest id. ``edges`` is (a, b, relation, confidence, side)."""
    e = edges.filter((F.col("relation") == "grandparent") & (F.col("confidence") >= T.min_confidence) & F.col("side").isNotNull())
    own = e.select(F.col("a").alias("person"), F.col("b").alias("ancestor"), "side").join(slots.select("person").distinct(), "person", "left_semi")
    own = own.join(people.select(F.col("id").alias("ancestor"), "gender"), "ancestor", "left")
    letter = lambda test: F.when(test, "f").otherwise("m")
    slot = F.concat(letter(F.col("side") == "father"), letter(~(F.coalesce("gender", F.lit("")) == "f")))
    new = own.groupBy("person", slot.alias("slot")).agg(F.min("ancestor").alias("ancestor"))
    return slots.select("person", "slot", "ancestor").unionByName(new.join(slots.select("person", "slot"), ["person", "slot"], "left_anti"))


def heap_place(slot: Column) -> Column:
    """Number of a slot: "" is 1, each f doubles it, each m doubles it and adds one."""
    return F.aggregate(F.filter(F.split(slot, ""), lambda c: c != ""), F.lit(1), lambda n, c: n * 2 + F.when(c == "m", 1).otherwise(0))


def places(slots: DataFrame, generations: int) -> DataFrame:
    """(tree_id, heap, gen, top, ancestor): every place below the highest known generation of each person, which has a row of
    parents at least; ``ancestor`` is null where nobody is known."""
    known = slots.select(F.col("person").alias("tree_id"), heap_place(F.col("slot")).alias("heap"), "ancestor").filter(F.length("slot") <= generations)
    own = known.select("tree_id").distinct().select("tree_id", F.lit(1).alias("heap"), F.col("tree_id").alias("ancestor"))
    known = known.unionByName(own).withColumn("gen", _generation(F.col("heap")))
    tops = known.groupBy("tree_id").agg(F.greatest(F.max("gen"), F.lit(1)).alias("top"))
    grid = tops.select("tree_id", "top", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.col("top") + 1) - 1).cast("int"))).alias("heap"))
    return grid.withColumn("gen", _generation(F.col("heap"))).join(known.select("tree_id", "heap", "ancestor"), ["tree_id", "heap"], "left")


def _generation(heap: Column) -> Column:
    return F.length(F.bin(heap)) - 1


def chart_cells(slots: DataFrame, generations: int) -> DataFrame:
    """(tree_id, row, col, kind, ref, dirs), as ``layout.chart_cells`` has them, of a chart for each person of ``slots``.

    The person is in the lowest row. A couple stands in one row with a line between them, and their child under its middle;
    with one parent known, the child stands right below.
    """
    grid = places(slots, generations)
    leaf = F.col("heap") - F.pow(F.lit(2), F.col("gen")).cast("int")
    at = grid.filter("gen = top").withColumn("col", (F.floor(leaf / 2) * PAIR + 1 + leaf % 2 * (BOX + 1)).cast("int"))
    placed = at.withColumns({c: F.lit(None).cast("int") for c in ("father", "mother")})
    for gen in range(generations - 1, -1, -1):
        father, there = F.col("heap") % 2 == 0, F.col("ancestor").isNotNull()
        end = lambda test, of: F.max(F.when(test, of))
        pair = at.groupBy("tree_id", F.floor(F.col("heap") / 2).cast("int").alias("heap")).agg(
            end(father, F.col("col")).alias("f"), end(~father, F.col("col")).alias("m"), end(father & there, F.col("col")).alias("father"), end(~father & there, F.col("col")).alias("mother"),
        )
        middle = F.floor((F.col("f") + F.col("m")) / 2).cast("int")
        alone = F.when(F.col("father").isNull() != F.col("mother").isNull(), F.coalesce("father", "mother"))
        at = grid.filter(f"gen = {gen} AND gen < top").join(pair, ["tree_id", "heap"]).withColumn("col", F.coalesce(alone, middle)).drop("f", "m")
        placed = placed.unionByName(at.select(placed.columns))
        at = at.unionByName(placed.filter(f"gen = top AND gen = {gen}"))  # charts that begin here
    row = ((F.col("top") - F.col("gen")) * 2).cast("int")
    placed = placed.filter("ancestor IS NOT NULL").withColumn("row", row)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    cells = placed.select("tree_id", "row", "col", F.lit("box").alias("kind"), F.col("ancestor").alias("ref"), empty.alias("dirs"))
    couple = placed.filter("father IS NOT NULL AND mother IS NOT NULL").select(
        "tree_id", (F.col("row") - 2).alias("row"), F.col("col").alias("middle"), F.explode(F.sequence(F.col("father") + 2, F.col("mother") - 2)).alias("col")
    )
    sign = F.col("col") == F.col("middle")
    cells = cells.unionByName(couple.select("tree_id", "row", "col", F.when(sign, "marriage").otherwise("wed").alias("kind"), none.alias("ref"), F.when(sign, empty).otherwise(F.array(F.lit("l"), F.lit("r"))).alias("dirs")))
    down = placed.filter("father IS NOT NULL OR mother IS NOT NULL").select("tree_id", (F.col("row") - 1).alias("row"), "col", F.lit("line").alias("kind"), none.alias("ref"), F.array(F.lit("d"), F.lit("u")).alias("dirs"))
    return cells.unionByName(down)
