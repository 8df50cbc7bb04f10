"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule draws the golden-ratio point frac(i * phi), in 64-bit fixed point, and takes the source in whose
cumulative-weight interval the point falls. Slots are ranked per source. Each source's documents are shuffled by a keyed
hash, once for each pass over the source, laid end to end as one stream of tokens and cut into blocks of equal tokens;
the r-th slot of a source takes its r-th block. The stream ends at the source's target, so that the last block may be
short. Slots give the order of the mix, and every stretch of it holds the sources by their weights.

Ranks and stream positions are prefix sums in two levels (inside parts of bounded size, then over the parts), so no
task sees a whole source.

Edge cases: null text has no tokens and is never drawn; a null source is a source of its own; empty tables and
tables without tokens give an empty schedule; rows repeated in full are laid out one after the other, each with its
own tokens; columns beyond doc_id, text and source, whatever their names, are carried by ``documents_of_mix`` alone;
more than MOST_SOURCES sources are refused, since weights are named on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm.common import word_count, words, written

#: 2 ** 64 / golden ratio, odd: slot times this, modulo 2 ** 64, is the slot's point.
GOLDEN = 0x9E3779B97F4A7C15
BLOCK_TOKENS = 2048
PART_ROWS = 4096
#: Blocks that one task writes of the mix.
PART_BLOCKS = 2048
SHARE = 1.5
MOST_PASSES = 2
MOST_SOURCES = 100_000
#: Rows (five numbers each) that are sent to every task at most.
BROADCAST_ROWS = 500_000


def targets(sizes: list[float], weights: list[float], total: float, most: float = MOST_PASSES) -> list[float]:
    """Share ``total`` by weight; none gets more than ``most`` times its size, the excess is shared by weight again.

    Sources fill up in the order of size by weight, so one pass over them in that order tells which ones are full.
    """
    out = [0.0] * len(sizes)
    left, w = float(total), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    for at, i in enumerate(order):
        if left * weights[i] / w < most * sizes[i]:
            for k in order[at:]:
                out[k] = left * weights[k] / w
            break
        out[i] = float(most * sizes[i])
        left, w = left - out[i], w - weights[i]
    return out


def cycle_weights(sources: list, pattern: tuple[float, ...] = (3, 1, 2)) -> dict:
    """Weights by code point order of the source names, null last, repeating the pattern."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s])
    ordered += [None] if None in sources else []
    return {s: pattern[i % len(pattern)] for i, s in enumerate(ordered)}


def source_plan(
    sized: DataFrame,
    weights: Callable[[list], dict] = cycle_weights,
    share: float = SHARE,
    most: float = MOST_PASSES,
) -> DataFrame:
    """One row per source: source, source_size, docs, target, source_no."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    by = weights([r["source"] for r in rows])
    ordered = sorted(rows, key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    t = targets([r["s"] for r in ordered], [by[r["source"]] for r in ordered], share * sum(r["s"] for r in ordered), most)
    out = [(r["source"], r["s"], r["n"], float(x), i) for i, (r, x) in enumerate(zip(ordered, t, strict=True))]
    return spark.createDataFrame(out, "source string, source_size long, docs long, target double, source_no int")


def blocks_of(plan: DataFrame, block: int) -> list[tuple[int, int]]:
    """(source_no, blocks up to its target) of the sources that have any."""
    rows = [(r["source_no"], math.ceil(round(r["target"]) / block)) for r in plan.orderBy("source_no").collect()]
    return [r for r in rows if r[1]]


def schedule(spark: SparkSession, plan: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source_no, rank): the source of each slot, and how many slots of that source came before.

    A source's weight is the number of blocks up to its target. The gaps between n golden-ratio points are below 1.9 / n,
    so three points for each block reach every source as often as it has blocks, the smallest too. Slots that come after
    the last block of their source, nearly all of them in the last two thirds, take nothing and are left out.
    """
    rows = blocks_of(plan, block)
    total = sum(n for _, n in rows)
    if not total:
        return spark.createDataFrame([], "slot long, source_no int, rank long")
    numbers, needed = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    before = 0
    ends = []
    for _, n in rows[:-1]:
        before += n
        ends.append((before << 64) // total)
    bounds = np.array(ends, np.uint64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(GOLDEN)
            source = numbers[np.searchsorted(bounds, points, side="right")].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(source)], ["slot", "source_no"])

    drawn = spark.range(3 * total + 64).mapInArrow(draw, "slot long, source_no int")
    drawn = written(drawn.withColumn("part", F.floor(F.col("slot") / PART_ROWS)), "mix-slots")
    earlier = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        drawn.groupBy("source_no", "part").agg(F.count(F.lit(1)).alias("n"))
        .select("source_no", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("source_no", "part").orderBy("slot")
    ranked = drawn.withColumn("r", F.row_number().over(within)).join(offsets, ["source_no", "part"]).select(
        "slot", "source_no", (F.col("offset") + F.col("r") - 1).alias("rank")
    )
    most = spark.createDataFrame([(int(n), int(b)) for n, b in zip(numbers, needed, strict=True)], "source_no int, blocks long")
    return ranked.join(F.broadcast(most), "source_no").filter("rank < blocks").drop("blocks")


def streams(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents with tokens, once for each pass that the target needs, with start and end in the source's stream.

    Adds pass, start, end. ``sized`` has doc_id, source, size and whatever the caller needs.
    """
    p = F.broadcast(plan)
    own = sized.filter("size > 0").join(p, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    passes = F.ceil(F.col("target") / F.col("source_size"))
    laid = own.withColumn("pass", F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))))
    deal = F.xxhash64(F.lit(seed), "pass", "doc_id", "size")
    parts = F.greatest(F.lit(1), F.ceil(F.col("docs") / PART_ROWS))
    laid = laid.withColumns({"deal": deal, "part": F.pmod(F.hash("doc_id", "pass", F.lit(seed)), parts)})
    before = Window.partitionBy("source_no").orderBy("pass", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy("source_no", "pass", "part").agg(F.sum("size").alias("n"))
        .select("source_no", "pass", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("source_no", "pass", "part").orderBy("deal", "doc_id", "size")
    end = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = laid.withColumn("end", end).join(offsets, ["source_no", "pass", "part"])
    placed = placed.withColumn("end", F.col("offset") + F.col("end")).withColumn("start", F.col("end") - F.col("size"))
    return placed.drop("deal", "part", "offset")


def blocks(streamed: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document and block that it has tokens in: adds rank, from_token, tokens; cut at the target."""
    stop = F.least("end", F.round("target").cast("long"))
    inside = streamed.withColumn("stop", stop).filter("start < stop")
    each = inside.withColumn(
        "rank",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))),
    )
    low, high = F.greatest("start", F.col("rank") * block), F.least("stop", (F.col("rank") + 1) * block)
    return each.withColumns({"from_token": low - F.col("start"), "tokens": high - low}).drop("stop")


def mix(docs: DataFrame, seed: int = 17, block: int = BLOCK_TOKENS, share: float = SHARE,
        weights: Callable[[list], dict] = cycle_weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, plan, taken). ``taken`` has one row per fragment in the mix: slot, rank, doc_id, source, size, start, end,
    pass, from_token, tokens; ordering it by slot, start gives the mix."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    plan = source_plan(sized, weights, share)
    cut = blocks(streams(sized, plan, seed), block)
    return sized, plan, cut.join(schedule(docs.sparkSession, plan, block), ["source_no", "rank"])


def taken_words(docs: DataFrame, seed: int = 17, block: int = BLOCK_TOKENS, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, size, source_size, target, the words that the mix takes, repeats counted, and the first slot
    that takes any (null if none).

    Rows repeated in full get what each of them gives, in the order of their places in the stream.
    """
    sized, plan, fragments = mix(docs, seed, block, share)
    per_place = fragments.groupBy("doc_id", "source_no", "size", "pass", "start").agg(F.sum("tokens").alias("t"), F.min("slot").alias("slot"))
    copy = Window.partitionBy("source_no", "pass", "doc_id", "size").orderBy("start")
    per_row = (
        per_place.withColumn("copy", F.row_number().over(copy))
        .groupBy("doc_id", "source_no", "size", "copy").agg(F.sum("t").alias("taken"), F.min("slot").alias("first_slot"))
    )
    own = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source_no", "size").orderBy(F.lit(1))))
    same = [own[c].eqNullSafe(per_row[c]) for c in ("doc_id", "source_no", "size", "copy")]
    on = same[0] & same[1] & same[2] & same[3]
    return own.join(per_row, on, "left").select(
        own["doc_id"], own["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


def documents_of_mix(docs: DataFrame, seed: int = 17, block: int = BLOCK_TOKENS) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each pass in which words of a document are taken.

    Rows come in the order of the mix: of the first slot that takes words of theirs, then of their place in its block.
    Where the target ends inside a document, its text is cut after the words taken, and n_chars, if there is one, is
    counted again.
    """
    _, plan, fragments = mix(docs.select("doc_id", "source", "text"), seed, block)
    per_pass = fragments.groupBy("doc_id", "source", "size", "pass", "start").agg(F.sum("tokens").alias("__t"), F.min("slot").alias("__slot"))
    copy = Window.partitionBy("doc_id", "source", "size", "pass").orderBy("start")
    keys = ("doc_id", "source", "size", "copy")
    taken = per_pass.withColumn("copy", F.row_number().over(copy)).select(*[F.col(k).alias(f"__{k}") for k in keys], "__t", "__slot", F.col("start").alias("__start"))
    taken = written(taken, "mix-taken")

    # only rows that share doc_id, source and size are numbered, so that no others are moved for it
    sized = docs.select(*[F.col(c).alias(f"_{c}") for c in docs.columns], F.col("doc_id").alias("__id"), F.col("source").alias("__from"),
                        word_count(F.col("text")).alias("__words"))
    several = taken.filter("__copy = 2").select("__doc_id", "__source", "__size").distinct()
    several = written(several, "mix-several")
    mine = sized["__id"].eqNullSafe(several["__doc_id"]) & sized["__from"].eqNullSafe(several["__source"]) & (sized["__words"] == several["__size"])
    many = sized.join(_small(several), mine, "left_semi")
    order = Window.partitionBy("__id", "__from", "__words").orderBy(F.xxhash64("_text"))
    many = many.withColumn("__n", F.row_number().over(order))
    one = sized.join(_small(several), mine, "left_anti").withColumn("__n", F.lit(1))

    def met(rows: DataFrame) -> DataFrame:
        on = rows["__id"].eqNullSafe(taken["__doc_id"]) & rows["__from"].eqNullSafe(taken["__source"])
        return rows.join(_small(taken), on & (rows["__words"] == taken["__size"]) & (rows["__n"] == taken["__copy"]))

    total = sum(n for _, n in blocks_of(plan, block))
    parts = max(1, -(-total // PART_BLOCKS))
    joined = met(one).unionByName(met(many))
    joined = joined.repartitionById(parts, F.least(F.floor(F.col("__slot") * parts / max(1, total)), F.lit(parts - 1)).cast("int"))
    joined = joined.sortWithinPartitions("__slot", "__start")
    text = F.array_join(F.slice(words(F.col("_text")), F.lit(1), F.col("__t").cast("int")), " ")
    text = F.when(F.col("__t") < F.col("__words"), text).otherwise(F.col("_text"))
    fresh = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[fresh.get(c, F.col(f"_{c}")).alias(c) for c in docs.columns])


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked to be sent to every task if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
