"""Sharding by a minimax contiguous partition.

Rows with equal texts are one atomic group. Groups are ordered by a 64-bit hash of their text; the smallest shard
capacity under which a greedy left-to-right filling needs no more than the wanted number of shards is found by
binary search, and the order is cut there. Groups larger than an equal share get shards of their own first, since
no cut can make those smaller, and the others share the remaining shards.

The driver never sees the groups: it sees sums over hash ranges, and refines only the ranges in which a cut can
fall, down to single hashes. Their number follows the square of the shards and the largest range by the mean, not the
input: some ten thousands for 8 shards. Assignment compares a row's hash with at most
``n_shards`` bounds. A hash value shared by different texts makes them one group, which is harmless.

Edge cases: null texts are one group and count no bytes; sizes are UTF-8 bytes plus 1, so nothing is weightless;
an empty table gives an empty result; extra columns are kept by ``assign_shards`` unless they carry the names
that it adds, which it replaces.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import written

FIRST_BITS = 12
#: Hash ranges that one refinement reads to the driver, unless more than half as many hold a possible cut: those are halved.
SUMS = 1 << 17
SLOT_GROUP_ROWS = 20_000


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def group_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("\u0000null")))


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftright(key, 64 - bits)


def _greedy(ends: list[int], capacity: int, k: int) -> list[int] | None:
    """Cut positions of a greedy filling over cumulative sums, or None if k shards are too few."""
    cuts, start, i = [], 0, 0
    total = ends[-1] if ends else 0
    while start < total:
        if len(cuts) == k:
            return None
        j = bisect.bisect_right(ends, start + capacity, lo=i)
        if j == i:
            return None
        cuts.append(j)
        i, start = j, ends[j - 1]
    return cuts


def smallest_capacity(sizes: list[int], k: int) -> tuple[int, list[int]]:
    """Smallest capacity for contiguous sizes, and the end index of each shard that it needs."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    if not ends:
        return 0, []
    lo, hi = max(max(sizes), -(-total // k)), total
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(ends, mid, k) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, _greedy(ends, lo, k)


def plan_shards(groups: DataFrame, n_shards: int) -> tuple[list[int], list[int]]:
    """(keys that get shards of their own, largest key of each shared shard but the last) for (key, size) rows.

    ``groups`` has one row per key, or several that add up.
    """
    totals = groups.agg(F.sum("size")).first()[0] or 0
    alone: list[int] = []
    if totals:
        large = groups.groupBy("key").agg(F.sum("size").alias("size")).filter(F.col("size") * n_shards > totals)
        # at most n_shards - 1 keys can exceed an equal share, unless one holds everything
        rest, left = totals, n_shards
        for key, size in sorted(((r["key"], r["size"]) for r in large.take(n_shards)), key=lambda x: (-x[1], x[0])):
            if left > 1 and size * left > rest:
                alone.append(key)
                rest, left = rest - size, left - 1
    shared = groups.filter(~F.col("key").isin(alone)) if alone else groups
    k = n_shards - len(alone)
    bits = FIRST_BITS
    rows = shared.groupBy(_prefix(F.col("key"), bits).alias("d")).agg(F.sum("size").alias("s")).collect()
    items = sorted((r["d"] << (64 - bits), bits, r["s"]) for r in rows)  # (lowest key, bits, size)
    while bits < 64 and items:
        cut = {items[i][0] >> (64 - bits) for i in _windows([s for _, _, s in items], k) if items[i][1] == bits}
        if not cut:
            break
        finer = min(64, bits + max(1, (SUMS // len(cut)).bit_length() - 1))
        rows = (
            shared.filter(_prefix(F.col("key"), bits).isin(sorted(cut)))
            .groupBy(_prefix(F.col("key"), finer).alias("d"))
            .agg(F.sum("size").alias("s"))
            .collect()
        )
        keep = [x for x in items if x[1] != bits or (x[0] >> (64 - bits)) not in cut]
        items = sorted(keep + [(r["d"] << (64 - finer), finer, r["s"]) for r in rows])
        bits = finer
    if not items:
        return alone, []
    _, ends = smallest_capacity([s for _, _, s in items], k)
    bounds = [items[e - 1][0] + (1 << (64 - items[e - 1][1])) - 1 for e in ends[:-1]]
    return alone, bounds


def _windows(sizes: list[int], k: int) -> list[int]:
    """Indexes of the items that a cut of the finest minimax partition can split.

    The partition that keeps items whole is feasible, so its capacity bounds the smallest one. Under a capacity,
    j shards hold no more than j times it, and the shards after them no more than k - j times it.
    """
    total = sum(sizes)
    high, _ = smallest_capacity(sizes, k)
    ends = list(itertools.accumulate(sizes))
    out: set[int] = set()
    for j in range(1, k):
        a, b = max(0, total - (k - j) * high), min(total, j * high)
        out.update(range(bisect.bisect_left(ends, a), min(len(sizes), bisect.bisect_left(ends, b) + 1)))
    return sorted(out)


def assign_keyed(sized: DataFrame, n_shards: int, order: tuple[str, ...], key: str = "key") -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with ``key`` (named here) and ``size``; rows of one key stay together.

    The narrow columns are written first: planning reads them several times, and the texts only once.
    """
    sized = written(sized, "shard-sizes")
    alone, bounds = plan_shards(sized.select(F.col(key).alias("key"), "size"), n_shards)
    shard = F.lit(len(alone))
    for i, b in enumerate(bounds):
        shard = F.when(F.col(key) > b, len(alone) + i + 1).otherwise(shard)
    for i, k in enumerate(alone):
        shard = F.when(F.col(key) == k, i).otherwise(shard)
    return with_slots(sized.withColumn("shard", shard.cast("int")), (*order, key))


def assign_shards(docs: DataFrame, n_shards: int = 8, text: str = "text", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (0, 1, ... within a shard, in a shuffled order).

    Texts are written with the rows that the numbering deals out.
    """
    docs = docs.drop("size", "shard", "slot")
    sized = docs.withColumns({"size": text_size(docs[text]), "__key": group_key(docs[text])})
    return assign_keyed(sized, n_shards, order, "__key").drop("__key")


def with_slots(placed: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Number the rows of each shard, dealt out by a hash of ``order``, without one task per shard: by hash parts of
    bounded size, then offsets."""
    n = placed.count()
    parts = max(1, -(-n // SLOT_GROUP_ROWS))
    dealt = F.xxhash64(*order)
    placed = placed.withColumns({"__deal": dealt, "__part": F.pmod(dealt, F.lit(parts))})
    counts = placed.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("shard", "__part").orderBy("__deal", *order)
    numbered = placed.withColumn("__row", F.row_number().over(within))
    numbered = numbered.join(offsets, ["shard", "__part"])
    slot = (F.col("__offset") + F.col("__row") - 1).cast("long")
    return numbered.withColumn("slot", slot).drop("__part", "__deal", "__offset", "__row")
