"""Jaccard join on word n-grams by T-occurrence search.

Two texts of a and b distinct shingles are linked when they share T = ceil(s * (a + b) / (1 + s)) of them at least.
In the inverted index of all texts, a partner of a text therefore occurs in T of the text's lists. As in DivideSkip, a
text's lists are divided: the short ones (its rarest shingles, one more than it may miss) give the candidates, by an
equi-join on shingles, and the long ones are only probed for those.

1. Corpus counts of shingles, in a sketch of fixed size that covers every text, order shingles from rare to frequent.
   The order only has to be the same everywhere; errors of the sketch cost time, not links.
2. Texts with equal sets are one class from here on. Each class lists its rarest shingles (the prefix).
3. Lists with one class are dropped, and each class learns how many shingles it can still share from a list on.
4. Short lists give candidates. First the pivots of each list are paired with all its other classes, and links are
   joined to components. In lists that are in several components then, every class is paired with one of another
   component. Only then are all classes of different components paired that share a list and can still reach T. So large
   groups of near copies cost as many pairs as they have members, and their outliers more.
5. T-occurrence search: candidates of one query class meet in groups of bounded size. The query's lists over them are
   divided, a heap merges the short ones and counts occurrences, the long ones are searched by bisection for what is
   left, and candidates with T occurrences are linked.

Edge cases: null texts and texts without words have empty sets and link with nothing; a text with fewer words than n
has its whole sequence as one shingle; equal ids and repeated rows share what their texts get; classes without a
non-null id link with nothing; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.tokens import free_memory, shingle_sets, slices
from kinloom.operators.graph import connected_components
from kinloom.plans.storage import Scratch

SKETCH_BITS = 18
SKETCH_PARTS = 32
#: Bits of the bitmap of a set for each of its shingles, up to the next power of two. It travels once for each pair that
#: may be a link, and halved once with the entries of lists of LONG_LIST classes or more that are compared across components.
BITMAP_BITS = 6
LONG_LIST = 64
#: Pivots of a list, each of which is paired with all classes that come after it.
PIVOTS = 2
HOT_RANK = 1_000_000
#: A list may be hot if its hash range holds HOT_FACTOR times the mean. Rows of classes of HOT_COPIES rows or more are
#: joined with their class where they lie.
HOT_FACTOR = 8
HOT_COPIES = 128
QUERY_GROUP = 512
GROUP_SHINGLES = 1 << 19
#: Cost of a step of the merge against one of the search in a long list, for the choice of the number of long lists.
LONG_COST = 0.0085
#: Ids that are sent to every task at most (8 bytes each); beyond that, texts are joined with them.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Options:
    """Texts are linked when ``similar_of`` * intersection >= ``similar`` * union, over shingles of ``width`` words."""

    width: int = 5
    similar: int = 80
    similar_of: int = 100


def needed(a, b, o: Options):
    """T for set sizes a and b, in integers."""
    return -(-(o.similar * (a + b)) // (o.similar + o.similar_of))


def prefix_length(n, o: Options):
    return n - -(-(o.similar * n) // o.similar_of) + 1


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch):
            yield part, shingle_sets(part.column("text"), width)
    free_memory()


def shingle_sketch(docs: DataFrame, o: Options) -> np.ndarray:
    """How often shingles of each hash range occur, over all texts."""
    size, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, sets in _batches(batches, o.width):
            if flat := [s for s in sets if len(s)]:
                total += np.bincount((np.concatenate(flat) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        if total.any():
            rows = [total[k * part : (k + 1) * part].astype(np.int32).tobytes() for k in range(SKETCH_PARTS)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(SKETCH_PARTS), pa.int32()), "counts": pa.array(rows, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int32 if len(c) == 4 * part else np.int64).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    schema = "part int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(SKETCH_PARTS, "part").mapInArrow(add, schema).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["part"] * part : (r["part"] + 1) * part] += np.frombuffer(r["counts"], np.int64)
    return out


def frequency_levels(sketch: np.ndarray) -> np.ndarray:
    """0 for hash ranges with no more than chance puts there, then one level for each doubling of the excess."""
    mean = sketch.mean()
    over = (sketch - mean) / (3 * np.sqrt(mean) + 1)
    return np.maximum(0, np.floor(np.log2(np.maximum(1, over)))).astype(np.uint8)


def hot_level(sketch: np.ndarray) -> int:
    """Level from which a hash range holds so many shingles that a single list may be too long for one task."""
    mean = float(sketch.mean())
    return max(3, int(np.log2(max(2.0, (HOT_FACTOR - 1) * mean / (3 * np.sqrt(mean) + 1)))))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each of 2 ** k remainders of the shingles, k by their number, as 64-bit words."""
    size = max(64, 1 << (BITMAP_BITS * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def signatures(docs: DataFrame, levels: np.ndarray, hot: int, o: Options) -> DataFrame:
    """Per text: doc_id, n (shingles), class (digest of the set), prefix (its rarest shingles, in the common order),
    cold (how many of them are below level ``hot``), last (where the prefix ends in that order, level and leading bits
    of the hash) and bits (bitmap of the set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(batches, o.width):
            ns, classes, prefixes, cold, last, bits = [], [], [], [], [], []
            for s in sets:
                n = len(s)
                ns.append(n)
                if not n:
                    classes.append(None)
                    prefixes.append(np.zeros(0, np.int64))
                    cold.append(0)
                    last.append(0)
                    bits.append(np.zeros(0, np.int64))
                    continue
                with np.errstate(over="ignore"):
                    a, b = s.sum(dtype=np.uint64), (s * s * np.uint64(0x9E3779B97F4A7C15) + (s >> np.uint64(7))).sum(dtype=np.uint64)
                classes.append(int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little") + n.to_bytes(4, "little"))
                level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.argsort(level, kind="stable")[: prefix_length(n, o)]
                prefixes.append(s[first].view(np.int64))
                cold.append(int(np.count_nonzero(level[first] < hot)))
                last.append(int(level[first[-1]]) << 25 | int(s[first[-1]]) >> 39)
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ns, pa.int32()), pa.array(classes, pa.binary()), _lists(prefixes), pa.array(cold, pa.int32()),
                 pa.array(last, pa.int32()), _lists(bits)],
                ["doc_id", "n", "class", "prefix", "cold", "last", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n int, class binary, prefix array<bigint>, cold int, last int, bits array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def small(df: DataFrame) -> DataFrame:
    """``df``, which must be cheap to count, marked to be sent to every task if it has BROADCAST_IDS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def representatives(signed: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``signed`` whose id stands for their class; those of one class and id are alike."""
    ids = signed.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "class")
    copies = ids.join(reps.select(F.col("rep").alias("doc_id"), "class"), ["doc_id", "class"], "left_anti")
    copies = scratch.write(copies.distinct(), "ngram-copies")
    return signed.filter("n > 0 AND doc_id IS NOT NULL").join(small(copies), ["doc_id", "class"], "left_anti")


def shared_lists(own: DataFrame, o: Options) -> DataFrame:
    """The inverted lists that several classes are in: token, rep, n, last, classes (in the list), rank (in the list, by
    rep), left, rest.

    ``left`` and ``rest`` bound how many shingles the class can share with another, if this list is the first that both
    are in: ``left`` are all its shingles from this one on; ``rest`` are those behind its prefix, and its shared lists
    from this one on. ``rest`` holds only if the other's prefix ends no earlier, since a shingle of this prefix can be
    behind one that does.

    Lists that the sketch calls hot are counted with a partial aggregate, and joined with their counts, which can be
    split over tasks; all others are counted where they meet.
    """
    columns = ["token", "rep", "pos", "classes", "rank"]

    def exploded(first: Column, many: Column) -> DataFrame:
        part = F.slice("prefix", first + 1, many)
        each = own.select(F.col("doc_id").alias("rep"), first.alias("first"), F.posexplode(part).alias("at", "token"))
        return each.select("token", "rep", (F.col("first") + F.col("at")).alias("pos"))

    by_token = Window.partitionBy("token")
    cold = exploded(F.lit(0), F.col("cold")).withColumns(
        {"classes": F.count(F.lit(1)).over(by_token), "rank": F.dense_rank().over(by_token.orderBy("rep")),
         "several": F.min("rep").over(by_token) < F.max("rep").over(by_token)}
    )
    hot = exploded(F.col("cold"), F.size("prefix") - F.col("cold"))
    counted = hot.groupBy("token").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("classes"))
    hot = hot.join(counted.filter("low < high"), "token").withColumn("rank", F.when(F.col("rep") == F.col("low"), 1).otherwise(HOT_RANK))
    kept = cold.filter("several").select(columns).unionByName(hot.select(columns)).distinct()

    # sizes come in now, where most entries are gone; an id that stands for several texts gets bounds that hold for all
    facts = own.groupBy(F.col("doc_id").alias("rep")).agg(
        F.min("n").alias("n"), F.max("n").alias("most"), F.max("last").alias("last"), (F.min("class") < F.max("class")).alias("mixed")
    )
    kept = kept.join(facts, "rep")
    by_rep = Window.partitionBy("rep")
    behind = F.floor((F.lit(o.similar) * F.col("most") + o.similar_of - 1) / o.similar_of) - 1  # n - prefix length
    later = F.count(F.lit(1)).over(by_rep.orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, 0))
    left, rest = (F.col("most") - F.col("pos")).alias("left"), F.when(F.col("mixed"), F.lit(2**30)).otherwise(behind + later).cast("int").alias("rest")
    last = F.when(F.col("mixed"), -1).otherwise(F.col("last")).alias("last")
    return kept.select("token", "rep", "n", last, "classes", "rank", left, rest)


def _reach(x: str, y: str, o: Options) -> Column:
    """Whether the classes x and y of one list can share as many shingles as a link needs."""
    both, den = F.col(f"{x}.n") + F.col(f"{y}.n"), o.similar + o.similar_of
    rest = F.when(F.col(f"{x}.last") < F.col(f"{y}.last"), F.col(f"{x}.rest")).when(F.col(f"{x}.last") > F.col(f"{y}.last"), F.col(f"{y}.rest"))
    rest = F.coalesce(rest, F.greatest(f"{x}.rest", f"{y}.rest"))  # ``last`` may be equal where the ends are not
    return F.least(f"{x}.left", f"{y}.left", rest) * den >= both * o.similar


def _pair(x: str, y: str) -> list[Column]:
    """a and b of a pair; which of them is the query doesn't depend on the list."""
    earlier = F.xxhash64(f"{x}.rep") < F.xxhash64(f"{y}.rep")
    return [F.when(earlier, F.col(f"{p}.rep")).otherwise(F.col(f"{q}.rep")).alias(n) for n, p, q in (("a", x, y), ("b", y, x))]


def star_pairs(lists: DataFrame, o: Options) -> DataFrame:
    """(a, b): the pivots of each list, which have the smallest ranks, with all classes after them. Similar lists have the
    same pivots, so that classes have few pairs. In hot lists one class has rank 1, and no other comes before the rest."""
    x, y = lists.filter(F.col("rank") <= PIVOTS).alias("x"), lists.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.rank") < F.col("y.rank")) & (F.col("x.rep") != F.col("y.rep")) & _reach("x", "y", o))
    return met.select(*_pair("x", "y")).distinct()


def still_open(lists: DataFrame) -> DataFrame:
    """The lists without their pivots, which have been paired with all others, if more than one class is left."""
    return lists.filter((F.col("rank") > PIVOTS) & (F.col("classes") > F.when(F.col("rank") == HOT_RANK, 2).otherwise(PIVOTS + 1)))


def across_components(lists: DataFrame, components: DataFrame) -> DataFrame:
    """The lists that are in several components, with component."""
    at = lists.drop("component").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    at = at.withColumn("component", F.coalesce("component", "rep"))
    both = at.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return at.join(both.select("token"), "token", "left_semi")


def scattered_pairs(lists: DataFrame, o: Options) -> DataFrame:
    """(a, b): each class of a list with one class of it that is in another component. Each list has its own pivot, by a
    hash of token and rep, so that classes which share many lists meet many others."""
    entry = F.struct(F.xxhash64("token", "rep").alias("h"), "rep", "n", "last", "left", "rest", "component")
    pivots = lists.groupBy("token").agg(F.min(entry).alias("p")).select("token", "p.*").alias("x")
    y = lists.alias("y")
    met = pivots.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & _reach("x", "y", o))
    return met.select(*_pair("x", "y")).distinct()


def cross_pairs(lists: DataFrame, bitmaps: DataFrame, o: Options) -> DataFrame:
    """(a, b): classes of one list that are in different components. ``lists`` has component, ``bitmaps`` is (rep, bits).

    In each list the classes outside its most frequent component are compared with all others, so that lists of large
    groups cost their outliers times their length.
    """
    frequent = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    main = frequent.groupBy("token").agg(F.max(F.struct("k", "component")).alias("m")).select("token", F.col("m.component").alias("main"))
    bits = F.when(F.size("bits") > 1, _halved(F.col("bits"))).otherwise(F.col("bits"))
    placed = lists.join(main, "token").withColumn("h", F.xxhash64("rep"))
    long = placed.filter(F.col("classes") >= LONG_LIST).join(bitmaps.select("rep", bits.alias("bits")), "rep", "left")
    short = placed.filter(F.col("classes") < LONG_LIST).withColumn("bits", F.lit(None).cast("array<bigint>"))
    placed = long.select(short.columns).unionByName(short)
    x, y = placed.filter("component <> main").alias("x"), placed.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.h") < F.col("y.h"))
    apart = (F.col("x.component") != F.col("y.component")) & once
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & apart & _reach("x", "y", o) & _alike("x", "y", o))
    return met.select(*_pair("x", "y")).distinct()


def _halved(bits: Column) -> Column:
    """The bitmap of half as many remainders."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda u, v: u.bitwiseOR(v))


def _alike(x: str, y: str, o: Options) -> Column:
    """Whether the bitmaps of x and y allow a link; true where there is none. A bit that only one set has stands for at
    least one shingle that the other lacks. Sets that can be linked have bitmaps of one size, or one is twice as large."""
    den, both = o.similar + o.similar_of, o.similar * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    p, q = F.col(f"{x}.bits"), F.col(f"{y}.bits")
    p, q = F.when(F.size(p) > F.size(q), _halved(p)).otherwise(p), F.when(F.size(q) > F.size(p), _halved(q)).otherwise(q)

    def lacking(u: Column, v: Column, n: str) -> Column:
        only = F.zip_with(u, v, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j))))
        return F.aggregate(only, F.lit(0), lambda acc, k: acc + F.coalesce(k, F.lit(0))) * den <= F.col(f"{n}.n") * den - both

    return F.coalesce(lacking(p, q, x) & lacking(q, p, y), F.lit(True))


def alike_pairs(pairs: DataFrame, bitmaps: DataFrame, o: Options) -> DataFrame:
    """The pairs (a, b) whose whole bitmaps (rep, n, bits) allow a link."""
    x, y = bitmaps.withColumnRenamed("rep", "a").alias("x"), bitmaps.withColumnRenamed("rep", "b").alias("y")
    return pairs.join(x, "a").join(y, "b").filter(_alike("x", "y", o)).select("a", "b")


def bitmap_table(own: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, n, bits of the classes in ``ids``. Where one id stands for different texts bits is null, so that pairs with it
    are made and verified."""
    own = own.select(F.col("doc_id").alias("rep"), "n", "bits").join(small(ids), "rep", "left_semi")
    both = own.groupBy("rep").agg(F.min("n").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high"))
    return both.select("rep", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("bits"))


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Occurrences of what is in ``least`` of the sorted lists or more. A heap merges the lists; where its smallest value
    has too few, lists are moved on by bisection to the next value that may have enough."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out: dict[int, int] = {}
    while len(heap) >= least:
        value, taken = heap[0][0], []
        while heap and heap[0][0] == value:
            taken.append(heapq.heappop(heap))
        if len(taken) >= least:
            out[value] = len(taken)
            goal = value + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, k, at in taken:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return out


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], thresholds: np.ndarray) -> np.ndarray:
    """Which candidates hold ``thresholds`` of the query's elements at least; arrays are sorted and distinct.

    The query's elements have inverted lists over the candidates. The longest lists are set aside, as many as pay; the
    short ones are merged, and what has so few occurrences that all long lists could not make up for it is dropped; each
    long list is searched for the remaining candidates.
    """
    out = np.zeros(len(candidates), bool)
    if not candidates:
        return out
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    flat = np.concatenate(candidates)
    at = np.searchsorted(query, flat)
    hit = at < len(query)
    hit[hit] = query[at[hit]] == flat[hit]
    order = np.argsort(at[hit], kind="stable")
    at, owner = at[hit][order], owner[hit][order]  # lists of the query's elements, each sorted by candidate
    ends = np.searchsorted(at, np.arange(len(query) + 1)).tolist()
    entries = owner.tolist()
    lists = sorted((entries[a:b] for a, b in zip(ends, ends[1:]) if b > a), key=len)
    fewest = int(thresholds.min())
    if len(lists) < fewest:
        return out
    n_long = min(fewest - 1, int(fewest / (LONG_COST * math.log2(len(lists[-1])) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    limits = thresholds.tolist()
    for candidate, count in merge_skip(short, fewest - n_long).items():
        need = limits[candidate]
        for done, entry in enumerate(long):
            if count + n_long - done < need:
                break
            p = bisect_left(entry, candidate)
            count += p < len(entry) and entry[p] == candidate
        out[candidate] = count >= need
    return out


def set_table(docs: DataFrame, reps: DataFrame, o: Options) -> DataFrame:
    """rep, shingles (sorted, packed) of the classes in ``reps``, which must be cheap to count."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(batches, o.width):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    texts = docs.select("doc_id", "text").join(small(reps.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    return texts.mapInArrow(pack, "rep bigint, shingles binary")


def verified(pairs: DataFrame, docs: DataFrame, o: Options, scratch: Scratch) -> DataFrame:
    """(u, v): the pairs (a, b) that are links. ``a`` is the query; its candidates meet in groups of QUERY_GROUP or so,
    of which GROUP_SHINGLES are searched at once."""
    ids = scratch.write(ends(pairs), "ngram-ids")
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / QUERY_GROUP).alias("groups"))
    dealt = pairs.join(fan, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("groups").cast("int")))
    dealt = scratch.write(dealt.select("a", "salt", "b"), "ngram-pairs")
    own = dealt.select("a", "salt", F.lit(None).cast("bigint").alias("b"), F.col("a").alias("rep")).distinct()
    rows = own.unionByName(dealt.select("a", "salt", "b", F.col("b").alias("rep"))).join(set_table(docs, ids, o), "rep")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, ids, found, held = None, [], [], [], 0

        def links() -> Iterator[pa.RecordBatch]:
            for query in queries if found else []:  # several, if one id stands for several texts
                t = np.array([needed(len(query), len(c), o) for c in found], np.int64)
                ok = np.flatnonzero(divide_skip(query, found, t))
                yield pa.RecordBatch.from_pydict({"u": pa.array([at[0]] * len(ok), pa.int64()), "v": pa.array([ids[i] for i in ok], pa.int64())})

        for batch in batches:
            bodies = batch.column("shingles")
            for k, (a, salt, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), strict=True)):
                if (a, salt) != at or held > GROUP_SHINGLES:
                    yield from links()
                    ids, found, held = [], [], 0
                if (a, salt) != at:
                    at, queries = (a, salt), []
                body = np.frombuffer(bodies[k].as_buffer(), np.uint64).copy()
                if b is None:
                    queries.append(body)
                else:
                    ids.append(b)
                    found.append(body)
                    held += len(body)
        yield from links()
        free_memory()

    return rows.select("a", "salt", "b", "shingles").mapInArrow(check, "u bigint, v bigint")


def ends(pairs: DataFrame) -> DataFrame:
    """(rep): the classes in ``pairs``. Each side is made distinct first, where queries repeat."""
    return pairs.select(F.col("a").alias("rep")).distinct().unionByName(pairs.select(F.col("b").alias("rep")).distinct()).distinct()


def near_classes(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """Per row of ``docs`` (doc_id bigint, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that links reach from the document, itself included.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = shingle_sketch(docs, o)
    signed = scratch.write(signatures(docs, frequency_levels(sketch), hot_level(sketch), o), "ngram-signatures")
    classes = signed.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.write(classes, "ngram-classes")
    rows = scratch.write(signed.select("doc_id", "n", "class"), "ngram-rows")
    own = representatives(signed, reps.filter("rep IS NOT NULL"), scratch)
    lists = scratch.write(shared_lists(own, o), "ngram-shared")
    own = scratch.write(own.select("doc_id", "n", "bits"), "ngram-bitmaps")
    scratch.drop_all_but(reps, rows, lists, own)

    def edge_components(edges: DataFrame) -> DataFrame:
        return scratch.write(connected_components(edges, lambda df: scratch.write(df, "ngram-edges"), scratch.drop), "ngram-components")

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among pairs that may be."""
        pairs = scratch.write(pairs, "ngram-pairs")
        ids = scratch.write(ends(pairs), "ngram-ids")
        likely = scratch.write(alike_pairs(pairs, bitmap_table(own, ids), o), "ngram-likely")
        links = scratch.write(verified(likely, docs, o, scratch), "ngram-links")
        scratch.drop(pairs, ids, likely)
        return links

    links = linked(star_pairs(lists, o))
    mixed = scratch.write(across_components(still_open(lists), edge_components(links)), "ngram-mixed")
    links = links.unionByName(linked(scattered_pairs(mixed, o)))
    mixed = scratch.write(across_components(mixed, edge_components(links)), "ngram-mixed")
    ids = scratch.write(mixed.filter(F.col("classes") >= LONG_LIST).select("rep").distinct(), "ngram-ids")
    components = edge_components(links.unionByName(linked(cross_pairs(mixed, bitmap_table(own, ids), o))))
    scratch.drop_all_but(reps, rows, components)

    table = reps.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    table = table.select("class", "copies", F.coalesce("component", "rep").alias("component_id"))
    table = scratch.write(table, "ngram-placed")
    hot = F.broadcast(table.filter(F.col("copies") >= HOT_COPIES).select("class", F.col("component_id").alias("c")))
    few = table.filter(F.col("copies") >= HOT_COPIES).limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    if few:  # rows of large classes get theirs where they lie, and no task gets a whole class
        rows = rows.join(hot, "class", "left")
        rest = rows.filter("c IS NULL").drop("c").join(table.select("class", "component_id"), "class", "left")
        out = rest.select("doc_id", "n", "component_id").unionByName(rows.filter("c IS NOT NULL").select("doc_id", "n", F.col("c").alias("component_id")))
    else:
        out = rows.join(table.select("class", "component_id"), "class", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """``docs`` without the near copies: of each component the row with the smallest doc_id stays, once.

    Rows without an id, and rows that share an id but not a text, are judged by their own text: they are linked under
    keys made of id and text. A row without an id stays only if no row of its component has one; those without words
    all stay. What stays is decided on ids and hashes of texts. Texts are only moved where rows repeat a kept key, and
    in the join with the kept keys once these are more than BROADCAST_IDS.
    """
    scratch = Scratch(docs.sparkSession)
    row_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select("doc_id", row_hash.alias("text_hash"))
    several = texts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
    several = scratch.write(several.filter("low <> high").select("doc_id"), "ngram-ids-of-several")
    marked = small(several.select(F.col("doc_id").alias("__several")))
    keyed = docs.join(marked, F.col("doc_id") == F.col("__several"), "left")
    own = F.col("doc_id").isNull() | F.col("__several").isNotNull()
    key = F.when(own, F.xxhash64("doc_id", row_hash, F.lit("own"))).otherwise(F.col("doc_id").cast("bigint"))
    keyed = keyed.withColumns({"__own": own, "__key": key})
    ids = keyed.select("__key", F.col("doc_id").cast("bigint").alias("__id"), "__own")
    counted = ids.groupBy("__key").agg(F.first("__id").alias("__id"), F.max("__own").alias("__own"), F.count(F.lit(1)).alias("__rows"))
    counted = scratch.write(counted, "ngram-keys")

    # one row of each key made here, so that many rows without an id are not compared with each other
    odd = keyed.filter("__own").select(F.col("__key").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    near = near_classes(keyed.filter("NOT __own").select(F.col("__key").alias("doc_id"), "text").unionByName(odd), o)
    near = near.select(F.col("doc_id").alias("__key"), "n_shingles", "component_id").distinct().join(counted, "__key")
    first = F.min(F.struct(F.col("__id").isNull().alias("bare"), "__id", "__key", F.col("n_shingles").alias("n"), F.col("__rows").alias("rows")))
    heads = near.groupBy("component_id").agg(first.alias("h")).select("h.*")
    heads = scratch.write(heads.select("__key", ((F.col("rows") == 1) | (F.col("bare") & (F.col("n") == 0))).alias("all")), "ngram-heads")
    whole = keyed.join(small(heads.filter("all").select("__key")), "__key", "left_semi")
    once = keyed.join(small(heads.filter("NOT all").select("__key")), "__key", "left_semi").dropDuplicates(["__key"])
    return whole.select(*docs.columns).unionByName(once.select(*docs.columns))
