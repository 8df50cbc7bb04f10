"""Removing long byte strings that also stand elsewhere, with a logarithmic family of suffix arrays.

A string of ``Options.length`` bytes is looked at by its anchor: the leftmost gram of ``Options.gram`` bytes with the
smallest hash in it. Equal strings have equal anchors at equal places, so it is enough to index anchors, one in some 185
bytes. Each entry has the bytes that the strings of one anchor cover, ``left`` of it and ``right`` from it on. Grams that
stand once only are dropped before that, and equal entries of a batch are indexed once, with their number.

Batches of documents come one after the other. The entries of a batch, sorted by ``right``, are its suffix array, in
buckets by gram. It is merge-scanned with all levels there are: among the suffixes of one gram the longest common prefix
of any two is the least one between neighbours on the way, and likewise backwards in the order of reversed ``left``. Two
entries have a string of ``length`` bytes in common if both together reach that length, and since all strings of an entry
hold its anchor, what they cover is one span: from the farthest reach to the left to the farthest to the right. Two
levels of the same number of batches are merged into one of the next size before the next batch is scanned, so an entry
is written a logarithmic number of times, and a scan reads a logarithmic number of tables.

A gram with more than ``Options.group`` different entries would make an array that no task should hold, quadratic to
scan. It is split by what its strings have in common: those that begin in the same block of 64 places before the anchor
share all but 63 bytes of their length, so entries meet under a hash of these, once a block. Groups that are still too
large are split by blocks of 8 places, and then by single places, where a group of equal hashes (of 128 bits) is one
repeated string and needs no array. That takes at most 8 rows an entry and turn, wherever the group comes from.

Exact copies of whole documents are found by SHA-256 first; one of them stands for all.

Edge cases: null texts are empty; texts shorter than ``length`` stay whole; periodic texts repeat in themselves; spans may
cut characters in two, so what is kept is bytes; rows with null or shared doc_ids count like any other row, and repeated
rows are copies of each other; extra columns are ignored. Texts of any length are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.tokens import free_memory, mixed, slices
from kinloom.plans.storage import Scratch

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Ids that are sent to every task at most (8 bytes each); beyond that, texts are joined with them.
BROADCAST_IDS = 1_000_000
#: Starts of strings in one piece of a long text.
PIECE = 1 << 21
_PLACE = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15
_NULL_ID = -(2**63)


@dataclass(frozen=True)
class Options:
    #: Least length of a repeat, in bytes.
    length: int = 400
    #: Bytes of an anchor.
    gram: int = 32
    #: Batches that ``long_repeats`` deals the documents into.
    batches: int = 4
    #: Bytes of entries in one bucket of all levels together, on average.
    bucket_bytes: int = 2 << 20
    #: Different entries of one gram that are held in one suffix array at most.
    group: int = 1000


def _powers(m: int, n: int) -> np.ndarray:
    steps = np.full(n, m, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` bytes: polynomials by prefix sums, then mixed."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(data)))])
    return mixed((sums[width:] - sums[:-width]) * _powers(pow(_ODD, -1, 1 << 64), n))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have, n = 1, len(a) - width + 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[:n], a[width - have : width - have + n])


def pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets of texts in them, row of each, place of its first byte in the row); a long text comes in several."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    if ends[-1] - ends[0] <= 2 * PIECE:
        yield data[ends[0] : ends[-1]], ends - ends[0], np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for start in range(a, max(a + 1, b - length + 1), PIECE):
            part = data[start : min(b, start + PIECE + length - 1)]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([start - a])


@dataclass
class Anchors:
    """Anchors of a piece, in order: text, place, hash, first and last start of the strings that choose it."""

    of: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(data: np.ndarray, offsets: np.ndarray, opts: Options) -> Anchors:
    none = np.zeros(0, np.int64)
    if len(data) < opts.length:
        return Anchors(none, none, none.astype(np.uint64), none, none)
    hashes = gram_hashes(data, opts.gram)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the leftmost
    place = (_sliding_min(keys, opts.length - opts.gram + 1) & _PLACE).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= opts.length)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - opts.length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(place)] > 0)
    if not len(starts):
        return Anchors(none, none, none.astype(np.uint64), none, none)
    own = place[starts]
    turn = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
    at = own[turn[:-1]]
    return Anchors(np.searchsorted(offsets, at, side="right") - 1, at, hashes[at], starts[turn[:-1]], starts[turn[1:] - 1])


def scan(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """Per row: doc_id, n_bytes, sha (of the text), grams (its anchors' hashes; one that it has twice or more, twice)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                found: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
                for data, offsets, rows, _ in pieces(texts, opts.length):
                    a = anchors(data, offsets, opts)
                    cut = np.searchsorted(a.of, np.arange(len(rows) + 1))
                    for k, row in enumerate(rows):
                        if cut[k + 1] > cut[k]:
                            found[row].append(a.gram[cut[k] : cut[k + 1]])
                grams = []
                for f in found:
                    own, n = np.unique(np.concatenate(f) if f else np.zeros(0, np.uint64), return_counts=True)
                    grams.append(np.concatenate([own, own[n > 1]]).view(np.int64))
                shas = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in texts.cast(pa.binary())]
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(shas, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "sha", "grams"])
        free_memory()

    return docs.mapInArrow(read, "doc_id bigint, n_bytes bigint, sha binary, grams array<bigint>")


def entries(candidates: DataFrame, opts: Options) -> DataFrame:
    """The anchors of ``candidates`` (sha, text, shared) whose grams are shared: sha, at, upto, times, g, left, right, cid1,
    cid2. Equal entries in a row, as periodic texts have at every place, are one row from the first of them to the last."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shared = np.unique(part.column("shared").flatten().to_numpy().view(np.uint64))
                sha = part.column("sha").to_pylist()
                for data, offsets, rows, bases in pieces(part.column("text"), opts.length):
                    a = anchors(data, offsets, opts)
                    held = data.tobytes()
                    take = np.flatnonzero(np.isin(a.gram, shared))
                    for lot in (take[k : k + 4096] for k in range(0, len(take), 4096)):
                        left = [held[x:y] for x, y in zip(a.first[lot].tolist(), a.at[lot].tolist(), strict=True)]
                        right = [held[x : y + opts.length] for x, y in zip(a.at[lot].tolist(), a.last[lot].tolist(), strict=True)]
                        ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x + y, seed=len(x)) for x, y in zip(left, right, strict=True)), np.int64).reshape(-1, 2)
                        of, at = a.of[lot], a.at[lot]
                        goes_on = (ids[1:] == ids[:-1]).all(axis=1) & (of[1:] == of[:-1]) & (np.diff(at) <= opts.length)
                        head = np.flatnonzero(np.concatenate([[True], ~goes_on]))
                        tail = np.concatenate([head[1:], [len(lot)]]) - 1
                        of, shift = of[head], bases[of[head]] - offsets[of[head]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([sha[rows[k]] for k in of], pa.binary()), pa.array(at[head] + shift), pa.array(at[tail] + shift), pa.array(tail - head + 1), pa.array(a.gram[lot][head].view(np.int64)),
                             pa.array([left[k] for k in head], pa.binary()), pa.array([right[k] for k in head], pa.binary()), pa.array(ids[head, 0]), pa.array(ids[head, 1])],
                            ["sha", "at", "upto", "times", "g", "left", "right", "cid1", "cid2"],
                        )
        free_memory()

    return candidates.mapInArrow(read, "sha binary, at bigint, upto bigint, times bigint, g bigint, left binary, right binary, cid1 bigint, cid2 bigint")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((x & -x).bit_length() - 1) // 8 if x else n


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n :], "little") ^ int.from_bytes(b[len(b) - n :], "little")
    return n - (x.bit_length() + 7) // 8


def _from(low: np.ndarray, i: int, own: int) -> np.ndarray:
    """Common lengths of the entry at place ``i`` of an order with all others, from those of neighbours."""
    before = np.minimum.accumulate(low[:i][::-1])[::-1]
    return np.concatenate([before, [own], np.minimum.accumulate(low[i:])])


def _reaches(left: list[bytes], right: list[bytes], new: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Farthest reaches (to the left, to the right) of the entries of one gram, sorted by ``right``, in strings that one of
    two entries has as a new one; 0, 0 without any."""
    m = len(right)
    far_l, far_r = np.zeros(m, np.int64), np.zeros(m, np.int64)
    back = [x[::-1] for x in left]
    order = sorted(range(m), key=back.__getitem__)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    low_r = np.array([common_prefix(right[k], right[k + 1]) for k in range(m - 1)], np.int64)
    low_l = np.array([common_suffix(left[order[k]], left[order[k + 1]]) for k in range(m - 1)], np.int64)
    for i in np.flatnonzero(new).tolist():
        r = _from(low_r, i, 0)
        if r.max() + len(left[i]) < length:
            continue
        to_l = _from(low_l, int(place[i]), 0)[place]
        hit = r + to_l >= length
        hit[i] = False
        if hit.any():
            far_l[i], far_r[i] = max(far_l[i], to_l[hit].max()), max(far_r[i], r[hit].max())
            far_l[hit], far_r[hit] = np.maximum(far_l[hit], to_l[hit]), np.maximum(far_r[hit], r[hit])
    return far_l, far_r


_ENTRY = "bucket bigint, key bigint, left binary, right binary, cid1 bigint, cid2 bigint"
_NAMES = ["bucket", "key", "left", "right", "cid1", "cid2"]


def merge_scan(batch: DataFrame, levels: DataFrame, opts: Options) -> DataFrame:
    """(cid1, cid2, l, r): reaches of entries of the batch and of the levels in the strings they share."""

    def scan_bucket(new: pa.Table, old: pa.Table) -> pa.Table:
        cols = {c: [*new.column(c).to_pylist(), *old.column(c).to_pylist()] for c in _NAMES[1:]}
        keys, right, fresh = cols["key"], cols["right"], new.num_rows
        order = sorted(range(len(right)), key=lambda k: (keys[k], right[k]))  # two sorted runs or more: merged in linear time
        out, a = [], 0
        while a < len(order):
            b = a + 1
            while b < len(order) and keys[order[b]] == keys[order[a]]:
                b += 1
            run = order[a:b]
            if b - a > 1 and min(run) < fresh:
                far_l, far_r = _reaches([cols["left"][k] for k in run], [right[k] for k in run], np.array(run) < fresh, opts.length)
                out += [(cols["cid1"][run[k]], cols["cid2"][run[k]], int(far_l[k]), int(far_r[k])) for k in np.flatnonzero(far_l + far_r).tolist()]
            a = b
        named = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in named], names=["cid1", "cid2", "l", "r"])

    return batch.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(scan_bucket, "cid1 bigint, cid2 bigint, l bigint, r bigint")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One sorted level out of two; entries that both have stand once."""

    def merge(x: pa.Table, y: pa.Table) -> pa.Table:
        both = pa.concat_tables([t.select(_NAMES) for t in (x, y)])
        entry = list(zip(*(both.column(c).to_pylist() for c in ("key", "right", "left")), strict=True))
        order = sorted(range(len(entry)), key=entry.__getitem__)
        return both.take([k for n, k in enumerate(order) if not n or entry[k] != entry[order[n - 1]]])

    return a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInArrow(merge, _ENTRY)


class Family:
    """Levels of suffix arrays; one of size k is made of 2**k batches. Buckets must be the same for all batches."""

    def __init__(self, spark: SparkSession, opts: Options, scratch: Scratch) -> None:
        self._opts, self._scratch = opts, scratch
        self._none = spark.createDataFrame([], _ENTRY)
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Take the written entries of a batch (``_ENTRY``) in; returns what ``merge_scan`` finds, written."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((size + 1, self._scratch.write(merged(b, a), "suffix-level")))
            self._scratch.drop(a, b)
        old = self._none
        for _, level in self.levels:
            old = old.unionByName(level)
        found = self._scratch.write(merge_scan(batch, old, self._opts), "suffix-found")
        self.levels.append((0, batch))
        return found


def _steps(length: int) -> list[int]:
    """Sizes of the blocks that places before an anchor are split into, turn by turn, down to 1."""
    out = [1]
    while out[-1] * 8 < length:
        out.append(out[-1] * 8)
    return out[::-1]


def _cores(crowded: DataFrame, step: int, opts: Options) -> DataFrame:
    """(batch, cid1, cid2, key, more, low): for each entry (low: where its block of the turn before begins) and block of
    ``step`` places, a hash of the bytes that all its strings beginning there have in common."""
    length = opts.length

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (left, right, low) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("left", "right", "low")), strict=True)):
                first, last = max(length - len(right), 0 if low is None else low), min(len(left), length if low is None else low + 8 * step - 1)
                for at in range(first - first % step, last + 1, step):
                    core = left[len(left) - at :] + right[: max(0, length - at - step + 1)]
                    digest = xxhash.xxh3_128_digest(core, seed=at)
                    out.append((row, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), at))
            row, key, more, low = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 4))
            own = [batch.column(c).take(pa.array(row)) for c in ("batch", "cid1", "cid2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(key), pa.array(more), pa.array(low)], ["batch", "cid1", "cid2", "key", "more", "low"])

    return crowded.mapInArrow(read, "batch int, cid1 bigint, cid2 bigint, key bigint, more bigint, low bigint")


def split_crowded(crowded: DataFrame, opts: Options, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(entries by smaller keys, reaches of strings that crowds share) of entries of grams that too many entries have.

    ``crowded`` has batch, cid1, cid2, left, right. Two entries that share a string meet under a key, or in a reach.
    """
    texts = crowded.select("batch", "cid1", "cid2", "left", "right")
    turn, arrays, reaches = crowded.withColumn("low", F.lit(None).cast("bigint")), [], []
    for step in _steps(opts.length):
        if turn.isEmpty():
            break
        cores = scratch.write(_cores(turn, step, opts), "suffix-cores")
        sizes = scratch.write(cores.groupBy("key", "more").count().filter("count > 1"), "suffix-sizes")
        met = scratch.write(cores.join(sizes, ["key", "more"]), "suffix-met")
        large = F.col("count") > opts.group
        arrays.append(met.filter(~large).join(texts, ["batch", "cid1", "cid2"]).select("batch", "cid1", "cid2", "left", "right", "key"))
        if step == 1:
            reaches.append(met.filter(large).select("cid1", "cid2", F.col("low").alias("l"), (opts.length - F.col("low")).alias("r")))
        else:
            turn = met.filter(large).join(texts, ["batch", "cid1", "cid2"])
    return arrays, reaches


def _broadcast_if_few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def long_repeats(docs: DataFrame, opts: Options, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, classes, spans). ``scanned`` is ``scan``; ``classes`` has the copies of each sha; ``spans`` has, for shas
    of one copy with repeats, text and spans (first, end; may overlap)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scanned = scratch.write(scan(docs, opts).withColumn("id", F.coalesce("doc_id", F.lit(_NULL_ID))), "suffix-scan")
    classes = scratch.write(scanned.groupBy("sha").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")), "suffix-classes")
    grams = scanned.filter(F.size("grams") > 0).join(classes.select("sha", "id"), ["sha", "id"]).select("sha", "id", F.explode("grams").alias("g"))
    shared = scratch.write(grams.groupBy("g").count().filter("count > 1").select("g"), "suffix-shared")
    of_doc = scratch.write(grams.join(shared, "g").groupBy("sha", "id").agg(F.collect_set("g").alias("shared")), "suffix-grams")
    named = docs.withColumn("id", F.coalesce("doc_id", F.lit(_NULL_ID))).drop("doc_id")
    near = named.join(_broadcast_if_few(of_doc.select("id").distinct()), "id", "left_semi")
    near = near.withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    candidates = scratch.write(near.join(of_doc, ["sha", "id"]).select("sha", "text", "shared"), "suffix-texts")

    batch = F.pmod(F.xxhash64("sha"), F.lit(opts.batches)).cast("int").alias("batch")
    found = entries(candidates, opts).select("*", batch, F.xxhash64("sha", "at").alias("oid"))
    occurrences = scratch.write(found, "suffix-entries")
    scratch.drop(shared, of_doc)
    distinct = occurrences.groupBy("batch", "cid1", "cid2", "g").agg(
        F.min("oid").alias("oid"), F.sum("times").alias("n"), F.max(F.length("left")).alias("nl"), F.max(F.length("right")).alias("nr")
    )
    distinct = scratch.write(distinct, "suffix-distinct")
    hot = scratch.write(distinct.groupBy("g").count().filter(F.col("count") > opts.group).select("g", F.lit(True).alias("hot")), "suffix-hot")
    marked = distinct.join(_broadcast_if_few(hot), "g", "left")
    texts = occurrences.select("oid", "cid1", "left", "right").join(marked.select("oid", "cid1", "cid2", "batch", "g", "hot"), ["oid", "cid1"])
    texts = scratch.write(texts.drop("oid"), "suffix-arrays")
    arrays, reaches = split_crowded(texts.filter("hot"), opts, scratch)
    indexed = texts.filter("hot IS NULL").select("batch", "cid1", "cid2", "left", "right", F.col("g").alias("key"))
    for more in arrays:
        indexed = indexed.unionByName(more)
    size = distinct.agg(F.sum(F.col("nl") + F.col("nr"))).first()[0] or 0  # one number
    buckets = max(1, -(-size // opts.bucket_bytes))
    indexed = scratch.write(indexed.withColumn("bucket", F.pmod("key", F.lit(buckets))), "suffix-indexed")
    scratch.drop(texts)

    family = Family(docs.sparkSession, opts, scratch)
    for k in range(opts.batches):
        part = indexed.filter(f"batch = {k}").select(*_NAMES)
        reaches.append(family.add(part.sortWithinPartitions("bucket", "key", "right")))
    reaches.append(distinct.filter("n > 1").select("cid1", "cid2", F.col("nl").cast("bigint").alias("l"), F.col("nr").cast("bigint").alias("r")))
    reach = reaches[0]
    for more in reaches[1:]:
        reach = reach.unionByName(more)
    reach = scratch.write(reach.groupBy("cid1", "cid2").agg(F.max("l").alias("l"), F.max("r").alias("r")), "suffix-reach")
    spans = occurrences.select("sha", "at", "upto", "cid1", "cid2").join(reach, ["cid1", "cid2"])
    spans = spans.groupBy("sha").agg(F.collect_list(F.struct((F.col("at") - F.col("l")).alias("first"), (F.col("upto") + F.col("r")).alias("end"))).alias("spans"))
    once = classes.filter("copies = 1").select("sha")
    return scanned, classes, candidates.select("sha", "text").join(spans.join(once, "sha"), "sha")


def removal(spans: DataFrame) -> DataFrame:
    """Per row of ``spans`` (sha, text, spans): sha, n_removed, n_spans, kept_sha256, removed (maximal spans), kept (bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, found in zip(part.column("text").cast(pa.binary()), part.column("spans").to_pylist(), strict=True):
                    data, gone = text.as_py(), []
                    for s in sorted((s["first"], s["end"]) for s in found):
                        if gone and s[0] <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], s[1])
                        else:
                            gone.append(list(s))
                    edges = [0, *[x for s in gone for x in s], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), [{"first": a, "end": b} for a, b in gone], kept))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("sha"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]),
                     pa.array(cols[3], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(cols[4], pa.binary())],
                    ["sha", "n_removed", "n_spans", "kept_sha256", "removed", "kept"],
                )
        free_memory()

    return spans.mapInArrow(cut, "sha binary, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<first:bigint,end:bigint>>, kept binary")


def dedup_bytes(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(docs.sparkSession)
    scanned, classes, spans = long_repeats(docs, opts, scratch)
    whole = classes.filter((F.col("copies") > 1) & (F.col("n_bytes") >= opts.length)).select(
        "sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(EMPTY_SHA256).alias("kept_sha256")
    )
    settled = scratch.write(removal(spans).drop("removed", "kept").unionByName(whole), "suffix-cut")
    scratch.drop_all_but(scanned, settled)
    none = F.lit(0).cast("bigint")
    return scanned.join(settled, "sha", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
