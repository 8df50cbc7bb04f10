"""Removing long word passages that an earlier document has too, by fixed-block anchors.

A window is ``span`` consecutive words of one document. Each word covered by a window that also starts in a document
with a smaller doc_id goes. All decisions are made on the input.

A window always holds one whole block of its document's fixed, non-overlapping blocks of ``span // 2`` words. So the
blocks of the earlier document are indexed, every rolling window of that length in the later one probes the index, and
where it hits, the ``span``-word windows around the hit are compared in both documents; windows in a row make up the
maximal repeat.

Only passages that can repeat at all are indexed and probed. The smallest of the block hashes inside a window is the
same wherever the window stands, so a window whose smallest block hash no other document selects has no equal (that is
winnowing; it loses nothing). Exact copies of whole documents are settled by a digest of their words before that.

Two hashes of 64 bits, of the window and of its first half, decide equality of windows of different documents; whole
documents are compared by SHA-256. A hit is extended window by window: pairing each hit of a passage with each of its
references would be quadratic in the documents that share it.

Edge cases: null texts have no words; documents with fewer words than ``span`` stay whole; words may repeat inside a
document without being removed; rows with a null doc_id stay whole and are no reference; rows that share a doc_id
never remove each other's words; repeated rows give the same result each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import words, written
from kinloom.llm.tokens import free_memory, pair, rolling, slices, word_hashes

SPAN = 50
#: Ids that are sent to every task at most (40 bytes each); beyond that, texts are joined with them.
BROADCAST_IDS = 1_000_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, a
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return (np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


class Windows:
    """The windows of a slice of texts: ``block`` hashes, and per window its hash and its smallest block hash."""

    def __init__(self, texts: pa.Array, span: int) -> None:
        self.span, self.half = span, span // 2
        hashes, self.offsets, self.words = word_hashes(texts)
        self.block = rolling(hashes, self.half)
        n = max(0, len(hashes) - span + 1)
        tail = rolling(hashes, span - self.half)[self.half :]
        self.window = pair(self.block[:n], tail[:n])
        self.least = _sliding_min(self.block, span - self.half + 1)[:n]

    def spans(self) -> Iterator[tuple[int, int, int, int]]:
        """(text, its first word, its end, end of its window starts)."""
        for i, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            yield i, a, b, max(a, b - self.span + 1)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _digests(words: pa.Array, offsets: np.ndarray) -> list[bytes]:
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " ")
    return [hashlib.sha256(t).digest() for t in joined.cast(pa.binary()).to_pylist()]


def scan(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per row: doc_id, n_words, sha256 of the words, and the block hashes that its windows select."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column("text"), span)
                picks = [np.unique(w.least[a:e]) for _, a, _, e in w.spans()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(w.offsets)), pa.array(_digests(w.words, w.offsets), pa.binary()), _lists(picks)],
                    ["doc_id", "n_words", "sha256", "picks"],
                )
        free_memory()

    return docs.mapInArrow(read, "doc_id bigint, n_words bigint, sha256 binary, picks array<bigint>")


def _candidates(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[pa.RecordBatch, Windows, int, np.ndarray]]:
    """For each text: the slice, its windows, its place, and the starts of windows whose picked hash is shared."""
    for batch in batches:
        for part in slices(batch):
            w, shared = Windows(part.column("text"), span), part.column("shared")
            for i, a, _, e in w.spans():
                picked = np.asarray(shared[i].values.to_numpy()).view(np.uint64) if shared[i].is_valid else np.zeros(0, np.uint64)
                yield part, w, i, a + np.flatnonzero(np.isin(w.least[a:e], picked))
    free_memory()


def anchors(candidates: DataFrame, span: int = SPAN) -> DataFrame:
    """(hash, doc_id, is_block): the fixed blocks of the candidate passages, and all their rolling windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, i, starts in _candidates(batches, span):
            if not len(starts):
                continue
            first = w.offsets[i]
            reach = np.unique((starts[:, None] + np.arange(span - w.half + 1)).ravel()) if len(starts) < 4096 else _reach(starts, span - w.half)
            h, fixed = w.block[reach], (reach - first) % w.half == 0
            h, at = np.unique(np.concatenate([h[fixed], h]), return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.full(len(h), part.column("doc_id")[i].as_py(), np.int64)), pa.array(at < fixed.sum())],
                ["hash", "doc_id", "is_block"],
            )

    return candidates.mapInArrow(emit, "hash bigint, doc_id bigint, is_block boolean")


def _reach(starts: np.ndarray, more: int) -> np.ndarray:
    """The distinct integers of all ranges start .. start + more."""
    edge = np.zeros(starts[-1] - starts[0] + more + 2, np.int32)
    np.add.at(edge, starts - starts[0], 1)
    np.add.at(edge, starts - starts[0] + more + 1, -1)
    return starts[0] + np.flatnonzero(np.cumsum(edge) > 0)


def hit_windows(candidates: DataFrame, span: int = SPAN) -> DataFrame:
    """(window, head, doc_id): the distinct windows around the anchors in ``hits`` that candidates have, with the hash of
    their first half, so that 128 bits tell them apart."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, i, starts in _candidates(batches, span):
            hits = part.column("hits")[i]
            if not len(starts) or not hits.is_valid:
                continue
            low, high = starts[0], starts[-1] + span - w.half + 1
            hit = np.isin(w.block[low:high], hits.values.to_numpy().view(np.uint64))
            before = np.concatenate([[0], np.cumsum(hit)])
            around = before[starts - low + span - w.half + 1] > before[starts - low]
            own, at = np.unique(w.window[starts[around]], return_index=True)
            head = w.block[starts[around][at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.view(np.int64)), pa.array(head.view(np.int64)), pa.array(np.full(len(own), part.column("doc_id")[i].as_py(), np.int64))], ["window", "head", "doc_id"]
            )

    return candidates.mapInArrow(emit, "window bigint, head bigint, doc_id bigint")


def removal(candidates: DataFrame, span: int = SPAN) -> DataFrame:
    """Per row of ``candidates`` (doc_id, sha256, text, gone: hashes of windows that go): doc_id, sha256, n_words, n_removed, kept_sha256,
    repeats (the maximal repeats, as first word and end), kept (the words that stay, joined by one space)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, gone = Windows(part.column("text"), span), part.column("gone")
                own, rows = w.words.to_pylist(), []
                for i, a, b, e in w.spans():
                    take = np.zeros(b - a, bool)
                    runs = []
                    if gone[i].is_valid:
                        starts = np.flatnonzero(np.isin(w.window[a:e], gone[i].values.to_numpy().view(np.uint64)))
                        edge = np.zeros(b - a + 1, np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + span, -1)
                        take = np.cumsum(edge)[:-1] > 0
                        ends = np.flatnonzero(np.diff(np.concatenate([[False], take, [False]]).astype(np.int8)))
                        runs = [{"first": int(x), "end": int(y)} for x, y in ends.reshape(-1, 2)]
                    kept = " ".join(own[a + k] for k in np.flatnonzero(~take))
                    rows.append((b - a, int(take.sum()), hashlib.sha256(kept.encode()).hexdigest(), runs, kept))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("sha256"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]),
                     pa.array(cols[3], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(cols[4])],
                    ["doc_id", "sha256", "n_words", "n_removed", "kept_sha256", "repeats", "kept"],
                )
        free_memory()

    return candidates.mapInArrow(
        cut, "doc_id bigint, sha256 binary, n_words bigint, n_removed bigint, kept_sha256 string, repeats array<struct<first:int,end:int>>, kept string"
    )


def repeats(docs: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, classes, candidates). ``scanned`` is ``scan``; ``classes`` has the smallest doc_id of each sequence of
    words; ``candidates`` are the documents with passages that others have: doc_id, sha256, text, gone (hashes of the windows
    that an earlier document has, null if none)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scanned = written(scan(docs, span), "repeat-scan")
    classes = written(scanned.groupBy("sha256").agg(F.min("doc_id").alias("rep")), "repeat-classes")
    own = scanned.filter(F.size("picks") > 0).join(classes.filter("rep IS NOT NULL"), "sha256").filter("doc_id = rep")
    picks = own.select("doc_id", "sha256", F.explode("picks").alias("pick"))
    shared = picks.groupBy("pick").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    of_doc = picks.join(shared.select("pick"), "pick").groupBy("doc_id", "sha256").agg(F.collect_set("pick").alias("shared"))
    of_doc = written(of_doc, "repeat-shared")
    ids = of_doc.select("doc_id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    own_words = F.unhex(F.sha2(F.array_join(words(F.col("text")), " ").cast("binary"), 256))  # rows that share a doc_id differ in it
    candidates = written(texts.withColumn("sha256", own_words).join(of_doc, ["doc_id", "sha256"]), "repeat-texts")

    found = written(anchors(candidates, span), "repeat-anchors")
    index = found.groupBy("hash").agg(F.min(F.when(F.col("is_block"), F.col("doc_id"))).alias("ref"), F.max("doc_id").alias("last"))
    used = found.join(index, "hash").filter("doc_id > ref OR (is_block AND doc_id < last)")
    hits = used.groupBy("doc_id").agg(F.collect_set("hash").alias("hits"))
    windows = written(hit_windows(candidates.join(hits, "doc_id"), span), "repeat-windows")
    first = windows.groupBy("window", "head").agg(F.min("doc_id").alias("first"))
    late = windows.join(first, ["window", "head"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("window").alias("gone"))
    return scanned, classes, candidates.select("doc_id", "sha256", "text").join(late, "doc_id")


def dedup_words(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256."""
    scanned, classes, candidates = repeats(docs, span)
    cut = written(removal(candidates, span).drop("repeats", "kept"), "repeat-cut")
    rows = scanned.select("doc_id", "n_words", "sha256").join(classes, "sha256", "left")
    copy = (F.col("n_words") >= span) & (F.col("doc_id") > F.col("rep"))
    settled = rows.withColumn("copy", F.coalesce(copy, F.lit(False)))
    # documents that were cut are reported from there; their exact copies are still copies
    cut_ids = cut.select("doc_id", "sha256").distinct()
    few = cut_ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = settled.filter(~F.col("copy")).join(F.broadcast(cut_ids) if few else cut_ids, ["doc_id", "sha256"], "left_anti")
    out = left.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.lower(F.hex("sha256")).alias("kept_sha256"))
    gone = settled.filter("copy").select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(EMPTY_SHA256).alias("kept_sha256")
    )
    return out.unionByName(gone).unionByName(cut.drop("sha256"))
