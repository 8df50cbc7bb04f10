"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors at cosine c are at squared distance 2 - 2c. A rotation keeps distances and spreads them evenly over the
coordinates; the rotated vectors are split into subspaces of as many dimensions. If a pair is within the squared
distance, then in some subspace it is within that subspace's proportional part of it. What passes in one is verified on
the whole vectors in double precision, once, in however many it passes.

Vectors are packed into chunks of bounded size, written once, and all pairs of chunks are compared where a Cartesian
product reads them, so no vector is ever shuffled to its partners: disk grows with the vectors, and only reading and
comparing with their square. A task returns counts and the components of its links, never the pairs, so that a dense
group of m vectors costs m * m comparisons but only m rows a task.

The rotation is a Walsh-Hadamard transform with fixed signs, and all sums that decide are taken in a fixed order, so that
every task computes the same numbers for a vector. The parts are compared in single precision, with room for its error.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are components of
their own; vectors of different length never link; a null vec_id links with nothing; rows that share a vec_id are one
vector if they are equal, and each such row gets the id's result; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.graph import connected_components
from kinloom.plans.storage import Scratch


#: Chunks of long vectors have fewer of them: at most this many bytes as doubles, or 64 vectors.
CHUNK_BYTES = 2 << 20
#: Rows that a task gathers before it adds up what concerns the same vectors.
GATHERED = 1 << 20
#: Chunks that a task keeps rotated.
KEPT = 24
#: A chunk is a row: few to a row group, and sizes looked at after each, so that no reader or writer holds many.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


@dataclass(frozen=True)
class Options:
    """Links have a cosine of ``cosine`` at least. Vectors are split into ``subspaces`` (a power of two, 8 at most); chunks
    have at most ``chunk`` vectors."""

    cosine: float = 0.9
    subspaces: int = 2
    chunk: int = 4096

    @property
    def squared(self) -> float:
        return 2 - 2 * self.cosine


def _sums(a: np.ndarray) -> np.ndarray:
    """Row sums, always added in the same order. The width is a power of two."""
    while a.shape[1] > 1:
        h = a.shape[1] // 2
        a = a[:, :h] + a[:, h:]
    return a[:, 0]


def _padded(x: np.ndarray) -> np.ndarray:
    d = 1 << max(3, (x.shape[1] - 1).bit_length())
    return np.pad(x.astype(np.float64), ((0, 0), (0, d - x.shape[1])))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, padded with zeros to a power of two."""
    x = _padded(x)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge components get lost
    return x / np.sqrt(_sums(x * x))[:, None]


def rotated(u: np.ndarray) -> np.ndarray:
    d = u.shape[1]
    signs = np.random.Generator(np.random.PCG64(20)).integers(0, 2, d) * 2.0 - 1
    out, h = u * signs, 1
    while h < d:
        pairs = out.reshape(len(out), d // (2 * h), 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), d)
        h *= 2
    return out / np.sqrt(d)


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) for each vector length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def usable(embedding: Column) -> Column:
    """Whether a vector can link: not null, finite, not zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def packed(vectors: DataFrame, o: Options) -> DataFrame:
    """(d, chunk, ids, data): chunks of vectors of d components, in bytes; single precision stays single."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        name = TaskContext.get().partitionId() << 32

        def chunks(d: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal name
            size = min(o.chunk, max(64, CHUNK_BYTES // (8 * d)))
            if sum(len(ids) for ids, _ in held[d]) >= min(size, least):
                ids, x = (np.concatenate(c) for c in zip(*held[d], strict=True))
                end = len(ids) if least == 1 else len(ids) - len(ids) % size
                for k in range(0, end, size):
                    to = min(end, k + size)
                    yield pa.RecordBatch.from_pydict(
                        {"d": pa.array([d], pa.int64()), "chunk": pa.array([name], pa.int64()), "ids": pa.array([ids[k:to].tobytes()], pa.binary()), "data": pa.array([x[k:to].tobytes()], pa.binary())}
                    )
                    name += 1
                held[d] = [(ids[end:], x[end:])]

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for rows, x in _matrix(batch.column("embedding")):
                held[x.shape[1]].append((ids[rows], x if x.dtype == np.float32 else x.astype(np.float64)))
                yield from chunks(x.shape[1], o.chunk)
        for d in list(held):
            yield from chunks(d, 1)

    return vectors.select("vec_id", "embedding").mapInArrow(pack, "d bigint, chunk bigint, ids binary, data binary")


def _sides(u: np.ndarray, o: Options) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each subspace, factors of which the products of vectors are minus half the squared distance in it."""
    out = []
    for part in np.split(rotated(u), o.subspaces, axis=1):
        half, one = -(part * part).sum(axis=1, keepdims=True) / 2, np.ones((len(u), 1))
        left, right = (np.concatenate([part, *ends], axis=1).astype(np.float32) for ends in ((half, one), (one, half)))
        out.append((left, np.ascontiguousarray(right.T)))
    return out


@dataclass
class _Chunk:
    ids: np.ndarray
    unit: np.ndarray
    sides: list[tuple[np.ndarray, np.ndarray]]


def _links(x: _Chunk, y: _Chunk, same: bool, o: Options, rows: int = 512, cols: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of links between the chunks x and y; if they are the same, each pair once."""
    low = np.float32(-(o.squared / o.subspaces) / 2 - 1e-5)
    for a in range(0, len(x.ids), rows):
        for b in range(0, len(y.ids), cols):
            if same and b + cols <= a:
                continue
            near = []
            for (left, _), (_, right) in zip(x.sides, y.sides, strict=True):
                gap = left[a : a + rows] @ right[:, b : b + cols]
                some = np.flatnonzero(gap.max(axis=1) >= low)
                if len(some):
                    i, j = np.nonzero(gap[some] >= low)
                    near.append((a + some[i]) * len(y.ids) + b + j)
            if not near:
                continue
            i, j = np.divmod(np.unique(np.concatenate(near)), len(y.ids))
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                ok = _sums(x.unit[u] * y.unit[v]) >= o.cosine
                yield u[ok], v[ok]


def _roots(n: int, u: np.ndarray, v: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each node's component; ``before`` has those of edges given before."""
    label = np.arange(n)
    if before is not None:
        u, v = np.concatenate([label, u]), np.concatenate([before, v])
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _found(x: _Chunk, y: _Chunk, same: bool, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, their links, smallest ids of their components) in two chunks."""
    nodes, place = np.unique(np.concatenate([x.ids, y.ids]), return_inverse=True)  # in order: the smallest index is the smallest id
    links, label, ends, waiting = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), [], 0
    at_x, at_y = place[: len(x.ids)], place[len(x.ids) :]
    for i, j in _links(x, y, same, o):
        u, v = at_x[i], at_y[j]
        links += np.bincount(u, minlength=len(nodes)) + np.bincount(v, minlength=len(nodes))
        ends.append((u, v))
        waiting += len(u)
        if waiting >= GATHERED:
            label, ends, waiting = _roots(len(nodes), *(np.concatenate(e) for e in zip(*ends, strict=True)), label), [], 0
    if ends:
        label = _roots(len(nodes), *(np.concatenate(e) for e in zip(*ends, strict=True)), label)
    some = links > 0
    return nodes[some], links[some], nodes[label[some]]


def _together(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each id: its links added up, and the smallest id of its component in all of them."""
    ids, links, roots = (np.concatenate(c) for c in zip(*found, strict=True))
    nodes, place = np.unique(np.concatenate([ids, roots]), return_inverse=True)
    label = _roots(len(nodes), place[: len(ids)], place[len(ids) :])
    total = np.zeros(len(nodes), np.int64)
    np.add.at(total, place[: len(ids)], links)
    return nodes, total, nodes[label]


def compare(chunks: DataFrame, o: Options) -> DataFrame:
    """(vec_id, links, root) per task: how many links a vector has in it, and the smallest id of its component."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: OrderedDict[int, _Chunk] = OrderedDict()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def chunk(batch: pa.RecordBatch, side: str, k: int) -> _Chunk:
            name, d = batch.column("chunk" + side)[k].as_py(), batch.column("d" + side)[k].as_py()
            if name not in ready:
                ids = np.frombuffer(batch.column("ids" + side)[k].as_buffer(), np.int64)
                data = batch.column("data" + side)[k].as_buffer()
                x = unit(np.frombuffer(data, np.float32 if data.size == 4 * d * len(ids) else np.float64).reshape(-1, d))
                ready[name] = _Chunk(ids.copy(), x, _sides(x, o))
                if len(ready) > KEPT:
                    ready.popitem(last=False)
            ready.move_to_end(name)
            return ready[name]

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], ["vec_id", "links", "root"])

        for batch in batches:
            for k in range(batch.num_rows):
                x, y = chunk(batch, "1", k), chunk(batch, "2", k)
                found.append(_found(x, y, x is y, o))
                if sum(len(ids) for ids, _, _ in found) >= GATHERED:
                    found = [_together(found)]
                    if len(found[0][0]) >= GATHERED // 2:
                        yield rows()
                        found = []
        if found:
            found = [_together(found)]
            yield rows()

    one, two = (chunks.select(*[F.col(c).alias(c + side) for c in chunks.columns]) for side in "12")
    pairs = one.join(two.hint("shuffle_replicate_nl"), (F.col("d1") == F.col("d2")) & (F.col("chunk1") <= F.col("chunk2")))
    return pairs.mapInArrow(tiles, "vec_id bigint, links bigint, root bigint")


def near_vectors(embeddings: DataFrame, o: Options = Options()) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    scratch = Scratch(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    vectors = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).distinct()
    chunks = scratch.write(packed(vectors, o), "vectors", **ROW_GROUPS)
    found = scratch.write(compare(chunks, o), "vector-links")
    scratch.drop(chunks)
    edges = found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))
    component = connected_components(edges, lambda df: scratch.write(df, "vector-edges"), scratch.drop)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    out = rows.select("vec_id").join(links, "vec_id", "left").join(component.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component_id = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
        (F.col("vec_id") == component_id).alias("kept"),
    )
