"""Merkle manifest of a table, with a proof for every row: distributed blocks below, a small broadcast tree on top.

Rows become leaves, in the order of (group, key). Every 8 consecutive nodes of a group have a parent, until a group has
one node, its subroot; the subroots, in the order of the groups, have parents likewise up to the root.

Ranks come from a range partitioning and the counts of its parts, so that no group passes through one task. Blocks of
``Options.block`` nodes are then reduced to one node each, in parallel; blocks of these likewise while more than
``Options.top`` nodes are left (groups that have come down to one node are ranked anew, as one sequence of subroots). The
driver builds the tree over the rest and sends to the executors, for each of its nodes, the path from there to the root:
``Options.top`` paths at most, some 2 KB each, whatever the size of the table. Blocks finish from the top down: each
adds its own levels to the path of its parent, and the blocks of leaves fold every row up to the root.

Edge cases: any column may be null; a null group comes first, and a null key comes first in its group. Rows with equal
keys are ordered by their leaf, so repeated rows are leaves next to each other, each with a proof. An empty table gives
no rows. A row that is the only one of the only group is its own root, and its proof is the digest of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.llm.common import written

FAN = 8


@dataclass(frozen=True)
class Options:
    #: Nodes that one task reduces to one; a power of FAN.
    block: int = FAN**4
    #: Nodes that the driver gets at most.
    top: int = 4096


def field(c: Column) -> Column:
    """A value as ``bytes:value``, or ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of the fields in a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def group_key(c: Column) -> Column:
    """A group as a string that is never null and sorts as UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def parent(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def tree_levels(nodes: list[bytes], most: int | None = None) -> list[list[bytes]]:
    """The levels above ``nodes`` down to one node, or exactly ``most`` of them; the first one is ``nodes``."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        out.append([parent(out[-1][k : k + FAN]) for k in range(0, len(out[-1]), FAN)])
    return out


def path_of(levels: list[list[bytes]], at: int) -> list[tuple[int, list[bytes]]]:
    """For each level below the last: place in the run, and the run's other nodes."""
    out = []
    for level in levels[:-1]:
        start = at - at % FAN
        run = level[start : start + FAN]
        out.append((at - start, run[: at - start] + run[at - start + 1 :]))
        at //= FAN
    return out


def fold(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    for place, others in path:
        node = parent([*others[:place], node, *others[place:]])
    return node


def _packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    """Each level as place, number of others, others (64 bytes each)."""
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in path)


def _unpacked(data: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        out.append((place, [data[at + 2 + 64 * k : at + 66 + 64 * k] for k in range(n)]))
        at += 2 + 64 * n
    return out


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``idx``, the place in its group from 0, and ``total``, the size of the group, as bigint.

    Rows with equal ``order`` get places in any order, so these columns should tell all but equal rows apart.
    """
    keys = [F.asc(group), *[F.asc_nulls_first(c) for c in order]]
    spread = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 4, *keys)
    parts = written(spread.withColumn("__part", F.spark_partition_id()), "merkle-ranges")
    counts = parts.groupBy(group, "__part").count()
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__group"), F.col("__part").alias("__in"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"),
        F.sum("count").over(Window.partitionBy(group)).alias("total"),
    )
    inside = Window.partitionBy("__part", group).orderBy(*keys[1:])
    numbered = parts.withColumn("__row", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__in")))
    return joined.withColumn("idx", (F.col("__row") + F.col("__offset")).cast("bigint")).drop("__row", "__part", "__offset", "__group", "__in")


def _levels_in_block(block: int, total: int) -> int | None:
    """All levels of a block if its group has more than one; else as many as it takes to reach one node."""
    if total <= block:
        return None
    n = 0
    while FAN**n < block:
        n += 1
    return n


def _block(opts: Options) -> Column:
    return F.floor(F.col("idx") / F.lit(opts.block)).cast("bigint")


def _reduced(nodes: DataFrame, opts: Options) -> DataFrame:
    """(seq, idx, total, node) of the nodes one block above."""
    block = opts.block

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        total = table.column("total")[0].as_py()
        top = tree_levels([x.encode() for x in table.column("node").to_pylist()], _levels_in_block(block, total))[-1]
        return pa.table({"seq": [key[0].as_py()], "idx": [key[1].as_py()], "total": [-(-total // block)], "node": [top[0].decode()]})

    grouped = nodes.select("seq", "idx", "total", "node", _block(opts).alias("up")).groupBy("seq", "up")
    return grouped.applyInArrow(reduce, "seq string, idx bigint, total bigint, node string")


def _top_paths(nodes: list[tuple[str, int, bytes]], by_group: bool) -> dict[tuple[str, int], bytes]:
    """Packed path to the root of each of (seq, idx, node); ``by_group``: by way of the subroots of their groups."""
    groups: dict[str, list[bytes]] = {}
    for seq, _, node in sorted(nodes):
        groups.setdefault(seq, []).append(node)
    trees = {g: tree_levels(x) for g, x in groups.items()}
    upper = tree_levels([t[-1][0] for t in trees.values()]) if by_group else []
    return {
        (g, at): _packed(path_of(t, at) + (path_of(upper, k) if upper else []))
        for k, (g, t) in enumerate(trees.items())
        for at in range(len(t[0]))
    }


def _with_paths(nodes: DataFrame, known: DataFrame | None, top: Broadcast, opts: Options, finish: Callable, schema: str) -> DataFrame:
    """``finish(block of nodes, their tree, path above it)`` of every block; paths from the table, or else from the broadcast."""
    block = opts.block

    def whole(table: pa.Table, above: bytes) -> pa.Table:
        table = table.sort_by("idx")
        hashes = [x.encode() for x in table.column("node").to_pylist()]
        return finish(table, tree_levels(hashes, _levels_in_block(block, table.column("total")[0].as_py())), above)

    def alone(key: tuple, table: pa.Table) -> pa.Table:
        return whole(table, top.value[key[0].as_py(), key[1].as_py()])

    def joined(key: tuple, table: pa.Table, path: pa.Table) -> pa.Table:
        return whole(table, path.column("path")[0].as_py())

    blocks = nodes.withColumn("up", _block(opts))
    if known is None:
        return blocks.groupBy("seq", "up").applyInArrow(alone, schema)
    return blocks.groupBy("seq", "up").cogroup(known.groupBy("seq", "idx")).applyInArrow(joined, schema)


def proofs(rows: DataFrame, opts: Options = Options()) -> DataFrame:
    """Proofs of ``rows``: seq (``group_key``), key, leaf, and claimed, the leaf that is folded up (null: leaf).

    Returns key, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    leaves = written(ranked(rows, "seq", "key", "leaf").withColumnRenamed("leaf", "node"), "merkle-leaves")
    levels, nodes, merged = [], leaves, False
    while True:
        levels.append(nodes)
        nodes = written(_reduced(nodes, opts), "merkle-nodes")
        if nodes.limit(opts.top + 1).count() <= opts.top:
            break
        if not merged and nodes.filter("total > 1").isEmpty():
            merged = True
            subroots = nodes.select(F.col("seq").alias("of"), F.lit("").alias("seq"), "node")
            nodes = written(ranked(subroots, "seq", "of", "node"), "merkle-subroots")
    got = [(r["seq"], r["idx"], r["node"].encode()) for r in nodes.select("seq", "idx", "node").collect()]  # opts.top at most
    top = rows.sparkSession.sparkContext.broadcast(_top_paths(got, not merged))
    known = None
    for level in reversed(levels[1:]):
        named = level if "of" in level.columns else level.withColumn("of", F.lit(None).cast("string"))
        known = written(_with_paths(named, known, top, opts, _paths_below, "seq string, idx bigint, path binary"), "merkle-paths")
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_paths(leaves, known, top, opts, _folded, schema)


def _paths_below(table: pa.Table, tree: list[list[bytes]], above: bytes) -> pa.Table:
    """The path of every node of a block, under the name that its own block knows it by."""
    paths = [_packed(path_of(tree, at)) + above for at in range(len(tree[0]))]
    of, seq, idx = (table.column(c).to_pylist() for c in ("of", "seq", "idx"))
    return pa.table({
        "seq": pa.array([s if o is None else o for o, s in zip(of, seq, strict=True)], pa.string()),
        "idx": pa.array([i if o is None else 0 for o, i in zip(of, idx, strict=True)], pa.int64()),
        "path": pa.array(paths, pa.binary()),
    })


def _folded(table: pa.Table, tree: list[list[bytes]], above: bytes) -> pa.Table:
    """Proofs of a block of leaves."""
    upper = _unpacked(above)
    height, total = 0, table.column("total")[0].as_py()
    while FAN**height < total:
        height += 1
    to_subroot = upper[: height - (len(tree) - 1)]
    top = tree[-1][0]
    subroot, root = fold(top, to_subroot), fold(top, upper)
    tail = b"".join(b"".join(others) for _, others in upper)
    claimed, out = table.column("claimed").to_pylist(), []
    for at, leaf in enumerate(tree[0]):
        path = path_of(tree, at)
        proof = hashlib.sha256(b"".join(b"".join(others) for _, others in path) + tail).hexdigest()
        ends = fold(fold(claimed[at].encode() if claimed[at] else leaf, path), upper)
        out.append((proof, ends.decode(), ends == root))
    n = len(out)
    proof, ends, same = zip(*out, strict=True)
    return pa.table({
        "key": table.column("key"), "leaf": table.column("node"), "subroot": [subroot.decode()] * n, "root": [root.decode()] * n,
        "proof_sha256": list(proof), "folded_root": list(ends), "verified": list(same),
    })


def manifest(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """Proofs of a documents table: a group for each lang, leaves by doc_id; every third row by crc32 claims a text in lower case."""
    told = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        group_key(F.col("lang")).alias("seq"), F.col("doc_id").alias("key"), digest(*told, F.col("text")).alias("leaf"),
        F.when(tampered, digest(*told, small)).alias("claimed"),
    )
    return proofs(rows, opts).withColumnRenamed("key", "doc_id")
