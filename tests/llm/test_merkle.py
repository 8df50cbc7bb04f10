import hashlib
import zlib

import pytest

from kinloom.llm import merkle
from tests.llm.data import AWKWARD, documents, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def lower(s):
    return s if s is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def up(nodes):
    return [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]


def climb(nodes, at, node):
    """(others on the way up, end of the fold from ``node``)."""
    others = []
    while len(nodes) > 1:
        start = at - at % 8
        run = nodes[start : start + 8]
        others += run[: at - start] + run[at - start + 1 :]
        node = h(*run[: at - start], node, *run[at - start + 1 :])
        nodes, at = up(nodes), at // 8
    return others, node


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    members = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]))) for g in order}
    leaves = {g: [leaf_of(r, r["text"]) for r in members[g]] for g in order}
    subs = [climb(leaves[g], 0, leaves[g][0])[1] for g in order]
    root = climb(subs, 0, subs[0])[1]
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(members[g]):
            told = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            claimed = leaf_of(r, lower(r["text"])) if told else leaves[g][at]
            others, end = climb(leaves[g], at, claimed)
            more, end = climb(subs, k, end)
            out.append((r["doc_id"], leaves[g][at], subs[k], root, h(*others, *more), end, end == root))
    return sorted(out, key=str)


def found(df, opts=merkle.Options()):
    return sorted((tuple(r) for r in merkle.manifest(df, opts).collect()), key=str)


@pytest.mark.parametrize("opts", [merkle.Options(), merkle.Options(block=8, top=4), merkle.Options(block=64, top=2), merkle.Options(block=8, top=1)])
def test_equal_to_brute_force(spark, opts):
    texts = [*AWKWARD, *[prose(k, 5).title() for k in range(140)]]
    langs = {k: ("en" if k % 3 else "é") for k in range(len(texts))} | {5: None, 6: None, 7: "", 8: "de", 9: "x\U0001f600"}
    df = documents(spark, texts, langs)
    df = df.unionByName(df.filter("doc_id IN (3, 20)")).unionByName(df.filter("doc_id = 21").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *df.columns[1:]))
    assert found(df, opts) == brute(df.collect())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_borders_of_runs(spark, n):
    df = documents(spark, [f"Text {k}" for k in range(n)])
    assert found(df, merkle.Options(block=8, top=8)) == brute(df.collect())


def test_many_groups_are_ranked_as_one_sequence(spark):
    df = documents(spark, [f"t{k}" for k in range(90)], {k: f"l{k % 70}" for k in range(90)})
    assert found(df, merkle.Options(block=8, top=3)) == brute(df.collect())


def test_empty_table_and_lone_row(spark):
    df = documents(spark, ["one Text"])
    assert found(df.limit(0)) == []
    assert found(df) == brute(df.collect())
    (row,) = found(df)
    assert row[1] == row[2] == row[3] and row[4] == h()
