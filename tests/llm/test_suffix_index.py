import hashlib
import random
from collections import Counter

import pytest

from kinloom.llm import suffix_index as sx
from kinloom.plans.storage import Scratch
from tests.llm.data import AWKWARD, documents, prose

SMALL = sx.Options(length=40, gram=8, bucket_bytes=2000)


def brute(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, opts):
    return sorted((tuple(r) for r in sx.dedup_bytes(df, opts).collect()), key=str)


def planted(seed):
    """Texts with passages, near copies, copies, runs of one byte, and letters of several bytes."""
    rng = random.Random(seed)
    passages = [prose(900 + k, rng.randint(4, 40)) for k in range(5)] + ["é\U0001f600" * 12, "x" * 90, "ab" * 60]
    texts = list(AWKWARD)
    for k in range(60):
        parts = [prose(seed * 1000 + k, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 3)
            parts += [p[cut:], prose(rng.randint(0, 10**6), rng.randint(0, 6))]
        text = " ".join(parts)
        texts.append(text)
        if rng.random() < 0.3:
            at = rng.randint(0, len(text))
            texts.append(text[:at] + rng.choice(["", "Q", "zz"]) + text[at:])
    return texts


@pytest.mark.parametrize(("seed", "opts"), [
    (1, SMALL), (2, sx.Options(length=40, gram=8, group=2, bucket_bytes=500)), (5, sx.Options(length=70, gram=6, group=1)), (3, sx.Options(length=40, gram=40, batches=7)), (4, sx.Options(length=64, gram=5, batches=1)),
])
def test_equal_to_brute_force(spark, seed, opts):
    df = documents(spark, planted(seed))
    df = df.unionByName(df.filter("doc_id IN (3, 30)")).unionByName(df.filter("doc_id IN (12, 31)").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *df.columns[1:]))
    df = df.unionByName(df.filter("doc_id = 32").selectExpr("33L AS doc_id", "concat(text, ' more') AS text", *df.columns[2:]))
    assert found(df, opts) == brute([(r["doc_id"], r["text"]) for r in df.collect()], opts.length)


def test_length_of_the_contract_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sx, "PIECE", 5000)  # for the driver's own pieces; workers use the real ones
    p = prose(5, 200)
    texts = [p, "a" + p[:399], "b" + p[:400], "c" + p[100:650] + "d", prose(6, 40_000) + p[:500], "y" * 5000, None]
    df = documents(spark, texts)
    assert found(df, sx.Options()) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 400)


def test_pieces_of_a_long_text_have_all_strings():
    import numpy as np
    import pyarrow as pa

    text = prose(8, 3000)
    old, sx.PIECE = sx.PIECE, 1000
    try:
        parts = list(sx.pieces(pa.array(["", text, None]), 40))
    finally:
        sx.PIECE = old
    starts = [base + k for data, offsets, rows, (base,) in parts if rows[0] == 1 for k in range(len(data) - 39)]
    assert starts == list(range(len(text) - 39))
    assert all(bytes(data) == text[base : base + len(data)].encode() for data, _, (row,), (base,) in parts if row == 1)
    whole = sx.anchors(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), SMALL)
    assert (whole.last - whole.first + 1).sum() == len(text) - 39


def test_levels_grow_geometrically(spark):
    scratch = Scratch(spark)
    family = sx.Family(spark, SMALL, scratch)
    sizes = []
    for k in range(5):
        rows = [(0, j, prose(k * 10 + j, 3).encode(), prose(k * 10 + j, 9).encode(), k, j) for j in range(3)]
        family.add(scratch.write(spark.createDataFrame(rows, sx._ENTRY)))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]
    assert sum(level.count() for _, level in family.levels) == 15


def test_empty_table(spark):
    assert found(documents(spark, ["a"]).limit(0), SMALL) == []


def test_common_ends():
    assert (sx.common_prefix(b"abcd", b"abx"), sx.common_prefix(b"", b"a"), sx.common_prefix(b"ab", b"abc")) == (2, 0, 2)
    assert (sx.common_suffix(b"xbcd", b"ybcd"), sx.common_suffix(b"", b"a"), sx.common_suffix(b"cd", b"bcd"), sx.common_suffix(b"a", b"b")) == (3, 0, 2, 0)


def test_hashes_depend_on_the_gram_alone():
    import numpy as np

    text = (prose(9, 60) + "x" * 50 + prose(9, 60)).encode()
    data = np.frombuffer(text, np.uint8)
    own = {}
    for k, h in enumerate(sx.gram_hashes(data, 8).tolist()):
        assert own.setdefault(text[k : k + 8], h) == h
    assert len(set(own.values())) == len(own)
    marks = sx.anchors(np.frombuffer(prose(10, 20_000).encode(), np.uint8), np.array([0, 60_000]), sx.Options())
    assert 100 < np.diff(marks.at).mean() < 300


def test_periodic_texts_are_few_rows(spark):
    texts = ["x" * 60_000, "ab" * 20_000 + "c", "q" + "abc" * 9_000, "x" * 420, "ab" * 199 + "a", prose(12, 30)]
    df = documents(spark, texts)
    assert found(df, sx.Options()) == brute([(r["doc_id"], r["text"]) for r in df.collect()], 400)
    shared = spark.createDataFrame([(b"s", t) for t in texts[:3]], "sha binary, text string")
    grams = sx.scan(df.limit(3)).selectExpr("explode(grams) AS g").distinct().agg({"g": "collect_set"}).first()[0]
    rows = sx.entries(shared.selectExpr("sha", "text", f"array({', '.join(f'{g}L' for g in grams)}) AS shared"), sx.Options())
    assert rows.count() < 60 and rows.agg({"times": "sum"}).first()[0] > 60_000
