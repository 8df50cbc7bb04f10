import numpy as np
import pytest

from kinloom.llm import embedding_join as ej


def brute(rows, cosine=0.9):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root, links = {i: i for i, _ in rows}, dict.fromkeys(root_ids(rows), 0)
    pairs = [(i, j) for i in ok for j in ok if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= cosine]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return {i: (links[i], root[i], root[i] == i) for i, _ in rows if i is not None}


def root_ids(rows):
    return [i for i, _ in rows]


@pytest.mark.parametrize(("dims", "chunk"), [(64, 4096), (64, 16), (10, 16), (3, 16)])
def test_links_equal_brute_force(spark, dims, chunk):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(12, dims))
    near = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.05, 0.3, 0.45)])
    vectors = [*base, *near, *rng.normal(size=(40, dims)), base[0] * 1e-20, base[1] * 1e20, base[2]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * dims), (902, [float("nan")] * dims), (903, [None] * dims), (904, [1.0] * (dims + 1)), (905, []), (906, [float("inf")] * dims)]
    df = spark.createDataFrame([(*r, "l") for r in rows], "vec_id long, embedding array<double>, n_links string")
    df = df.unionByName(df.filter("vec_id = 3"))
    out = ej.near_vectors(df, ej.Options(chunk=chunk)).collect()
    assert len(out) == len(rows) + 1
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out} == brute(rows)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert ej.near_vectors(df.limit(0)).count() == 0
    assert {(r["vec_id"], r["n_links"]) for r in ej.near_vectors(df).collect()} == {(None, 0), (1, 0)}


def test_rotation_keeps_lengths():
    u = ej.unit(np.random.default_rng(0).normal(size=(20, 50)))
    assert np.allclose(np.linalg.norm(ej.rotated(u), axis=1), 1)


def test_vectors_are_not_shuffled_to_their_partners(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2000, 64)))] + [(5000, [1.0] * 64), (5001, [1.0] * 63 + [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = shuffled()
    found = {r["vec_id"] for r in ej.near_vectors(df, ej.Options(chunk=64)).collect() if r["n_links"]}
    assert found == {5000, 5001}
    assert shuffled() - before < 3 * len(rows) * 64 * 8


def test_components_go_on_from_those_before():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 300, (2, 250))
    assert (ej._roots(300, u[200:], v[200:], ej._roots(300, u[:200], v[:200])) == ej._roots(300, u, v)).all()


@pytest.mark.parametrize(("subspaces", "gathered"), [(1, 1 << 20), (4, 50), (8, 3)])
def test_dense_groups_in_any_subspaces_with_rows_added_up_on_the_way(spark, monkeypatch, subspaces, gathered):
    rng = np.random.default_rng(subspaces)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(rng.normal(size=(4, 16)), 30, axis=0) + rng.normal(size=(120, 16)) * 0.25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ej, "GATHERED", gathered)
    o = ej.Options(chunk=16, subspaces=subspaces)
    held = [(np.frombuffer(r["ids"], np.int64), ej.unit(np.frombuffer(r["data"], np.float64).reshape(-1, 16))) for r in ej.packed(df, o).collect()]
    held = [ej._Chunk(ids, x, ej._sides(x, o)) for ids, x in held]
    parts = [ej._found(a, b, a is b, o) for k, a in enumerate(held) for b in held[k:]]
    ids, n, root = ej._together([ej._together(parts[:20]), *parts[20:]])
    expect = {i: r for i, r in brute(rows).items() if r[0]}
    assert {int(i): (int(c), int(r), i == r) for i, c, r in zip(ids, n, root, strict=True)} == expect
