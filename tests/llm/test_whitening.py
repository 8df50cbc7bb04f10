import numpy as np
import pytest

from kinloom.llm import whitening as wh


def brute(rows, most=16):
    ok = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in ok]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    c = np.array(fit, dtype=np.float64) - np.array(sums) / n
    values, unit = np.linalg.eigh(c.T @ c / n)
    values, unit = values[::-1], unit[:, ::-1]
    out = {}
    for i, x in xs:
        w = (np.array(x, dtype=np.float64) - np.array(sums) / n) @ unit / np.sqrt(values)
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(min(most, d)):
            out[i, k + 1] = (n, dev, abs(w[k]), values[k] / values.sum())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "l", "x") for i, v in rows], "vec_id long, embedding array<double>, label string, component string")


@pytest.mark.parametrize(("dims", "pairs"), [(5, 4), (20, 4096)])
def test_equal_to_brute_force(spark, dims, pairs):
    rng = np.random.default_rng(dims)
    rows = [(k, [float(c) for c in rng.normal(size=dims) * (1 + np.arange(dims))]) for k in range(60)]
    rows += [(100, rows[0][1]), (101, None), (102, [float("nan")] * dims), (103, [1.0] * (dims - 1) + [None]), (104, [float("inf")] * dims), (105, [])]
    out = wh.whitened_rows(frame(spark, rows), wh.Options(pairs=pairs)).collect()
    want = brute(rows)
    assert {(r["vec_id"], r["component"]) for r in out} == set(want)
    for r in out:
        n, dev, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(abs(r["whitened"]) - w) < 1e-9
        assert abs(r["explained"] / share - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    signs = {}
    for r in out:  # copies get the same numbers, sign and all
        if r["vec_id"] in (0, 100):
            assert signs.setdefault(r["component"], r["whitened"]) == r["whitened"]


def test_far_from_zero_loses_no_digit(spark):
    rows = [(k, [1e9 + k % 7, -1e9 + (k * k) % 5, float(k % 3)]) for k in range(40)]
    out = wh.whitened_rows(frame(spark, rows)).collect()
    want = brute(rows)
    assert all(abs(abs(r["whitened"]) - want[r["vec_id"], r["component"]][2]) < 1e-6 for r in out)
    assert max(r["identity_error"] for r in out) < 1e-9


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(k, [1e12 * (k % 2), float(k)]) for k in range(6)]
    out = wh.whitened_rows(frame(spark, rows)).collect()
    assert {r["deviation"] for r in out} == {None}
    near = [(k, [1e7 * (k % 2), float(k)]) for k in range(6)]
    assert {(r["vec_id"], r["deviation"]) for r in wh.whitened_rows(frame(spark, near)).collect()} == {(i, v[1]) for (i, _), v in brute(near).items()}


def test_flat_dimensions_have_no_component(spark):
    rows = [(k, [float(k % 5), 2.0 * (k % 5), 3.0]) for k in range(20)]
    out = wh.whitened_rows(frame(spark, rows)).collect()
    assert {r["component"] for r in out} == {1}
    assert wh.whitened_rows(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_empty_table_other_lengths_and_null_ids(spark):
    rows = [(None, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [5.0, 5.0, 5.0]), (3, [1e300, 0.0])]
    df = frame(spark, rows)
    assert wh.whitened_rows(df.limit(0)).count() == 0
    assert sorted((str(r["vec_id"]), r["n"]) for r in wh.whitened_rows(df).collect()) == [("1", 2), ("1", 2), ("None", 2)]
