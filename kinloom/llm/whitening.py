"""Whitening of embeddings by upper-triangle column aggregates.

Every entry c of a vector becomes the integer floor(64 c) + 1000000. One aggregation holds a generated SQL expression for
each pair of dimensions, the sum of the products of both after a whole number next to the mean is taken off each. These
sums are exact, so that the covariance is that of exact arithmetic, rounded once, and reruns agree to the last bit. LAPACK
(``numpy.linalg.eigh``) decomposes it on the driver, which never holds more than one row of sums; a projection with the
eigenvectors as literals whitens the rows where they lie. A vector with many copies counts once: copies are combined in
each task before the shuffle.

Expressions grow with the square of the dimensions (2,080 for 64). Beyond ``Options.pairs`` they are dealt over several
aggregations of the same table.

Edge cases: vectors that are null, empty or hold null or non-finite entries are dropped, and so are those whose length is
not the most frequent one (the larger of two). Entries whose integers would not fit 53 bits are no numbers in this sense
either: their vectors are dropped. A component needs an eigenvalue above ``Options.least`` of the largest; below that its
digits are noise, and it is left out. Without any component (no row, or all rows alike) the result is empty. ``deviation``
is null where it does not fit 64 bits. Null and repeated vec_ids and repeated rows give a result each; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import written

SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Options:
    #: Components that are returned at most.
    components: int = 16
    #: Pairs of dimensions in one aggregation at most.
    pairs: int = 4096
    #: Least eigenvalue, as a share of the largest.
    least: float = 1e-11


@dataclass(frozen=True)
class Whitening:
    """Mean, eigenvalues and unit eigenvectors (columns) of integer vectors; n and sums of the list they were fitted on."""

    n: int
    sums: tuple[int, ...]
    lows: tuple[int, ...]
    highs: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def integers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the usable vectors as integers."""
    v = F.col(column).cast("array<double>")
    good = F.forall(v, lambda c: F.coalesce(F.abs(c) < 2.0**46, F.lit(False)))  # a NaN is larger than any number
    kept = rows.select("vec_id", v.alias("v")).filter(F.coalesce(good, F.lit(False)) & (F.size("v") > 0))
    kept = kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("bigint")).alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.filter(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _chunks(items: list, size: int) -> Iterator[list]:
    for k in range(0, len(items), size):
        yield items[k : k + size]


def _columns(rows: DataFrame, d: int) -> DataFrame:
    return rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(d)])


def fit(vectors: DataFrame, opts: Options = Options()) -> Whitening | None:
    """Fit on ``vectors`` (x: distinct integer vectors of one length); None if there is no component."""
    first = vectors.limit(1).collect()
    if not first:
        return None
    d = len(first[0]["x"])
    table = _columns(vectors, d)
    sides = [f"{f}(x{i}) AS {f}{i}" for i in range(d) for f in ("min", "max")]
    sums = [f"sum(CAST(x{i} AS DECIMAL(20,0))) AS s{i}" for i in range(d)]
    got = table.selectExpr("count(*) AS n", *sums, *sides).collect()[0]
    n, s = got["n"], [int(got[f"s{i}"]) for i in range(d)]
    lows, highs = [got[f"min{i}"] for i in range(d)], [got[f"max{i}"] for i in range(d)]
    centre = [v // n for v in s]
    reach = max(max(h - c, c - l) for h, l, c in zip(highs, lows, centre, strict=True))
    kind = "BIGINT" if n * reach * reach < 2**63 else "DECIMAL(18,0)" if reach < 10**18 else None
    assert kind is not None  # integers() lets none through that are longer
    products: dict[tuple[int, int], int] = {}
    for part in _chunks(_pairs(d), opts.pairs):
        term = lambda i: f"CAST(x{i} - {centre[i]}L AS {kind})"
        row = table.selectExpr(*[f"sum({term(i)} * {term(j)}) AS p{i}_{j}" for i, j in part]).collect()[0]
        products |= {(i, j): int(row[f"p{i}_{j}"]) for i, j in part}
    rest = [v - n * c for v, c in zip(s, centre, strict=True)]  # what the centre leaves of each sum: at least 0, below n
    v = np.zeros((d, d))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)  # whole numbers, so rounded once
    values, unit = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, unit = values[order], unit[:, order]
    keep = (values > 0) & (values > opts.least * max(values[0], 0))
    keep[opts.components :] = False
    if not keep.any():
        return None
    unit = unit[:, keep]
    top = np.abs(unit).argmax(axis=0)
    unit = unit * np.where(unit[top, np.arange(unit.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
    return Whitening(n, tuple(s), tuple(lows), tuple(highs), float(np.trace(v)), values[keep], unit)


def _numbers(values: Iterable, kind: str) -> str:
    """An array of constants in SQL; one literal, once Spark has folded it."""
    return "array(" + ", ".join(f"{v!r}{kind}" for v in values) + ")"


def centred(w: Whitening) -> Column:
    """A row's ``x`` less the mean: whole part first, so that no digit is lost."""
    whole, part = zip(*(divmod(v, w.n) for v in w.sums), strict=True)
    return F.expr(f"zip_with(zip_with(x, {_numbers(whole, 'L')}, (a, b) -> a - b), {_numbers((p / w.n for p in part), 'D')}, (a, b) -> a - b)")


def projections(w: Whitening, row: str = "c") -> list[str]:
    """A SQL expression for each component: the centred row projected and divided by the deviation along it."""
    weights = (w.vectors / np.sqrt(w.values)).T.tolist()
    return [f"aggregate(zip_with({row}, {_numbers(each, 'D')}, (a, b) -> a * b), 0D, (s, v) -> s + v)" for each in weights]


def deviation(w: Whitening) -> Column:
    """Sum over dimensions of (n x - S)^2 of a row's ``x``, in whole numbers."""
    most = max(max(w.n * h - s, s - w.n * l) for h, l, s in zip(w.highs, w.lows, w.sums, strict=True))
    if len(w.sums) * most * most < 2**63:
        return F.expr(f"aggregate(zip_with(x, {_numbers(w.sums, 'L')}, (a, b) -> ({w.n}L * a - b) * ({w.n}L * a - b)), 0L, (s, v) -> s + v)")
    sums = "array(" + ", ".join(f"CAST({s} AS DECIMAL(38,0))" for s in w.sums) + ")"
    apart = f"zip_with(x, {sums}, (a, b) -> CAST({w.n} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(18,0)) - b)"
    # a difference of 11 digits or more has a square beyond 64 bits
    square = f"transform({apart}, v -> CAST(CAST(v AS DECIMAL(11,0)) * CAST(v AS DECIMAL(11,0)) AS DECIMAL(38,0)))"
    total = f"aggregate({square}, CAST(0 AS DECIMAL(38,0)), (s, v) -> CAST(s + v AS DECIMAL(38,0)))"
    return F.expr(f"CASE WHEN forall({apart}, v -> abs(v) < 10000000000) THEN try_cast({total} AS BIGINT) END")


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry, in absolute value, of the covariance of whitened ``vectors`` minus the identity, as measured on them."""
    k = len(w.values)
    table = vectors.select(centred(w).alias("c")).selectExpr(*[f"{p} AS w{c}" for c, p in enumerate(projections(w))])
    means = table.selectExpr(*[f"avg(w{c})" for c in range(k)]).collect()[0]
    worst = 0.0
    pairs = _pairs(k)
    row = table.selectExpr(*[f"sum((w{i} - {float(means[i])!r}D) * (w{j} - {float(means[j])!r}D))" for i, j in pairs]).collect()[0]
    for (i, j), v in zip(pairs, row, strict=True):
        worst = max(worst, abs(v / w.n - (i == j)))
    return worst


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, ``deviation`` and ``parts`` of (vec_id, x): component, whitened and explained for every component."""
    parts = [
        F.struct(F.lit(c + 1).alias("component"), F.expr(p).alias("whitened"), F.lit(float(e) / w.trace).alias("explained"))
        for c, (p, e) in enumerate(zip(projections(w), w.values, strict=True))
    ]
    return rows.select("vec_id", "x", centred(w).alias("c")).select("vec_id", deviation(w).alias("deviation"), F.array(*parts).alias("parts"))


def whitened_rows(rows: DataFrame, opts: Options = Options()) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    usable = integers(rows)
    vectors = written(usable.select("x").distinct(), "whitening-fit")
    w = fit(vectors, opts)
    if w is None:
        kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], kind)
    error = identity_error(vectors, w)
    return whiten(usable, w).select("vec_id", "deviation", F.inline("parts")).select(
        "vec_id", "component", F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )
