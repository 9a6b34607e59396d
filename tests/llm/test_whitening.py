import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavelake.llm.whitening import bidiagonal, op11_whitening, principal_axes, right_directions, singular_values, twisted_vector, whiten


def brute(rows, most=16):
    """By the definition, over one covariance matrix: {id: [(deviation, |whitened| by component)]}, explained."""
    fit = np.array(sorted({tuple(x) for _, x in rows}), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    out = []
    for i, x in rows:
        dev = n * np.array(x, object) - sums
        out.append((i, int((dev**2).sum()), np.abs((dev / n).astype(float) @ vectors[:, order] / np.sqrt(values[order]))))
    return n, out, values[order] / np.trace(cov)


def test_whole_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, [math.floor(64 * c) + 1_000_000 for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want, explained = brute(rows)
    got = {(r.vec_id, r.component): r for r in op11_whitening(spark, sf).collect()}
    assert len(got) == 16 * len(rows)
    for i, deviation, whitened in want:
        for c in range(16):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - whitened[c]) < 1e-6
            assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9
    signs = np.array([[got[i, c + 1].whitened for c in range(16)] for i, _, _ in want])
    assert np.abs(np.cov(signs.T, bias=True) - np.eye(16)).max() < 1e-2


@pytest.mark.parametrize("kind", ["plain", "graded", "twins", "low rank", "constant", "diagonal", "one", "zero"])
def test_axes_against_the_definition(kind):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 20))
    if kind == "graded":
        a *= 10.0 ** -np.arange(20)
    if kind == "twins":
        u, v = (np.linalg.qr(rng.normal(size=(20, 20)))[0] for _ in range(2))
        a = u @ np.diag([9, 9, 9, 4, 4, 1, 1, 1, 1, 1, *[0.5] * 10]) @ v
    if kind == "low rank":
        a = a[:, :3] @ a[:3]
    if kind == "constant":
        a[:, 4:9] = 0
    if kind == "diagonal":
        a = np.diag(np.arange(20) // 2 * 1.0)
    if kind == "one":
        a = a[:1, :1]
    if kind == "zero":
        a *= 0
    values, axes = principal_axes(a)
    want = np.linalg.svd(a)[1]
    assert np.abs(values - want).max() <= 1e-13 * max(1, want[0])
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-9
    assert np.abs(a.T @ (a @ axes) - axes * values**2).max() < 1e-9 * max(1, want[0] ** 2)


def test_small_singular_values_keep_their_digits():
    """A graded bidiagonal matrix, whose values can be had exactly from its inverse: the least are right to many digits."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    q, e = [10.0**-k for k in range(0, 24, 2)], [10.0 ** -(k + 1) / 3 for k in range(0, 22, 2)]
    got = singular_values(np.array(q), np.array(e))
    product = Decimal(1)
    for x in got:
        product *= Decimal(float(x))
    want = Decimal(1)
    for x in q:
        want *= Decimal(x)
    assert abs(product / want - 1) < Decimal("1e-13")  # the product of all values is that of the diagonal
    inverse = np.linalg.inv(np.diag(q) + np.diag(e, 1))
    assert abs(1 / np.linalg.norm(inverse, 2) / got[-1] - 1) < 1e-12


def test_bidiagonal_form_and_twisted_vectors():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(12, 12))
    diagonal, above, v = bidiagonal(a)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.abs(v.T @ a.T @ a @ v - b.T @ b).max() < 1e-12 and np.abs(v.T @ v - np.eye(12)).max() < 1e-13
    values, z = right_directions(diagonal, above)
    for k in range(12):
        one = twisted_vector(diagonal, above, values[k] ** 2)
        assert np.abs(b.T @ (b @ one) - values[k] ** 2 * one).max() < 1e-12 and abs(abs(one @ z[:, k]) - 1) < 1e-12


SCHEMA = "vec_id long, x array<long>, component string, id string, n string"


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i if i else None, [int(v) for v in rng.integers(-50, 50, 4)] + [7]) for i in range(40)]
    rows += [(100, rows[1][1]), (100, rows[1][1]), (1, rows[2][1])]
    df = spark.createDataFrame([(i, x, "a", "b", "c") for i, x in [*rows, (5, None), (6, []), (7, [1, 2])]], SCHEMA)
    n, want, explained = brute(rows, 4)
    got = whiten(df.repartition(40)).collect()  # more tasks than one combining task takes
    assert sorted({r.component for r in got}) == [1, 2, 3, 4] and len(got) == 4 * len(rows) and n == 40
    key = lambda i, d, w, c: (i or -1, d, c, round(float(w), 6))
    assert sorted(key(r.vec_id, r.deviation, abs(r.whitened), r.component) for r in got) == sorted(key(i, d, w[c], c + 1) for i, d, w in want for c in range(4))
    assert max(r.identity_error for r in got) < 1e-12
    assert whiten(df.where("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(df.where("false")).count() == whiten(df.where("vec_id = 100")).count() == whiten(df.where("x is null")).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(1, [2**40, 0]), (2, [-(2**40), 3]), (3, [5, 2**41])]
    got = {r.vec_id: r.deviation for r in whiten(spark.createDataFrame(rows, "vec_id long, x array<long>")).collect()}
    sums = [sum(x[k] for _, x in rows) for k in range(2)]
    assert got == {i: min(2**63 - 1, sum((3 * v - s) ** 2 for v, s in zip(x, sums))) for i, x in rows}


def test_null_and_infinite_entries_are_left_out(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, [1.5, -2.0]), (3, [0.25, 4.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, None), (7, [inf, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.vec_id for r in op11_whitening(spark, str(tmp_path)).collect()} == {1, 2, 3}
