import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows):
    """x by row, fit list, sums, eigenvalues and eigenvectors of the covariance, centred before multiplying."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in good})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    a = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in listed])
    e, v = np.linalg.eigh(a.T @ a / n)
    return good, n, sums, e[::-1], v[:, ::-1].T


def held(rows, out, components=16):
    good, n, sums, e, v = brute(rows)
    e_ok = [x for x in e[:components] if x > 1e-9 * e[0]]
    trace = e.sum()
    xs = sorted((str(i), tuple(x)) for i, x in good)
    assert len(out) == len(xs) * len(e_ok)
    by = {}
    for r in out:
        by.setdefault((str(r.vec_id), r.deviation), []).append(r)
        assert r.n == n and r.identity_error <= 1e-4
    signs = {}
    for i, x in xs:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        own = by[(i, deviation)]
        assert {r.component for r in own} == set(range(1, len(e_ok) + 1))
        for r in own:
            k = r.component - 1
            w = sum(float(Fraction(n * c - s, n)) * y for c, s, y in zip(x, sums, v[k])) / math.sqrt(e[k])
            assert r.explained == pytest.approx(e[k] / trace, rel=1e-9)
            if abs(w) > 1e-3:
                signs.setdefault(k, set()).add(math.copysign(1, w * r.whitened))
            assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-5, abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())


def made(seed, n, d, spread):
    """Vectors whose directions have well separated variances."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    x = rng.normal(size=(n, d)) * spread ** np.arange(d) @ basis * 40
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("seed,n,d", [(1, 400, 8), (2, 900, 24), (3, 30, 20)])
def test_whitening_against_the_covariance(spark, seed, n, d):
    rows = made(seed, n, d, 0.8)
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 1, rows[1][1])]
    out = whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)).collect()
    held(rows, out)


def test_query_on_the_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    held(rows, whitening.op13_whitening(spark, sf_dir).collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 5.0]), (2, None), (3, [nan, 1.0, 2.0]), (4, [inf, 0.0, 0.0]), (5, [None, 1.0, 1.0]), (6, [-1.5, 0.25, 3.0]), (7, [0.0, 0.0, 0.0]), (None, [9.0, 1.0, -2.0]), (8, [1.0, 2.0, 5.0]), (9, []), (10, [-4.0, 2.0, 2.5])]
    odd = rows + [(11, [1.0, 2.0]), (12, [3e38, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in odd], SCHEMA).withColumns({c: F.lit(1) for c in ("id", "x", "c", "n", "component", "whitened")})
    held(rows, whitening.whiten(df).collect())
    for few in ([], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        out = whitening.whiten(spark.createDataFrame([(*r, "x") for r in few], SCHEMA))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_no_full_rank(spark):
    base = made(5, 200, 5, 0.7)
    rows = [(i, [*v, v[0], 7.0, v[1]]) for i, v in base]
    out = whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert {r.component for r in out} == {1, 2, 3, 4, 5} and out[0].identity_error <= 1e-4
    held(rows, out)


def test_ill_conditioned_rows_become_orthogonal(spark):
    """A condition beyond what one Cholesky factor of the covariance would bear."""
    rng = np.random.default_rng(3)
    t = rng.normal(size=(500, 1)) * 2e6
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(np.hstack([t, t + rng.normal(size=(500, 1)) * 0.05, rng.normal(size=(500, 1))]))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string")
    out = whitening.whiten(df).collect()
    assert {r.component for r in out} == {1, 2, 3} and out[0].identity_error <= 1e-4


def test_exact_sums_of_large_numbers():
    n, sums = 1 << 30, np.array([(1 << 30) * 1_000_000 + 17, (1 << 30) * 999_990 - 5])
    model = whitening.Whitening(n, sums, np.zeros((0, 2)), np.zeros(0), 0.0, 0)
    x = np.array([[1_000_003, 999_990], [1_000_000 + (1 << 33), 0]])
    expected = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    assert model.deviations(x[:1]) == [expected[0] if expected[0] < 1 << 63 else None]
    assert model.deviations(x) == [v if v < 1 << 63 else None for v in expected]
    assert model.centred(x)[0, 0] == pytest.approx(3 - 17 / n, rel=1e-15)
