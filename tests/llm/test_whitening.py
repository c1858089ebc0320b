"""Whitening: the solver against numpy, the operator against brute force, odd rows."""

import math

import numpy as np
import pytest

from docledger.llm.whitening import inertia_above, leading, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 40):
        a = rng.standard_normal((size, size))
        yield a @ a.T
        yield a + a.T
    basis = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    yield (basis * np.repeat([9.0, 5.0, 1.0], 8)) @ basis.T  # repeated eigenvalues
    yield (basis * (1 + 1e-9 * np.arange(24))) @ basis.T  # close ones
    yield np.eye(6)
    yield np.diag(np.arange(12.0) % 5)
    yield np.array([[0.0, 1.0], [1.0, 0.0]])  # no 1x1 pivot


@pytest.mark.parametrize("matrix", list(matrices()))
def test_counts_and_eigenvalues_equal_numpy(matrix):
    size, wanted = len(matrix), min(len(matrix), 32)
    values = np.linalg.eigvalsh(matrix)[::-1]
    scale = max(1e-300, np.abs(values).max())
    for shift in np.linspace(values[-1] - 1, values[0] + 1, 17):
        if np.abs(values - shift).min() > 1e-9 * scale:
            assert inertia_above(matrix, float(shift)) == (values > shift).sum()
    found = leading(matrix, 32)
    assert np.allclose(found.values, values[:wanted], rtol=0, atol=1e-12 * scale)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(wanted), atol=1e-12)
    assert np.abs(matrix @ found.vectors - found.vectors * found.values).max() <= 1e-12 * scale * size


def brute(vectors, components=32):
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n), deviation


def test_whitened_rows_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(0.2, 3, 12)).astype(np.float32).tolist()
    rows = whiten(spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], SCHEMA).repartition(5)).collect()
    white, explained, deviation = brute(vectors)
    assert len(rows) == 300 * 12 and len({(r.vec_id, r.component) for r in rows}) == len(rows)
    signs = {}
    for r in rows:
        want = white[r.vec_id, r.component - 1]
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * want))
        assert r.whitened == pytest.approx(sign * want, abs=1e-8)
        assert (r.n, r.deviation) == (300, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9


def test_unsound_vectors_go_and_repeats_count(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (None, [2.0, -1.0], 0), (3, [4.0, 0.5], 0)]
    unsound = [(4, None, 0), (5, [None, 1.0], 0), (6, [nan, 1.0], 0), (7, [1.0, -inf], 0), (8, [], 0), (9, [1.0, 2.0, 3.0], 0), (10, [3e38, 0.0], 0)]
    rows = whiten(spark.createDataFrame(sound + unsound, SCHEMA)).collect()
    assert {r.n for r in rows} == {4} and sorted((str(r.vec_id), r.component) for r in rows) == sorted(
        (str(v), c) for v in (1, 1, None, 3) for c in (1, 2))
    white, _, deviation = brute([v for _, v, _ in sound])
    assert sorted({r.deviation for r in rows}) == sorted(set(deviation))
    assert sorted(abs(r.whitened) for r in rows if r.component == 1) == pytest.approx(sorted(np.abs(white[:, 0])), abs=1e-9)


def test_without_variance_there_are_no_components(spark):
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 5, SCHEMA)).collect() == []
    one = whiten(spark.createDataFrame([(k, [float(k), 2.0], 0) for k in range(5)], SCHEMA)).collect()
    assert {r.component for r in one} == {1} and {r.explained for r in one} == {1.0}
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == []


def test_large_numbers_stay_exact(spark):
    vectors = [[1e9, 0.0], [-1e9, 1.0], [3e15, 5.0]]
    rows = whiten(spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int")).collect()
    exact = brute(vectors)[2]
    assert {r.vec_id: r.deviation for r in rows} == {k: d if d < 2**63 else None for k, d in enumerate(exact)}


def test_clashing_columns(spark):
    base = spark.createDataFrame([(k, [float(k), float(k * k % 5)], 0) for k in range(9)], SCHEMA)
    more = base.selectExpr("*", "1 as _x", "2 as n", "3 as component", "map('a', 1) as whitened", "true as _sound")
    assert sorted(map(tuple, whiten(more).collect())) == sorted(map(tuple, whiten(base).collect()))
