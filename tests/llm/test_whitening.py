import math

import numpy as np
import pytest

from lodewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, components=whitening.COMPONENTS):
    """By exact integers, a centred covariance and the library's eigen-solver."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in fine], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums).astype(float) / n
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    return [i for i, _ in fine], n, deviation, centred @ axes / np.sqrt(e), e / np.trace(cov)


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ np.diag(np.linspace(2, 0.2, dims)) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0] + 0.3
    return [[float(np.float32(c)) for c in row] for row in mixed]


def test_equals_exact_integers_and_a_library_solver(spark):
    rows = [(i, v) for i, v in enumerate(vectors(500, 12))]
    rows += [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (None, rows[0][1]), (5, rows[5][1])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    ids, n, deviation, white, explained = plain(rows)
    assert len(got) == 8 * len(ids) == 8 * 502
    by = {}
    for r in got:
        assert r.n == n and abs(r.identity_error) < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-10
        by.setdefault(r.vec_id, []).append(r)
    sign = {k + 1: np.sign(next(r.whitened for r in by[1] if r.component == k + 1) * white[1][k]) for k in range(8)}
    for place, i in enumerate(ids):
        for r in by[i]:
            assert r.deviation == deviation[place] and abs(r.whitened * sign[r.component] - white[place][r.component - 1]) < 1e-8


@pytest.mark.parametrize("dims", [1, 2, 3, 8, 40])
def test_symmetric_qr(dims):
    rng = np.random.default_rng(dims)
    for a in (rng.normal(size=(dims, dims)), np.diag(np.arange(dims) % 3.0), np.ones((dims, dims)), np.zeros((dims, dims)), 1e8 * np.eye(dims)):
        a = a + a.T
        values, axes = whitening.symmetric_qr(a)
        size = max(np.abs(a).max(), 1)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size * dims)
        assert np.allclose(axes.T @ axes, np.eye(dims), atol=1e-12) and np.allclose(a @ axes, axes * values, atol=1e-11 * size * dims)


def test_merging_states_equals_one_stream():
    rows = np.array(vectors(300, 5)) + 1e5
    one, parts = whitening.State.empty(5), [whitening.State.empty(5) for _ in range(4)]
    for k, r in enumerate(rows):
        one.add(r)
        parts[k % 3].add(r)  # the last stays empty
    total = whitening.State.empty(5)
    for p in parts:
        total.merge(p)
    assert total.n == 300 and np.allclose(total.mean, one.mean, rtol=1e-14) and np.allclose(total.m2, one.m2, rtol=1e-9, atol=1e-7)
    assert np.allclose(total.m2 / 300, np.cov(rows.T, bias=True), rtol=1e-8, atol=1e-10)


def test_many_partitions_are_merged_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 2)
    rows = [(i, v) for i, v in enumerate(vectors(90, 4))]
    many = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()
    _, n, deviation, white, _ = plain(rows)
    assert len(many) == 360 and {(r.vec_id, r.deviation) for r in many} == set(enumerate(deviation))
    assert all(abs(abs(r.whitened) - abs(white[r.vec_id][r.component - 1])) < 1e-9 for r in many)


def test_edge_cases(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 5, "k")], SCHEMA + ", x int, whitened string")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, float(i % 2)]) for i in range(10)], SCHEMA)).collect()
    assert {(r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in same} == {(1, 1.0, 1.0), (2, 0.0, 0.0)}
    short = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [0.0, 1.0]), (3, [])], SCHEMA)).collect()
    assert len(short) == 6 and all(r.n == 3 for r in short)


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [1e9]), (2, [-1e9]), (3, [0.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: None, 2: None, 3: 0}
