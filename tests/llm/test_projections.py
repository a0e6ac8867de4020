"""Projections at many rows: no bound on depth, recall at the threshold, windows over sorted lines."""

import numpy as np
import pytest

from wattgrid.llm.vector_dedup import PROJECTIONS, RECALL, Projections, _pairs, link_vectors


def pairs_at(threshold, n, dims, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, n, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, threshold * a + np.sqrt(1 - threshold**2) * b


@pytest.mark.parametrize("rows", [10**4, 10**5, 10**6, 10**8, 10**10])
def test_pairs_at_the_threshold_are_found(rows):
    a, b = pairs_at(0.98, 20_000, 64)
    p = Projections(64, rows, 0.98)
    qa, qb = p.project(a), p.project(b)
    enough = (np.abs(qa - qb) <= p.half)[:, :PROJECTIONS].sum(1) >= p.need
    met = np.zeros(len(a), bool)
    for k in range(p.sets):
        x, y = p.leads(qa, k), p.leads(qb, k)
        met |= ((p.cells(x - p.half) <= p.cells(y)) & (p.cells(y) <= p.cells(x + p.half))).all(1)
    assert RECALL <= p.recall() <= (met & enough).mean() + 0.002 and p.deep * p.sets <= p.directions.shape[1]


def test_work_grows_slower_than_the_rows():
    work = [rows / 2 ** (d := Projections(64, rows, 0.98).deep) + 200 * 1.5**d for rows in (10**5, 10**7, 10**9)]
    assert work[1] < 8 * work[0] and work[2] < 8 * work[1]  # for a hundred times the rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_deep_cells_in_spark(spark, monkeypatch, kind):
    monkeypatch.setattr("wattgrid.llm.vector_dedup.COPY_COST", 0.01)
    assert Projections(32, 1000, 0.98).deep > 4
    a, b = pairs_at(0.9805, 200, 32, 3)
    c, d = pairs_at(0.9795, 200, 32, 4)
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*a, *b, *c, *d])]
    got = {r.vec_id: r.n_links for r in link_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()}
    assert sum(got[i] == got[i + 200] == 1 for i in range(200)) >= 190 and not any(got[i] for i in range(400, 800))


def test_doubles_are_not_narrowed(spark):
    x = np.zeros(8)
    x[0] = 1.0
    t = 0.98 + 1e-9
    y = np.array([t, np.sqrt(1 - t * t), 0, 0, 0, 0, 0, 0])
    z = np.array([0.98 - 1e-9, -np.sqrt(1 - (0.98 - 1e-9) ** 2), 0, 0, 0, 0, 0, 0])
    rows = [(1, x.tolist(), 1), (2, y.tolist(), 1), (3, z.tolist(), 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_windows_count_as_differences_do():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 16))
    x[250:] = x[:250] + rng.normal(0, 0.05, (250, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    role, cid = rng.integers(0, 2, 500), rng.permutation(500)
    p = Projections(16, 500, 0.98)
    q = p.project(unit)
    cells = [p.cells(p.leads(q - s, 0)) for s in (p.half, 0, -p.half)]
    want = set()
    for i in np.flatnonzero(role == 1):
        for j in np.flatnonzero(role == 0):
            near = (np.abs(q[i] - q[j]) <= p.half)[:PROJECTIONS].sum() >= p.need
            if cid[i] < cid[j] and near and ((cells[0][i] <= cells[1][j]) & (cells[1][j] <= cells[2][i])).all() and unit[i] @ unit[j] >= 0.98:
                want.add((i, j))
    got = {(i, j) for x, y in _pairs(role, cid, unit, 0, p, 0.98) for i, j in zip(x.tolist(), y.tolist())}
    assert got == want and len(want) > 20


def test_very_large_and_small_components(spark):
    """Squares of these components vanish or overflow in double precision; cosines are those of any other scale."""
    base = [(0, [1.0, 1.0]), (1, [1.0, 1.0000001]), (2, [1.0, 2.0]), (3, [3.0, -1.0])]
    rows = [(10 * k + i, [x * scale for x in v], k) for k, scale in enumerate((1.0, 1e-200, 1e200, 1e307, 5e-324 * 2**40)) for i, v in base]
    got = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: ((1, i - i % 10) if i % 10 < 2 else (0, i)) for i, _, _ in rows}
