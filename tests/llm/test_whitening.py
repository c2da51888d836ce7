import numpy as np
import pytest

from readalike.llm import whitening as w
from readalike.llm.queries import op13_embedding_whitening, table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def brute(vectors, wanted=4):
    """Per row of whole numbers: deviation and whitened values, by a dense eigensolver."""
    x = [[int(np.floor(256 * float(e))) for e in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    values, columns = np.linalg.eigh(c.T @ c / n)
    values, columns = values[::-1][:wanted], columns[:, ::-1][:, :wanted]
    rows = np.array(x, np.int64)
    return n, ((n * rows - sums) ** 2).sum(axis=1), (rows - sums / n) @ columns / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(found, ids, vectors):
    n, deviation, white, explained = brute(vectors)
    by = {(r.vec_id, r.component): r for r in found}
    assert len(by) == len(found) == 4 * len(ids)
    for k in range(4):
        mine = np.array([by[i, k + 1].whitened for i in ids])
        sign = np.sign((mine * white[:, k]).sum())
        np.testing.assert_allclose(mine * sign, white[:, k], rtol=0, atol=1e-9)
        for i, dev in zip(ids, deviation, strict=True):
            r = by[i, k + 1]
            assert r.n == n and r.deviation == dev
            assert r.explained == pytest.approx(explained[k], rel=1e-10) and r.identity_error < 1e-10


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_query_equals_a_dense_eigensolver(spark, folder):
    rows = table(spark, folder, "embeddings").collect()
    check(op13_embedding_whitening(spark, folder).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark, store):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((40, 6)).astype(np.float32)
    good[7] = good[3]
    rows = [(i, v.tolist(), 1, "x", "n") for i, v in enumerate(good)]
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1, "x", "n"), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "x", "n"), (102, [nan] * 6, 1, None, "n"),
             (103, [-inf] + [0.0] * 5, 1, "x", "n"), (104, [1.0, 2.0], 1, "x", "n"), (105, [], 1, "x", "n")]
    found = w.whiten(spark.createDataFrame(rows, SCHEMA), store)
    assert found.columns == [c.split()[0] for c in w._OUT.split(", ")]
    check(found.collect(), list(range(40)), good)
    doubled = spark.createDataFrame(rows + rows, SCHEMA)  # repeated rows: the same fit, each row returned
    assert w.whiten(doubled, store).count() == 2 * 4 * 40
    without_id = spark.createDataFrame([(None, r[1], *r[2:]) for r in rows], SCHEMA)
    assert w.whiten(without_id, store).filter("vec_id IS NULL").count() == 160


def test_few_directions_give_few_components(spark, store):
    def white(vectors):
        return w.whiten(spark.createDataFrame([(i, v, 1, "", "") for i, v in enumerate(vectors)], SCHEMA), store).collect()

    assert white([]) == [] and white([[1.0, 2.0]] * 3) == []
    line = white([[float(k), 2.0 * k, 0.0] for k in range(5)])
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)
    plane = white([[float(k), float(k * k), 0.0] + [1.0] * 40 for k in range(9)])
    assert {r.component for r in plane} == {1, 2}


def test_deviation_is_exact_or_null(spark, store):
    big = [[2.0**20, -(2.0**20)], [0.0, 0.5], [2.0**30, 3.0]]
    found = w.whiten(spark.createDataFrame([(i, v, 1, "", "") for i, v in enumerate(big)], SCHEMA), store).collect()
    _, deviation, _, _ = brute([[float(e) for e in v] for v in big[:2]] + [[0.0, 0.0]])
    n, s = 3, [256 * (2**20 + 2**30), 256 * (3 - 2**20) + 128]
    exact = [sum((n * int(np.floor(256 * e)) - t) ** 2 for e, t in zip(v, s, strict=True)) for v in big]
    assert {r.vec_id: r.deviation for r in found} == {i: e if e < 2**63 else None for i, e in enumerate(exact)}


@pytest.mark.parametrize("spectrum", [np.linspace(1, 2, 80), np.ones(80), np.r_[1e6, np.full(79, 1.0)], np.r_[np.zeros(70), np.arange(1, 11.0)]])
def test_iteration_is_certified_for_flat_steep_and_short_spectra(spectrum):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    v = basis @ np.diag(spectrum) @ basis.T
    values, vectors, residual, passes = w.leading(lambda q: v @ q, 80, 4)
    np.testing.assert_allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-9)
    assert residual < 1e-10 and passes < 400
    np.testing.assert_allclose(v @ vectors, vectors * values, atol=1e-9 * spectrum.max())
