"""Whitening against numpy on the same rows."""

import math

import numpy as np
import pytest

from pagelake.llm import whitening


def plain(rows, components=16):
    """(id, component) -> (n, deviation, whitened without sign, explained), the rows one by one."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in fine), default=0)
    grid = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in fine if len(v) == dim]
    fitted = sorted({x for _, x in grid})
    n = len(fitted)
    sums = [sum(x[j] for x in fitted) for j in range(dim)]
    middle = np.array([[(n * x[j] - sums[j]) / n for j in range(dim)] for x in fitted])
    cov = middle.T @ middle / n if n else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(cov) if n else ([], None)
    out = []
    for i, x in grid:
        away = np.array([(n * x[j] - sums[j]) / n for j in range(dim)])
        for k in range(min(components, dim)):
            e, u = values[::-1][k], vectors[:, ::-1][:, k]
            if e > 1e-10 * values[-1]:
                out.append((i, k + 1, n, sum((n * x[j] - sums[j]) ** 2 for j in range(dim)), abs(away @ u) / math.sqrt(e), e / np.trace(cov)))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, no long, h long, w double")


def check(spark, rows, **how):
    found = whitening.whiten(table(spark, rows), **how).collect()
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in found), key=repr)
    want = plain(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose(sorted(g[4] for g in got), sorted(w[4] for w in want), rtol=1e-6, atol=1e-7)
    by_row = {w[:2]: w for w in want if w[0] is not None}
    for g in got:
        if g[0] is not None and sum(w[:2] == g[:2] for w in want) == 1:
            assert np.allclose(g[4:], by_row[g[:2]][4:], rtol=1e-6, atol=1e-7)
    assert all(r["identity_error"] <= 1e-4 for r in found) and len({r["identity_error"] for r in found}) <= 1
    return found


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) * np.linspace(3, 0.5, dim)).astype("f4").tolist()


def test_rows_equal_numpy(spark):
    check(spark, list(enumerate(vectors(300, 20))))


def test_many_blocks_give_the_same(spark):
    check(spark, list(enumerate(vectors(200, 6))), rows_per_block=8)


def test_odd_rows(spark):
    rows = list(enumerate(vectors(40, 5)))
    odd = [(100, None), (101, []), (102, [None, 1.0, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0, 2.0])]
    again = [(0, rows[0][1]), (7, rows[3][1]), (None, rows[4][1]), (7, [9.0, 8.0, 7.0, 6.0, 5.0])]
    found = check(spark, rows + odd + again)
    assert {r["n"] for r in found} == {41}
    assert not {r["vec_id"] for r in found} & {100, 101, 102, 103, 104, 105}


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]
    assert {r["component"] for r in check(spark, rows)} == {1}


def test_a_third_of_the_rows_alike(spark):
    many = vectors(60, 4)
    check(spark, [*enumerate(many), *[(1000 + i, many[0]) for i in range(40)]])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None)], [(1, [1.0, 1.0]), (2, [1.0, 1.0])]])
def test_nothing_to_fit(spark, rows):
    found = whitening.whiten(table(spark, rows))
    assert found.collect() == [] and [f.name for f in found.schema] == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]


def test_values_beyond_a_long(spark):
    found = whitening.whiten(table(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e13, 5.0]), (4, [1e30, 1.0])])).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3} and all(r["deviation"] is None for r in found)
