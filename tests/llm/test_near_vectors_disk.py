"""What the join of near vectors moves and keeps, and its results over tiles, lots and rounds."""

import os
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from test_joins import classes

from pagelake.llm import near_vectors
from pagelake.llm.components import components


def vectors(n, dim, seed):
    """Unlike vectors in no order that helps, among them two crowds of near copies, and equal ones."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for c in range(2):
        x[r.choice(n, n // 20, replace=False)] = r.normal(size=dim) + r.normal(size=(n // 20, dim)) * 0.1
    x[r.choice(n, n // 10, replace=False)] = x[r.integers(0, n, n // 10)]
    x[r.choice(n, n // 20, replace=False)] = x[0]
    return x.astype(np.float32)


def test_disk_follows_the_table_and_not_the_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "ROUND", 1, raising=False)
    n, dim = 6000, 32
    x = vectors(n, dim, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def held():
        found = (os.path.join(at, f) for folder in folders for at, _, names in os.walk(folder) for f in names if f.startswith("shuffle_"))
        return {f: os.path.getsize(f) for f in found if os.path.exists(f)}

    before, most, over = set(held()), [0], threading.Event()

    def watch():
        while not over.is_set():
            most[0] = max(most[0], sum(v for k, v in held().items() if k not in before))
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert near_vectors.near_vectors(df, block_rows=50).count() == n
    finally:
        time.sleep(0.1)
        over.set()
        watcher.join()
    assert most[0] < 5 * x.nbytes, most


@pytest.mark.parametrize(("kind", "tile", "block_rows"), [("float", 1000, 40), ("float", 3000, 40), ("double", 1 << 20, 30)])
def test_links_over_tiles_and_rounds_like_brute_force(spark, monkeypatch, kind, tile, block_rows):
    monkeypatch.setattr(near_vectors, "ROUND", 1)
    monkeypatch.setattr(near_vectors, "TILE", tile)
    rounds, own, folds, fold = [], near_vectors.block_links, [], near_vectors.folded
    monkeypatch.setattr(near_vectors, "block_links", lambda *a: rounds.append(own(*a)) or rounds[-1])
    monkeypatch.setattr(near_vectors, "folded", lambda spark, parts: folds.append(len(parts)) or fold(spark, parts))
    x = vectors(900, 6, 11)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, block_rows=block_rows).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = classes(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert sum(folds) > len(folds) and len(set(want.values())) > 20
    for i, c in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, c, i == c), i


def test_what_rounds_find_is_folded(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "ROUND", 1)
    monkeypatch.setattr(near_vectors, "TILE", 20 * 3 * 4)
    folds, fold = [], near_vectors.folded
    monkeypatch.setattr(near_vectors, "folded", lambda spark, parts: folds.append(len(parts)) or fold(spark, parts))
    x = np.random.default_rng(2).normal(size=(200, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, block_rows=20).collect()}
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = classes(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    assert len(folds) > 1
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (near[i].sum() - 1, c) for i, c in want.items()}


def test_equal_vectors_have_one_cell_in_any_batch():
    x = vectors(3000, 64, 5)
    axes = np.linalg.qr(np.random.default_rng(1).normal(size=(64, 64)))[0][:, :6]
    sizes = np.full(len(x), 64)
    whole = near_vectors.cells(x.ravel(), sizes, axes, 1e-8)
    for some in (slice(0, 1), slice(7, 10), slice(100, 1101)):
        assert (near_vectors.cells(x[some].ravel(), sizes[some], axes, 1e-8) == whole[some]).all()
    order = sorted(range(len(x)), key=lambda i: whole[i].tobytes())
    assert [whole[i].tolist() for i in order] == sorted(whole.tolist())


def test_neighbours_of_one_hash_become_one():
    t = pa.table({"h1": [1, 1, 1, 2, 2, 3], "h2": [5, 5, 6, 6, 6, 6], "least": pa.array([9, 4, None, None, None, 2], pa.int64()), "copies": [1, 2, 1, 1, 1, 7], "v": list("abcdef")})
    assert near_vectors.merged(t).to_pydict() == {"h1": [1, 1, 2, 3], "h2": [5, 6, 6, 6], "least": [4, None, None, 2], "copies": [3, 1, 2, 7], "v": list("acdf")}


def test_tidy_components_are_the_same(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7] + [(3, 3), (None, 1)], "u long, v long")
    assert sorted(components(links, tidy=True).collect()) == sorted(components(links).collect())
    assert components(links.limit(0), tidy=True).collect() == []
