"""Operators on pairs, beside brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from pagelake.llm import contamination, near_vectors, shingle_join, suffix_dedup
from pagelake.llm.components import components


def classes(nodes, links):
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_components_of_chains_stars_and_circles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = classes({x for p in links for x in p}, links)
    assert all(got.get(i, i) == c for i, c in want.items())
    assert components(df.limit(0)).collect() == []


def test_vectors_link_like_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 8))
    x = [(base[i % 40] + r.normal(size=8) * 0.12).tolist() for i in range(400)]
    x += [x[0]] * 5 + [[2 * v for v in x[1]]]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, x[0][:4]]
    rows = [(i, v, 3, "n") for i, v in enumerate(x + odd)] + [(None, x[0], 3, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n string")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, lead=3, block_rows=50).collect()}
    assert len(got) == len(rows)
    u = np.array(x)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = classes(range(len(rows) - 1), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    copies = {0, *range(400, 405)}
    for i, c in want.items():
        linked = near[i].sum() - 1 + bool(near[i, 0]) if i < len(x) else 0  # one more for the row without an id
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (linked, c, i == c), (i, i in copies)
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert near_vectors.near_vectors(df.limit(0)).collect() == []
    assert [r["n_links"] for r in near_vectors.near_vectors(df.where("embedding is null")).collect()] == [0]


def test_runs_that_may_link_are_not_skipped():
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.argsort(x[:, 0])]
    axes = np.eye(6)[:, :2]
    c = near_vectors.boxes(x, axes)
    eps = np.sqrt(2 - 2 * 0.95)
    seen = np.zeros((700, 700), bool)
    for a, b in near_vectors.join_runs(x, x, c, c, eps):
        seen[a, b] = True
    assert not (~seen & (x @ x.T >= 0.95)).any()


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


@pytest.mark.parametrize(("size", "num", "rounds"), [(3, 90, 1), (5, 80, 0), (2, 50, 2)])
def test_shingle_components_like_brute_force(docs, odd_texts, size, num, rounds):
    r = random.Random(size)
    base = [[f"w{r.randrange(300)}" for _ in range(60)] for _ in range(6)]
    texts = list(odd_texts)
    for k in range(150):
        w = list(base[k % 6])
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        texts.append(" ".join(w[: r.randrange(50, 61)]))
    df = docs([*texts, texts[-1]], ids=[*range(len(texts)), None])
    got = {r["doc_id"]: r for r in shingle_join.near_duplicates(df, shingle=size, num=num, rounds=rounds).collect()}
    sets = [shingles(t, size) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    for i, c in classes(range(len(texts)), links).items():
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), c)
    assert got[None]["component_id"] is None
    kept = shingle_join.one_of_each(df, shingle=size, num=num, rounds=rounds)
    assert kept.columns == df.columns
    assert {x["doc_id"] for x in kept.collect()} == {None} | {i for i, c in classes(range(len(texts)), links).items() if i == c}
    assert shingle_join.near_duplicates(df.limit(0)).collect() == []


def test_rows_that_share_an_id_are_one_node(docs):
    a, b = "a b c d e f g h", "p q r s t u v w"
    got = shingle_join.near_duplicates(docs([a, b, a, b], ids=[4, 4, 2, 3])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(4, 2), (2, 2), (3, 2)} and len(got) == 4


def item_words(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contained_items_are_found(spark, docs, odd_texts):
    r = random.Random(2)
    items = [" ".join(f"i{r.randrange(80)}" for _ in range(n)) for n in (3, 5, 9, 16, 17, 40, 64)] + [None, "", "one"]
    texts = list(odd_texts)
    for k in range(60):
        w = (items[k % 7]).split()
        if len(w) > 8 and k % 3:
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join([f"d{r.randrange(500)}" for _ in range(200)] + [", ".join(w)] + [f"d{r.randrange(500)}" for _ in range(20)]))
    texts += items
    df = docs([*texts, texts[-3]], ids=[*range(len(texts)), None])
    tests = spark.createDataFrame(list(enumerate(items)) + [(None, "a b c d e f")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in contamination.contaminated(df, tests).collect()}

    def sets(text):
        w = item_words(text)
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    own = [sets(t) for t in texts]
    want = {(i, j) for i, d in enumerate(own) for j, t in enumerate(items) if sets(t) and len(d & sets(t)) >= 0.8 * len(sets(t)) - 1e-9}
    assert set(got) == want and len(want) > 40
    clean = contamination.decontaminate(df, tests)
    assert clean.columns == df.columns
    assert {x["doc_id"] for x in clean.collect()} == ({None} | set(range(len(texts)))) - {i for i, _ in want}
    assert contamination.contaminated(df, tests.limit(0)).collect() == []
    assert contamination.contaminated(df.limit(0), tests).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    r = np.random.default_rng(seed)
    for n in (*range(12), 100, 101, 102):
        s = r.integers(1, 2 + seed, n)
        assert suffix_dedup.suffix_order(s, 8).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def without_repeats(rows, width):
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                gone[k : k + width] = [True] * width
            seen.add(b[k : k + width])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall("x+", "".join("x" if g else "." for g in gone)))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("part", [2, 2000])
def test_repeated_bytes_are_removed(docs, odd_texts, part):
    r = random.Random(part)
    passage = "".join(r.choice("abcdefgh ") for _ in range(160))
    texts = odd_texts[:6] + [odd_texts[6][:3000], odd_texts[6][:3000], "z" * 500, "zy" * 300, passage, passage[:99], passage[5:105]]
    for _ in range(30):
        a, b = sorted(r.sample(range(161), 2))
        texts.append("".join(r.choice("abé😀") for _ in range(r.randrange(90))) + passage[a:b] + "".join(r.choice("ab") for _ in range(r.randrange(90))))
    df = docs(texts)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(tuple(x[c] for c in cols) for x in suffix_dedup.remove_repeats(df, part=part).collect())
    assert got == without_repeats(list(enumerate(texts)), 100)
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_repeated_and_null_ids_come_in_a_stated_order(docs):
    r = random.Random(1)
    text = "".join(r.choice("abc") for _ in range(150))
    got = suffix_dedup.remove_repeats(docs([text, text, text], ids=[1, None, 1])).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in got) == [(0, 0), (1, 150), (1, 150)]
