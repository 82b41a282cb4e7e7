"""Many copies around one base that just link or just do not: joined by what they differ in from a pivot."""

import random

import pytest
from pyspark.sql import functions as F
from test_joins import classes, shingles

from pagelake.llm import shingle_join


def copies(seed, n=90):
    """Copies of a base text that is not among them, some changed alike, some longer or shorter."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(70)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(words))
            words[at] = rng.choice(["x", "y", "z", f"new{rng.randrange(30)}"])
        if rng.random() < 0.3:
            words = words[rng.randrange(4) : len(words) - rng.randrange(4)]
        if rng.random() < 0.2:
            words += [f"tail{rng.randrange(6)}"] * rng.randrange(1, 6)
        out.append(" ".join(words))
    return out + out[:3]


@pytest.mark.parametrize(("seed", "size", "num", "rounds"), [(1, 3, 90, 1), (2, 5, 80, 0), (3, 3, 85, 0), (4, 2, 90, 1)])
def test_links_like_brute_force(docs, seed, size, num, rounds):
    texts = copies(seed)
    sets = [shingles(t, size) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = classes(range(len(texts)), links)
    assert 5 < len(set(want.values())) < len(texts) - 5
    got = shingle_join.near_duplicates(docs(texts), shingle=size, num=num, rounds=rounds, crowd=2 + 6 * rounds).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_every_link_of_different_components_is_a_candidate(spark):
    """The join of differences alone, each copy in a component of its own."""
    texts = copies(5, 60)
    sets = [shingles(t, 3) for t in dict.fromkeys(texts)]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    home = sets[0]
    rows = [(i, 0, len(s), i, [number[x] for x in s ^ home]) for i, s in enumerate(sets) if 2 * len(s ^ home) <= len(s)]
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    # As in the operator, those that link with their home are of its component.
    rows = [(i, h, n, 0 if linked(0, i) else c, d) for i, h, n, c, d in rows]
    near = spark.createDataFrame(rows, "node long, home long, n long, c long, delta array<long>")
    got = {(r["a"], r["b"]) for r in shingle_join.delta_pairs(near, 80, 100).collect()}
    parts = {r[0]: r[3] for r in rows}
    want = {(a, b) for a in parts for b in parts if a < b and parts[a] != parts[b] and linked(a, b)}
    assert want and want <= got and len(got) < len(rows) * (len(rows) - 1) / 2
    assert shingle_join.delta_pairs(near.where(F.lit(False)), 80, 100).collect() == []


def test_a_turn_makes_pairs_as_the_rows_and_all_pairs_are_those_still_apart(spark):
    """A crowd that has one difference in common, in lots first."""
    n = 400
    near = spark.createDataFrame([(i, 0, 100, i, [7, *range(1000 * i, 1000 * i + 19)]) for i in range(n)], "node long, home long, n long, c long, delta array<long>")
    short = shingle_join.delta_prefixes(near, 80, 100).select("home", "elem", "held", F.col("p").withField("pos", F.lit(0)).alias("p"))
    of = near.select("node", "c")
    lots = [shingle_join.delta_candidates(short, of, 80, 100, turn=k).count() for k in range(2)]
    assert all(n / 2 < x < 4 * n for x in lots)
    assert shingle_join.delta_candidates(short, of, 80, 100).count() == n * (n - 1) // 2
    assert shingle_join.delta_candidates(short, of.withColumn("c", F.lit(0)), 80, 100).count() == 0


def test_few_pairs_of_a_crowd_that_links_meet_at_last(docs, monkeypatch):
    """Copies of a base that is not among them: most are in one component before all pairs are made."""
    asked = []
    real = shingle_join.delta_candidates
    monkeypatch.setattr(shingle_join, "delta_candidates", lambda *a, **k: asked.append(k.get("turn")) or real(*a, **k))
    assert len(shingle_join.near_duplicates(docs(copies(2)), shingle=5, num=80, rounds=1, crowd=2).collect()) == 93
    assert asked == [0, None]
