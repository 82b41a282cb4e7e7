import hashlib
import math
from collections import Counter

import pytest

from pagelake.operators.sticky import sticky_assign


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def bucket(domain, buckets):
    return int(md5(domain or "")[:8], 16) % buckets


def by_hand(domains, bindings, alive, load, buckets):
    """The same rules with lists and dictionaries."""
    domains = set(domains)
    out = {d: min(p for e, p in bindings if e == d and p in alive) for d in domains if any(e == d and p in alive for e, p in bindings)}
    most = math.ceil(len(domains) * load / len(alive)) if load else len(domains) + 1
    room = {p: most - n for p in alive for n in [Counter(out.values())[p] if load else 0]}
    weights = Counter(bucket(d, buckets) for d in domains if d not in out)
    place = {}
    while weights:
        open_ = [p for p in alive if room[p] > 0]
        asked = {}
        for b in weights:
            asked.setdefault(max((md5(f"{b}:{p}"), p) for p in open_)[1], []).append(b)
        for p, bs in asked.items():
            for b in sorted(bs, key=lambda b: (md5(str(b)), b)):
                if room[p] > 0:
                    room[p] -= weights.pop(b)
                    place[b] = p
    return out | {d: place[bucket(d, buckets)] for d in domains if d not in out}


def assigned(spark, domains, bindings, proxies, **options):
    d = spark.createDataFrame([(x,) for x in domains], "domain string")
    b = spark.createDataFrame(bindings, "domain string, proxy string")
    p = spark.createDataFrame(proxies, "proxy string, fails int")
    rows = sticky_assign(d, b, p, **options).collect()
    assert len(rows) == len({r["domain"] for r in rows})
    return {r["domain"]: r["proxy"] for r in rows}


@pytest.mark.parametrize("load", [None, 1.0, 1.25])
def test_rules(spark, load):
    domains = [f"d{i}" for i in range(120)] + ["d0", "d0", None, ""]
    proxies = [(f"p{i}", 0 if i % 2 else None) for i in range(7)] + [("dead", 3), ("p1", 1), (None, 0), ("late", 0), ("late", 5)]
    bindings = [("d0", "p3"), ("d0", "p2"), ("d1", "dead"), ("d2", "gone"), ("d2", "p4"), ("d3", None), ("other", "p1"), (None, "p5")]
    got = assigned(spark, domains, bindings, proxies, load=load, buckets=64)
    # A null domain has no binding, as nulls equal nothing.
    want = by_hand(domains, [b for b in bindings if b[0] is not None], [f"p{i}" for i in range(7)], load, 64)
    assert got == want and got["d0"] == "p2" and got["d2"] == "p4" and got[None] == got[""]


def test_load_is_bounded(spark):
    domains = [f"d{i}" for i in range(400)]
    bindings = [(f"d{i}", "p0") for i in range(150)]
    got = assigned(spark, domains, bindings, [(f"p{i}", 0) for i in range(5)], buckets=128)
    load, heaviest = Counter(got.values()), max(Counter(bucket(d, 128) for d in domains).values())
    assert load["p0"] == 150 and all(load[f"p{i}"] < 100 + heaviest for i in range(1, 5))


def test_a_lost_proxy_moves_its_own_domains_only(spark):
    domains, proxies = [f"d{i}" for i in range(300)], [(f"p{i}", 0) for i in range(8)]
    before = assigned(spark, domains, [], proxies, load=None)
    fewer = [(p, 3 if p == "p2" else 0) for p, _ in proxies]
    after = assigned(spark, domains, [], fewer, load=None)
    assert {d for d in domains if before[d] != after[d]} == {d for d in domains if before[d] == "p2"} != set()
    bounded = assigned(spark, domains, [], proxies)
    kept = assigned(spark, domains, list(bounded.items()), fewer)
    assert {d for d in domains if bounded[d] != kept[d]} == {d for d in domains if bounded[d] == "p2"}


def test_odd_tables(spark):
    assert assigned(spark, ["a", "b"], [], []) == {"a": None, "b": None}
    assert assigned(spark, [], [("a", "p")], [("p", 0)]) == {}
    assert assigned(spark, ["a"], [("a", "p")], [("p", 0), ("q", 0)]) == {"a": "p"}
    with pytest.raises(ValueError):
        assigned(spark, ["a"], [], [("p", 0)], load=0.5)
