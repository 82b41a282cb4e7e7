"""Admission through stored filters: exact, whatever the filters say."""

import random

from pagelake.sources import seen
from pagelake.sources.seen import SeenUrls


def rows(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "n long, url string")


def test_batches_admit_each_url_once(spark, tmp_path):
    rnd, known = random.Random(1), set()
    for k in range(5):
        store = SeenUrls(spark, str(tmp_path / "s"), slots=4, first_blocks=2)  # so small that filters fill up at once
        urls = [f"http://x.test/{rnd.randrange(400)}" + rnd.choice(["", "#a", "?"]) for _ in range(200)]
        first = {}
        for i, u in enumerate(urls):
            first.setdefault(u.split("#")[0].rstrip("?"), i)
        want = {i for u, i in first.items() if u not in known}
        assert {r["n"] for r in store.admit(rows(spark, urls), "url", ["n"]).collect()} == want, k
        known |= set(first)
    manifest = store.versions.latest()[1]
    assert store.hashes(manifest).distinct().count() == store.hashes(manifest).count() == len(known)
    sizes = [f["blocks"] for f in manifest["filters"]]
    assert len(sizes) > 1 and sizes == sorted(sizes) and sum(f["urls"] for f in manifest["filters"]) == len(known)
    assert store.admit(rows(spark, []), "url", ["n"]).count() == 0


def test_what_the_filters_deny_reads_no_history(spark, tmp_path, monkeypatch):
    store = SeenUrls(spark, str(tmp_path / "s"), slots=8)
    store.admit(rows(spark, [f"http://x.test/{i}" for i in range(2000)]), "url", ["n"])
    read = []
    hashes = SeenUrls.hashes
    monkeypatch.setattr(SeenUrls, "hashes", lambda self, m, slots=None: read.append(slots) or hashes(self, m, slots))
    assert store.admit(rows(spark, ["http://y.test/1", "http://y.test/2"]), "url", ["n"]).count() == 2
    assert read == []
    assert store.admit(rows(spark, ["http://x.test/7", "http://y.test/3"]), "url", ["n"]).count() == 1
    assert len(read) == 1 and len(read[0]) == 1


def test_false_alarms_are_few(spark, tmp_path):
    store = SeenUrls(spark, str(tmp_path / "s"), first_blocks=8)
    store.admit(rows(spark, [f"http://x.test/{i}" for i in range(8000)]), "url", ["n"])
    manifest = store.versions.latest()[1]
    new = spark.range(20_000).selectExpr("md5(cast(id as string)) as url_hash")
    alarms = store.maybe_seen(new, manifest).where("_maybe").count()
    assert manifest["filters"][0]["blocks"] == -(-8000 // seen.URLS_PER_BLOCK) and alarms < 60
