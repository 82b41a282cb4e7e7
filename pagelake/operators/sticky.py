"""A proxy for every domain, kept as long as it lives.

Domains are hashed into a fixed number of buckets, and a bucket ranks the live proxies by the
hash of (bucket, proxy): rendezvous hashing, so that a lost proxy moves its own domains and no
others.  Buckets, not domains, are held against proxies, so the work is one count of the domains
and ``buckets`` scores a proxy; scores are reduced to one per bucket before they are shuffled.

With ``load`` a proxy takes buckets until it has ``load`` times the mean number of domains.  A
bucket whose proxy is full asks the best of those that are not, in the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import cut

BUCKETS = 4096


def bucket_of(domain: Column | str, buckets: int = BUCKETS) -> Column:
    """The bucket of a domain, a null domain as the empty one."""
    domain = F.col(domain) if isinstance(domain, str) else domain
    digest = F.md5(F.coalesce(domain, F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def rank_of(bucket: Column | str, proxy: Column | str) -> Column:
    """What a proxy is ranked by in a bucket; the largest wins."""
    return F.md5(F.concat_ws(":", F.col(bucket).cast("string") if isinstance(bucket, str) else bucket.cast("string"), proxy))


def best_proxies(proxies: DataFrame, wanted: list[int]) -> DataFrame:
    """(bucket, proxy): the highest ranked proxy of each wanted bucket."""
    scored = proxies.select("proxy", F.explode(F.lit(wanted)).alias("bucket"))
    best = F.max(F.struct(rank_of("bucket", "proxy").alias("rank"), "proxy"))
    return scored.groupBy("bucket").agg(best.alias("best")).select("bucket", "best.proxy")


def place_buckets(weights: DataFrame, rooms: DataFrame) -> DataFrame:
    """(bucket, proxy) for ``weights(bucket, n)`` and ``rooms(proxy, room)``.

    A proxy takes the buckets that choose it in the order of their hashes while it has room
    left, so it goes over by less than one bucket.  Whoever is turned away finds that proxy
    full, hence every round fills a proxy or is the last one.
    """
    order = Window.partitionBy("proxy").orderBy(F.md5(F.col("bucket").cast("string")), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    weights, rooms = cut(weights), cut(rooms.where("room > 0"))
    wanted, taken = [r["bucket"] for r in weights.select("bucket").collect()], []  # at most one entry a bucket
    while wanted:
        asked = best_proxies(rooms, wanted).join(weights, "bucket").join(rooms, "proxy")
        tried = cut(asked.withColumn("fits", F.coalesce(F.sum("n").over(order), F.lit(0)) < F.col("room")))
        taken.append(tried.where("fits").select("bucket", "proxy"))
        used = tried.where("fits").groupBy("proxy").agg(F.sum("n").alias("used"))
        wanted = [r["bucket"] for r in tried.where("not fits").select("bucket").collect()]
        if wanted:
            left = F.col("room") - F.coalesce("used", F.lit(0))
            rooms = cut(rooms.join(used, "proxy", "left").select("proxy", left.alias("room")).where("room > 0"))
    placed = taken[0]
    for more in taken[1:]:
        placed = placed.unionByName(more)
    return placed


def sticky_assign(domains: DataFrame, bindings: DataFrame, proxies: DataFrame, max_fail: int = 3,
                  load: float | None = 1.25, buckets: int = BUCKETS) -> DataFrame:
    """(domain, proxy) of every distinct domain: the bound proxy while it lives, else one by hash.

    ``domains(domain)``, ``bindings(domain, proxy)``, ``proxies(proxy, fails)``; a proxy lives
    while it has fewer than ``max_fail`` failures in each of its rows (null: none).  Of several
    live proxies bound to a domain the least counts.  Bound domains count as load but are never
    moved.  ``load`` bounds the domains of a proxy to that multiple of the mean, plus less than
    one bucket (None: no bound); it is at least 1.  Without live proxies all proxies are null.
    Nothing depends on chance or on the order of rows.
    """
    if load is not None and load < 1:
        raise ValueError("load is at least 1")
    state = proxies.where("proxy is not null").groupBy("proxy").agg(F.max(F.coalesce("fails", F.lit(0))).alias("fails"))
    alive = cut(state.where(F.col("fails") < max_fail).select("proxy"))
    bound = bindings.join(alive, "proxy", "left_semi").groupBy("domain").agg(F.min("proxy").alias("_bound"))
    wanted = cut(domains.select("domain").distinct().join(bound, "domain", "left").withColumn("_bucket", bucket_of("domain", buckets)))
    n = alive.count()
    if not n:
        return wanted.select("domain", F.lit(None).cast("string").alias("proxy"))
    free = wanted.where("_bound is null")
    weights = free.groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"))
    if load is None:
        rooms = alive.withColumn("room", F.lit(wanted.count() + 1))
    else:
        most = F.lit(-(-wanted.count() * load // n)).cast("bigint")
        held = wanted.groupBy(F.col("_bound").alias("proxy")).agg(F.count("*").alias("held"))
        rooms = alive.join(held, "proxy", "left").select("proxy", (most - F.coalesce("held", F.lit(0))).alias("room"))
    if not free.take(1):
        return wanted.select("domain", F.col("_bound").alias("proxy"))
    placed = place_buckets(weights, rooms).select(F.col("bucket").alias("_bucket"), "proxy")
    # One row a bucket at most, whatever the domains, so it may go to every task.
    return wanted.join(F.broadcast(placed), "_bucket", "left").select("domain", F.coalesce("_bound", "proxy").alias("proxy"))
