"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles.  Shingles are put in one global order, rare ones
first: their frequencies are counted over all documents in a fixed number of hash slots, and
ties go by hash.  Two sets with a Jaccard similarity of at least num/den must share k of
their first ``n - ceil(n * num / den) + k`` shingles (or all that they have in common, where
that is less), for any k.  Sets of sizes n and m have ``o = ceil((n + m) * num / (num + den))``
shingles in common, so that for the pair the first ``n - o + k`` and ``m - o + k`` will do.

1. Documents with equal sets become one class.
2. Classes with the same prefix and size become one group.  Groups that share fewer than k
   prefix shingles with any others are out; the rest is joined on prefix shingles, with
   bounds from size and position, and pairs sharing fewer than k are dropped.
3. Surviving pairs of groups are expanded to pairs of classes and verified on the whole sets.

Only components are asked for, so a pair inside a component that is known already need not be
verified.  The join therefore runs in rounds: first every group that shares a shingle is
paired with one pivot of that shingle (as many pairs as rows, however hot the shingle), and
classes with the first of their group.  After that, pairs that are still in different
components are paired with another pivot, and at last all that remain, so that no link is
missed.  Thousands of near copies that just do not link would then meet in all pairs; so
classes near one pivot are joined on the shingles by which they differ from it instead, which
is a prefix join of much smaller sets with rarer members, first in small lots of those that
share a difference, then in all pairs that are still apart.

Words are separated by ASCII white space, A-Z lower-cased.  With fewer words than a shingle
has, the whole sequence is the one shingle; null texts and texts without words have an empty
set and link with nothing.  Every row gives one row.  Rows that share a doc_id are one node;
a row with a null id links with nothing and has a null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from pagelake.llm.common import as_bytes, blocks, forget, kept, kept_by, mix, small_batches, text_column
from pagelake.llm.components import components

_A = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = mix(s * _A + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def slot_ranks(rows: DataFrame, size: int, bits: int) -> np.ndarray:
    """How often shingles of each slot occur, over all documents; the table has 2**bits entries."""
    mask = np.uint64((1 << bits) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in blocks(batches, "text"):
            for text in as_bytes(batch.column("text")):
                s = shingle_set(text, size)
                total += np.bincount((s & mask).astype(np.int64), minlength=1 << bits) if len(s) > 4096 else 0
                if 0 < len(s) <= 4096:
                    slots, n = np.unique(s & mask, return_counts=True)
                    total[slots.astype(np.int64)] += n
        slots = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "n": pa.array(total[slots], pa.int64())})

    counts = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[counts["slot"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def with_prefixes(rows: DataFrame, size: int, num: int, den: int, common: int, bits: int) -> DataFrame:
    """doc_id, text_hash, n, digest of the set and its prefix of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(slot_ranks(rows, size, bits))
    mask = np.uint64((1 << bits) - 1)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in blocks(batches, "text"):
            ns, digests, prefixes = [], [], []
            for text in as_bytes(batch.column("text")):
                s = shingle_set(text, size)
                ns.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()))
                keep = len(s) - -(-num * len(s) // den) + common if len(s) else 0
                prefixes.append(s[np.lexsort((s, ranks[(s & mask).astype(np.int64)]))[:keep]].view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": ns, "digest": digests, "prefix": prefixes}, schema=schema)

    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, prefix array<long>")


def texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, digest, text) of some classes; nodes has node, digest, doc_id and text_hash.

    A row gives the text of the one class that names its id and text, whatever other rows share the id.
    """
    return rows.join(nodes.select("node", "digest", "doc_id", "text_hash"), ["doc_id", "text_hash"]).select("node", "digest", "text")


def side(texts: DataFrame, node: str, name: str) -> DataFrame:
    """The texts as one side of a pair."""
    return texts.select(F.col("node").alias(node), F.col("digest").alias(f"d{name}"), F.col("text").alias(name))


def set_pairs(batch: pa.RecordBatch, first: str, second: str, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Two nodes and their whole sets, for the rows of a block; a text that has not the digest of its class is another's."""
    known = {}

    def whole(text: bytes) -> tuple[np.ndarray, bytes]:
        if text not in known:
            s = shingle_set(text, size)
            known[text] = s, xxh3_128_digest(s.tobytes())
        return known[text]

    ids = (batch.column(c).to_pylist() for c in (first, second, "dx", "dy"))
    for a, b, dx, dy, x, y in zip(*ids, as_bytes(batch.column("x")), as_bytes(batch.column("y")), strict=True):
        (p, one), (q, two) = whole(x), whole(y)
        if one == dx and two == dy:
            yield a, b, p, q


def verifier(size: int, num: int, den: int) -> Callable:
    """Keeps the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "x"):
            u, v = [], []
            for a, b, p, q in set_pairs(batch, "a", "b", size):
                common = len(np.intersect1d(p, q, assume_unique=True))
                if den * common >= num * (len(p) + len(q) - common):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def overlap(n1: Column, n2: Column, num: int, den: int) -> Column:
    """How many shingles two linked sets of these sizes have in common at least."""
    return F.ceil((n1 + n2) * num / (num + den))


def may_link(p: str, q: str, common: int, num: int, den: int) -> Column:
    """Bounds from sizes and the positions of one shared shingle.

    A stored prefix serves partners of every size; for the two sizes at hand a shorter one will do.
    """
    n1, n2, i, j = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (p, q))
    need = overlap(n1, n2, num, den)
    inside = (i < n1 - need + common) & (j < n2 - need + common)
    return (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & inside & (F.least(i, j) + F.least(n1 - i, n2 - j) >= need)


def enough(n: Column, common: int, num: int, den: int) -> Column:
    """How many prefix shingles a set of n has in common with any that it links with."""
    return F.least(F.lit(common), F.ceil(n * num / den))


def candidates(paired: DataFrame, common: int, num: int, den: int) -> DataFrame:
    """(a, b), a < b: pairs of p and q that share enough prefix shingles; one input row per shingle."""
    p, q = F.struct("p.node", "p.n"), F.struct("q.node", "q.n")
    some = paired.where(may_link("p", "q", common, num, den)).groupBy(F.least(p, q).alias("s"), F.greatest(p, q).alias("t")).agg(F.count("*").alias("shared"))
    return some.where(F.col("shared") >= F.least(F.lit(common), overlap(F.col("s.n"), F.col("t.n"), num, den))).select(F.col("s.node").alias("a"), F.col("t.node").alias("b"))


def homes(named: DataFrame, pivots: DataFrame, crowd: int) -> DataFrame:
    """(node, home): the pivot of more than half of a class's shingles, if at least ``crowd`` classes have it."""
    votes = named.join(pivots, "token").groupBy(F.col("q.node").alias("node"), F.col("p.node").alias("home")).agg(F.count("*").alias("s"))
    best = votes.groupBy("node").agg(F.sum("s").alias("all"), F.max(F.struct("s", "home")).alias("best")).where("2 * best.s > all")
    found = kept(best.select("node", "best.home"))
    crowded = found.groupBy("home").agg(F.count("*").alias("classes")).where(F.col("classes") >= crowd).select("home")
    return found.join(crowded, "home").select("node", "home")


def deltas(home: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, home, n, linked, delta): what is in one of both sets only, where that is at most half of a class's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "x"):
            out = {"node": [], "home": [], "n": [], "linked": [], "delta": []}
            for node, at, p, q in set_pairs(batch, "node", "home", size):
                delta = np.setxor1d(p, q, assume_unique=True)
                if 2 * len(delta) <= len(p):
                    union = (len(p) + len(q) + len(delta)) // 2
                    values = (node, at, len(p), bool(den * (union - len(delta)) >= num * union), delta.view(np.int64))
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("node", pa.int64()), ("home", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("delta", pa.list_(pa.int64()))]))

    sides = home.join(side(texts, "node", "x"), "node").join(side(texts, "home", "y"), "home")
    return sides.mapInArrow(run, "node long, home long, n long, linked boolean, delta array<long>")


def delta_prefixes(near: DataFrame, num: int, den: int) -> DataFrame:
    """(home, elem, held, p): the first elements of each difference, rare ones of the home first, p the class and the position.

    Sets of sizes n and m that link have ``o`` shingles in common, hence their differences from
    their home, of sizes d and e, have ``o - (n + m - d - e) / 2``.  That is one at least unless
    both link with their home, and they then are in one component.  So this is a prefix join
    again, on differences.
    """
    elems = near.select("home", "node", "n", F.size("delta").alias("d"), F.explode("delta").alias("elem"))
    counts = elems.groupBy("home", "elem").agg(F.count("*").alias("held"))
    order = F.row_number().over(Window.partitionBy("node").orderBy("held", "elem")) - 1
    most = F.floor(F.col("n") * (den - num) / num)  # by so many shingles a linked partner differs at most
    placed = elems.join(counts, ["home", "elem"]).withColumn("pos", order)
    inside = (F.col("held") > 1) & (F.col("pos") <= F.col("d") - F.greatest(F.lit(1), F.col("d") - most))
    return placed.where(inside).select("home", "elem", "held", F.struct("node", "n", "d", "pos").alias("p"))


def delta_candidates(short: DataFrame, of: DataFrame, num: int, den: int, turn: int | None = None, few: int = 4) -> DataFrame:
    """(a, b), a < b: pairs of one home and two components that may link; of has the component c of every node.

    With a turn, those that have an element are dealt into lots of ``few`` and meet in theirs only: pairs grow as the rows.
    """
    d1, d2, i, j = (F.col(f"{s}.{c}") for c in ("d", "pos") for s in ("p", "q"))
    n1, n2 = F.col("p.n"), F.col("q.n")
    need = F.greatest(F.lit(1), overlap(n1, n2, num, den) - (n1 + n2 - d1 - d2) / 2)
    fits = (F.least(n1, n2) * den >= F.greatest(n1, n2) * num) & (i <= d1 - need) & (j <= d2 - need) & (F.least(i, j) + F.least(d1 - i, d2 - j) >= need)
    lot = F.lit(0) if turn is None else F.pmod(F.xxhash64("p.node", F.lit(turn)), F.ceil(F.col("held") / few))
    held = short.join(of, F.col("p.node") == F.col("node")).select("home", "elem", lot.alias("lot"), F.col("p").withField("c", F.col("c")).alias("p"))
    paired = held.join(held.withColumnRenamed("p", "q"), ["home", "elem", "lot"]).where((F.col("p.c") < F.col("q.c")) & fits)
    return paired.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def delta_pairs(near: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: all pairs of one home and two components that may link; near has c, the component, too."""
    short = kept(delta_prefixes(near, num, den))
    pairs = kept(delta_candidates(short, near.select("node", "c"), num, den))
    forget(short)
    return pairs


def link_components(prefixes: DataFrame, rows: DataFrame, size: int, num: int, den: int, common: int, rounds: int, crowd: int) -> DataFrame:
    """(digest, n, c) of the classes; c is the smallest doc_id of those that links reach.

    A class's node is a number of its own, as classes may have the smallest doc_id in common.
    The kept prefixes are dropped once the classes have them.
    """
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    wide = kept(
        prefixes.where("doc_id is not null and n > 0").groupBy("digest", "n").agg(one, F.first("prefix").alias("prefix"))
        .select("digest", "n", "one.doc_id", "one.text_hash", "prefix", F.xxhash64("n", "prefix").alias("grp"), F.monotonically_increasing_id().alias("node"))
    )
    classes = kept(wide.drop("prefix"))
    forget(prefixes)
    groups = wide.groupBy("grp").agg(F.count("*").alias("members"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # One shuffle by shingle serves the counts and the join with them. A group stands for itself here.
    tokens = groups.select(F.col("grp").alias("node"), "members", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    pivot = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n", "pos")).alias("p")
    shared = tokens.groupBy("token").agg(F.sum("members").alias("classes"), pivot).where("classes > 1")
    held = kept(tokens.join(shared, "token").select("token", F.struct("node", "n", "pos").alias("q"), "p"))
    forget(wide)
    # A set that links with any shares enough prefix shingles; others are out of play.
    play = kept(held.groupBy(F.col("q.node").alias("grp"), F.col("q.n").alias("n")).agg(F.count("*").alias("shared")).where(F.col("shared") >= enough(F.col("n"), common, num, den)).select("grp"))
    members = kept(classes.join(play, "grp").select("grp", "node", "digest", "doc_id", "text_hash"))
    in_play = held.join(play, F.col("q.node") == F.col("grp"))
    star = candidates(in_play.where(F.col("p.node") != F.col("q.node")), common, num, den)
    first = members.groupBy("grp").agg(F.min("node").alias("a"))
    within = members.join(first, "grp").where("node != a").select("a", F.col("node").alias("b"))
    sides = [first.select(F.col("grp").alias(g), F.col("a").alias(c)) for g, c in (("a", "u"), ("b", "v"))]
    between = star.join(sides[0], "a").join(sides[1], "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    pairs = kept(between.unionByName(within).distinct())
    # Rows of single classes from here on, as a group's classes may be in different components.
    rest = kept(in_play.select("token", "grp", "q.n", "q.pos").join(members.select("grp", "node"), "grp").select("token", "node", "n", "pos"))
    forget(held, play)
    # Texts take a third of the place of their sets, of which few are asked for. In buckets they are not moved for each join.
    found = kept(texts_of(rows, members))
    texts = kept_by(found, "node")
    forget(found)

    def verified(some: DataFrame) -> DataFrame:
        sides = some.join(side(texts, "a", "x"), "a").join(side(texts, "b", "y"), "b")
        return kept(sides.mapInArrow(verifier(size, num, den), "u long, v long"))

    def named_by(whole: DataFrame) -> DataFrame:
        return rest.join(whole, "node", "left").select("token", F.struct("node", "n", "pos").alias("q"), F.coalesce("component", "node").alias("c"))

    def mixed(named: DataFrame, hashed: Column) -> DataFrame:
        """(token, p) of the shingles that several components have, p the class whose hash is smallest."""
        pivot = F.min(F.struct(hashed.alias("h"), "q.node", "q.n", "q.pos", "c")).alias("p")
        return named.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), pivot).where("c1 < c2").select("token", "p")

    links, tried = verified(pairs), pairs
    for k in range(rounds):
        named = named_by(components(links))
        paired = named.join(mixed(named, F.xxhash64("c", F.lit(k))), "token").where(F.col("c") != F.col("p.c"))
        new = kept(candidates(paired, common, num, den).join(tried, ["a", "b"], "left_anti"))
        links, tried = links.unionByName(verified(new)), tried.unionByName(new)
    # What is left: classes near one pivot are joined on what they differ by from it, all others on shingles.
    whole = components(links)
    named = named_by(whole)
    pivots = kept(mixed(named, F.xxhash64("q.node")))
    near = kept(deltas(homes(named, pivots, crowd), texts, size, num, den))
    links = links.unionByName(near.where("linked and node != home").select(F.col("node").alias("u"), F.col("home").alias("v")))
    short = kept(delta_prefixes(near, num, den))

    def of_near(whole: DataFrame) -> DataFrame:
        return near.select("node").join(whole, "node", "left").select("node", F.coalesce("component", "node").alias("c"))

    # Copies that link are in one component after a few partners each; only what is still apart meets in all pairs.
    for k in range(rounds):
        whole = components(links)
        new = kept(delta_candidates(short, of_near(whole), num, den, turn=k).join(tried, ["a", "b"], "left_anti"))
        links, tried = links.unionByName(verified(new)), tried.unionByName(new)
    whole = components(links)
    named = named_by(whole)
    by_delta = kept(delta_candidates(short, of_near(whole), num, den))
    left = kept(
        named.join(pivots.select("token"), "token").join(near.select(F.col("node").alias("near"), "home"), F.col("q.node") == F.col("near"), "left")
        .select("token", F.struct("q.node", "q.n", "q.pos", "c", "home").alias("q"))
    )
    apart = (F.col("p.c") < F.col("q.c")) & F.coalesce(F.col("p.home") != F.col("q.home"), F.lit(True))
    paired = left.withColumnRenamed("q", "p").join(left, "token").where(apart)
    new = kept(candidates(paired, common, num, den).unionByName(by_delta).distinct().join(tried, ["a", "b"], "left_anti"))
    whole = components(links.unionByName(verified(new)))
    forget(pivots, near, short, left, by_delta)
    forget(texts, rest, members)
    # A component's own node is not among the nodes of its table.
    whole = whole.unionByName(whole.select(F.col("component").alias("node"), "component").distinct())
    linked = whole.join(classes.select("node", "doc_id"), "node")
    smallest = linked.join(linked.groupBy("component").agg(F.min("doc_id").alias("c")), "component").select("node", "c")
    return classes.join(smallest, "node", "left").select("digest", "n", F.coalesce("c", "doc_id").alias("c"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    common: int = 6,
    bits: int = 18,
    rounds: int = 1,
    crowd: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Two documents link when ``den * intersection >= num * union``.  ``common`` is how many
    prefix shingles candidates share (prefixes grow by as many).  ``bits`` sets the size of the
    frequency table (2**bits counters, whatever the corpus), ``rounds`` how many further
    pivots are tried before all remaining pairs are.  Where ``crowd`` classes or more are near one
pivot they are joined on their differences from it (fewer make few pairs); links are the same.
    """
    text = text_column(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    with small_batches(docs.sparkSession):
        prefixes = kept(with_prefixes(rows, shingle, num, den, common, bits))
        sized = kept(prefixes.select("doc_id", "n", "digest"))
        named = link_components(prefixes, rows, shingle, num, den, common, rounds, crowd)
    # Rows that share an id are one node, whatever their sets.
    by_id = sized.where("doc_id is not null and n > 0").join(named, ["digest", "n"]).select("doc_id", "c")
    chains = by_id.groupBy("doc_id").agg(F.min("c").alias("u"), F.max("c").alias("v")).where("u < v")
    if chains.take(1):
        # Every component that an id has rows in, not just the outer two.
        over = components(by_id.join(chains, "doc_id").where("c != u").select("u", F.col("c").alias("v")))
        by_id = by_id.join(over, by_id["c"] == over["node"], "left").select("doc_id", F.coalesce("component", "c").alias("c"))
    by_id = by_id.groupBy("doc_id").agg(F.min("c").alias("c"))
    return sized.join(by_id, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are the first of their component; rows with a null id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    later = found.where("doc_id != component_id").select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(later, F.col(id_col).cast("long") == F.col("_later"), "left_anti")
