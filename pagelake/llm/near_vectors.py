"""Near-duplicate embeddings by epsilon grid order.

Two unit vectors have a cosine of at least c where their distance is at most
``eps = sqrt(2 - 2c)``.  Vectors are turned onto principal directions (from a bounded sample;
a rotation changes no distance), cut into grid cells of side eps on the leading directions
and sorted by cell.  The sorted sequence is cut into blocks; a block's box spans its leading
coordinates and the length of the rest.  Pairs of sequence intervals are then joined
recursively: an interval pair whose boxes lie further apart than eps is dropped, others are
split into their parts, down to pairs of blocks.  A block pair goes on splitting to runs of a few
hundred vectors and compares those that remain in double precision.

Equal vectors are compared once and counted; equal are those of one 128-bit hash.  Block pairs
are worked off in units: a tile of neighbouring blocks that a task holds, and the blocks that
meet it, one after the other.  So a block travels once per unit, not once per pair, and units
go in rounds none of which moves more than the vectors of the table.  A unit yields the number
of links per vector and a spanning forest of its links, never the pairs.

Vectors are shuffled once, in the type they come in, and kept once, in blocks; all else that is
moved or kept are ids, hashes and counts.

Null and zero vectors and such with null or non-finite components link with nothing, and
vectors of different lengths do not link.  Every row gives one row: rows that share a vec_id
count as different vectors for ``n_links`` and as one node for ``component_id``; a row with a
null id is counted by others but belongs to no component.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pagelake.llm.common import forget, kept, small_batches
from pagelake.llm.components import components
from pagelake.session import cut

RUN = 256
#: Bytes of vectors in a tile that a task holds, and what a round moves at least.
TILE, ROUND = 8 << 20, 512 << 20


def usable(v: Column) -> Column:
    """No nulls, NaN or infinities, and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def unit(values: np.ndarray, sizes: np.ndarray, dim: int) -> np.ndarray:
    """Rows of length one, padded with zeros to one dimension; values holds the rows' one after the other."""
    filled = np.arange(dim) < sizes[:, None]
    out = np.zeros(filled.shape)
    out[filled] = values
    out /= np.abs(out).max(1, keepdims=True)  # before squaring, so that nothing overflows
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def unpacked(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and each list's length."""
    return vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def directions(good: DataFrame, dim: int, lead: int, sample: int, distinct: int) -> np.ndarray:
    """Leading principal directions of at most ``sample`` of about ``distinct`` vectors, chosen by a hash.

    They decide only how much is skipped, never what is found.
    """
    share = 1.2 * sample / distinct
    some = good if share >= 1 else good.where(F.col("h1") < int(-(2**63) + share * 2**64))
    rows = some.select("embedding").distinct().orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    x = unit(*unpacked(rows.column("embedding").combine_chunks()), dim)
    values, vectors = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dim))
    return vectors[:, np.argsort(values)[::-1][:lead]]


def cells(values: np.ndarray, sizes: np.ndarray, axes: np.ndarray, eps: float) -> np.ndarray:
    """Grid cells as big-endian numbers, whose bytes sort as the cells do.

    Summed up one dimension after the other, as a matrix product may round a row otherwise in
    another batch: equal vectors have to lie in one cell.
    """
    filled = np.arange(len(axes)) < sizes[:, None]
    x = np.zeros(filled.shape)
    x[filled] = values
    x = np.ascontiguousarray((x / np.abs(x).max(1, keepdims=True)).T)
    head, squares = np.zeros((axes.shape[1], len(sizes))), np.zeros(len(sizes))
    for j, column in enumerate(x):
        squares += column * column
        head += axes[j][:, None] * column
    at = np.floor(head / np.sqrt(squares) / max(eps, 1e-9))  # in 31 bits, as no coordinate is over one
    return np.ascontiguousarray((at.T + 2**31).astype(">u4"))


def merged(rows: pa.Table) -> pa.Table:
    """Neighbours of one hash as one row, with the least id and all copies."""
    h1, h2 = (rows.column(h).to_numpy() for h in ("h1", "h2"))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    start = np.flatnonzero(new)
    if len(start) == len(h1):
        return rows
    known = rows.column("least").is_valid().to_numpy()
    least = np.minimum.reduceat(rows.column("least").fill_null(2**63 - 1).to_numpy(), start)
    out = rows.take(pa.array(start))
    for name, column in (
        ("least", pa.array(least, pa.int64(), mask=~np.logical_or.reduceat(known, start))),
        ("copies", pa.array(np.add.reduceat(rows.column("copies").to_numpy(), start))),
    ):
        out = out.set_column(out.schema.get_field_index(name), name, column)
    return out


def pieces(data: pa.Buffer, bounds: np.ndarray) -> pa.Array:
    """A binary column of what lies between the bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), data])


def boxes(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates that bound distances from below: the leading ones and the length of the rest."""
    head = rows @ axes
    rest = np.sqrt(np.maximum((rows * rows).sum(1) - (head * head).sum(1), 0))
    return np.column_stack([head, rest])


def join_runs(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, eps: float) -> Iterator[tuple[slice, slice]]:
    """Pairs of runs of two sequences that may hold links, by recursive halving."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        gap = np.maximum(np.maximum(cx[a:b].min(0) - cy[c:d].max(0), cy[c:d].min(0) - cx[a:b].max(0)), 0)
        if (gap * gap).sum() > eps * eps + 1e-9:
            continue
        if b - a <= RUN and d - c <= RUN:
            yield slice(a, b), slice(c, d)
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def roots(parent: np.ndarray, nodes: slice) -> np.ndarray:
    """The roots of some nodes, which point at them from now on."""
    at = parent[nodes]
    while ((up := parent[at]) != at).any():
        at = up
    parent[nodes] = at
    return at


class Block:
    """The vectors of one block as they are compared: with length one, in double and in single precision."""

    def __init__(self, number: int, raw: bytes, sizes: np.ndarray, copies: np.ndarray, kind: str, axes: np.ndarray):
        self.number, self.sizes, self.copies, self.dim = number, sizes, copies, len(axes)
        self.values, self.ends = np.frombuffer(raw, kind), np.cumsum(sizes)
        self.x = unit(self.values, sizes, self.dim)
        self.short, self.box = self.x.astype(np.float32), boxes(self.x, axes)
        self.got = np.zeros(len(sizes), np.int64)

    def vector(self, k: int) -> np.ndarray:
        return self.values[self.ends[k] - self.sizes[k] : self.ends[k]]


def join_blocks(x: Block, y: Block, least: float, parent: np.ndarray, x_from: int, y_from: int) -> list[tuple[int, int]]:
    """Counts the links between two blocks (or within one) and joins their nodes; returns the links that joined trees.

    The blocks' vectors are the nodes of ``parent`` from ``x_from`` and ``y_from`` on.
    """
    slack = (x.dim + 8) * 2.0**-23  # more than single precision may be off
    forest = []
    for a, b in join_runs(x.x, y.x, x.box, y.box, np.sqrt(2 - 2 * least)):
        if (x.short[a] @ y.short[b].T).max() < least - slack:
            continue
        cosine = x.x[a] @ y.x[b].T
        hit = (cosine >= least - 1e-9) & (x.sizes[a][:, None] == y.sizes[b])
        if x is y:
            hit &= np.arange(a.start, a.stop)[:, None] != np.arange(b.start, b.stop)
        for i, j in zip(*np.nonzero(hit & (np.abs(cosine - least) <= 1e-9)), strict=True):
            hit[i, j] = exact(x.vector(a.start + i), y.vector(b.start + j)) >= least
        if not hit.any():
            continue
        x.got[a] += hit @ y.copies[b]
        if x is not y:
            y.got[b] += x.copies[a] @ hit
        at, to = slice(x_from + a.start, x_from + a.stop), slice(y_from + b.start, y_from + b.stop)
        # Each row joins the first tree it links to and is not in, until none is left.
        while (apart := hit & (roots(parent, at)[:, None] != roots(parent, to))).any():
            rows = np.flatnonzero(apart.any(1))
            for i, j in zip(rows.tolist(), apart[rows].argmax(1).tolist(), strict=True):
                p, q = find(parent, at.start + i), find(parent, to.start + j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    forest.append((a.start + i, b.start + j))
    return forest


def exact(x: np.ndarray, y: np.ndarray) -> float:
    a, b = np.asarray(x, np.float64), np.asarray(y, np.float64)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


class Unit:
    """A tile's blocks, held while others meet them."""

    def __init__(self, least: float, block_rows: int):
        self.least, self.rows, self.held, self.parent = least, block_rows, {}, np.zeros(0, np.int64)

    def hold(self, block: Block) -> None:
        self.held[block.number] = len(self.parent), block
        self.parent = np.concatenate([self.parent, len(self.parent) + np.arange(len(block.sizes))])

    def meet(self, number: int, block: Block | None, partners: list[int]) -> pa.RecordBatch:
        """Joins a block, a held one if none is given, with some that are held; returns its counts and the links."""
        guest = number not in self.held
        if guest:
            parent, at = np.concatenate([self.parent, len(self.parent) + np.arange(len(block.sizes))]), len(self.parent)
        else:
            parent, (at, block) = self.parent, self.held[number]
        links = [
            (a * self.rows + i, number * self.rows + j)
            for a in partners
            for i, j in join_blocks(self.held[a][1], block, self.least, parent, self.held[a][0], at)
        ]
        if guest:
            # Roots are the least of their trees, and nodes of the guest link with held ones alone.
            self.parent = parent[:at]
        return self.told([block] if guest else [], links)

    def told(self, blocks: list[Block], links: list[tuple[int, int]]) -> pa.RecordBatch:
        some = [np.flatnonzero(b.got) for b in blocks]
        ids = [i + b.number * self.rows for i, b in zip(some, blocks, strict=True)]
        counts = [b.got[i] for i, b in zip(some, blocks, strict=True)]
        n, k = sum(map(len, ids)), len(links)
        empty = [np.zeros(0, np.int64)]
        ends = np.array(links, np.int64).reshape(-1, 2)
        column = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([column(np.concatenate(ids + empty)), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([column(np.concatenate(counts + empty)), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), column(ends[:, 0])]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), column(ends[:, 1])]),
            ],
            names=["id", "n", "u", "v"],
        )


def whole_list(column: pa.Array) -> pa.Array:
    """A column's values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def interval_pairs(blocks: DataFrame, eps: float, fan: int = 8) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes are within eps, by descending through intervals.

    Level k's intervals are runs of fan**k blocks.  A level's surviving pairs are split into
    pairs of parts by two joins on the part's parent; nothing is compared that no surviving
    pair of parents led to.
    """
    n = blocks.agg(F.max("block")).first()[0]
    if n is None:
        return blocks.select(F.col("block").alias("a"), F.col("block").alias("b"))
    height = 0
    while fan**height <= n:
        height += 1
    nodes = blocks.select("block", "low", "high")
    wide = range(len(blocks.select("low").first()[0]))

    def level(k: int) -> DataFrame:
        parent = F.floor(F.col("block") / fan**k).cast("long").alias("node")
        low = F.array(*[F.min(F.col("low")[i]) for i in wide])
        high = F.array(*[F.max(F.col("high")[i]) for i in wide])
        return nodes.groupBy(parent).agg(low.alias("low"), high.alias("high")).withColumn("up", F.floor(F.col("node") / fan).cast("long"))

    pairs = blocks.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for k in reversed(range(height)):
        own = level(k)
        one = own.select(F.col("up").alias("a"), F.col("node").alias("a2"), F.col("low").alias("al"), F.col("high").alias("ah"))
        two = own.select(F.col("up").alias("b"), F.col("node").alias("b2"), F.col("low").alias("bl"), F.col("high").alias("bh"))
        gap = F.zip_with(
            F.zip_with("al", "bh", lambda p, q: p - q), F.zip_with("bl", "ah", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0))
        )
        apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
        pairs = cut(pairs.join(one, "a").join(two, "b").where(F.col("a2") <= F.col("b2")).where(apart <= eps * eps + 1e-9).select(F.col("a2").alias("a"), F.col("b2").alias("b")))
    return pairs


def folded(spark: SparkSession, parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The links per vector, and each vector's component, of what several rounds found."""
    found = spark.read.schema(parts[0].schema).parquet(*[p.kept_at for p in parts])
    weights = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    return weights, components(found.where("u is not null").select("u", "v"), tidy=True)


def block_links(blocks: DataFrame, pairs: DataFrame, count: int, axes: np.ndarray, least: float, block_rows: int, dtype: str) -> list[DataFrame]:
    """(id, n) links of vectors and (u, v) forests of links, over pairs of ``count`` blocks; a kept table for each round."""
    spark = blocks.sparkSession
    size = block_rows * len(axes) * np.dtype(dtype).itemsize
    # Tiles as large as leaves every task something to do and a task can hold.
    slots, many = 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count()
    tile = max(1, min(isqrt(many // slots), TILE // size))
    lot = max(tile, min(4 * tile, many // (slots * tile)))
    within = F.floor(F.col("b") / tile) == F.col("tile")
    pairs = pairs.withColumn("tile", F.floor(F.col("a") / tile)).withColumn("lot", F.floor(F.col("b") / lot))
    held = pairs.select("tile", "lot", F.explode(F.array("a", F.when(within, F.col("b")))).alias("block")).where("block is not null").distinct()
    met = pairs.groupBy("tile", "lot", F.col("b").alias("block"), within.alias("bare")).agg(F.collect_list("a").alias("partners"))
    sent = kept(met.unionByName(held.withColumn("bare", F.lit(False)).withColumn("partners", F.lit(None).cast("array<long>"))))
    moved = sent.where("not bare").count()
    rounds = max(1, -(-moved * size // max(ROUND, count * size)))
    units = sent.select("tile", "lot").distinct().count()
    tasks = max(min(-(-units // rounds), 2 * slots), -(-moved * size // (rounds * 5 * TILE)))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, work = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                of, number = (row["tile"].as_py(), row["lot"].as_py()), row["block"].as_py()
                if of != now:
                    if work is not None:
                        yield work.told([b for _, b in work.held.values()], [])
                    now, work = of, Unit(least, block_rows)
                raw, partners, block = row["vectors"].as_buffer(), row["partners"].as_py(), None
                if raw is not None:
                    block = Block(number, raw, row["sizes"].values.to_numpy(), row["copies"].values.to_numpy(), dtype, axes)
                if partners is None:
                    work.hold(block)
                else:
                    yield work.meet(number, block, partners)
        if work is not None:
            yield work.told([b for _, b in work.held.values()], [])

    parts, rows_found, none = [], 0, F.lit(None).cast("long")
    for k in range(rounds):
        if rows_found > 2 * count * block_rows:
            # As many rows as vectors say the same.
            weights, whole = folded(spark, parts)
            less = kept(weights.select("id", "n", none.alias("u"), none.alias("v")).unionByName(whole.select(none.alias("id"), none.alias("n"), F.col("node").alias("u"), F.col("component").alias("v"))))
            forget(whole, *parts)
            parts, rows_found = [less], 0
        # A round has about as many rows as there are blocks; they go to the blocks, which then move once.
        some = sent.where(F.pmod(F.xxhash64("tile", "lot"), F.lit(rounds)) == k)
        carried = [F.when(~F.col("bare"), F.col(c)).alias(c) for c in ("vectors", "sizes", "copies")]
        rows = blocks.join(F.broadcast(some), "block").select("tile", "lot", "block", "partners", *carried)
        order = ["tile", "lot", F.col("partners").isNotNull(), "block"]
        with small_batches(spark):
            parts.append(kept(rows.repartition(tasks, "tile", "lot").sortWithinPartitions(*order).mapInArrow(links, "id long, n long, u long, v long")))
        rows_found += parts[-1].count()
    forget(sent)
    return parts


def near_vectors(
    table: DataFrame,
    least: float = 0.95,
    lead: int = 6,
    block_rows: int = 4096,
    sample: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    ``lead`` is the number of leading directions in cells and boxes, ``block_rows`` the
    vectors of a block (a task holds two blocks), ``sample`` the bound of the sample for the
    directions.
    """
    spark = table.sparkSession
    eps = float(np.sqrt(2 - 2 * least))
    stored = table.select(vector_col).schema[0].dataType
    kind = "float" if isinstance(stored, ArrayType) and isinstance(stored.elementType, FloatType) else "double"
    dtype = {"float": "<f4", "double": "<f8"}[kind]
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    rows = rows.withColumn("fine", usable(F.col("embedding")))
    # Equal vectors have one hash; the others get one that no vector has, each its own.
    rows = rows.select(
        "vec_id", "embedding", "fine",
        F.when(F.col("fine"), F.xxhash64("embedding")).otherwise(F.xxhash64("vec_id")).alias("h1"),
        F.when(F.col("fine"), F.xxhash64(F.lit(1), "embedding")).alias("h2"),
    )
    good = rows.where("fine")
    dim, many, distinct = good.agg(F.max(F.size("embedding")), F.count("*"), F.approx_count_distinct("h1")).first()
    if dim is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = directions(good, dim, min(lead, dim), sample, distinct)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, sizes = unpacked(batch.column("embedding"))
                at = cells(values, sizes, axes, eps)
                n = len(at)
                out = pa.Table.from_arrays(
                    [
                        pieces(pa.py_buffer(at), np.arange(n + 1) * at.itemsize * at.shape[1]),
                        *(batch.column(h) for h in ("h1", "h2")),
                        batch.column("vec_id"),
                        pa.array(np.ones(n, np.int64)),
                        pa.array(sizes),
                        pieces(pa.py_buffer(np.ascontiguousarray(values, dtype)), np.concatenate([[0], np.cumsum(sizes)]) * np.dtype(dtype).itemsize),
                    ],
                    names=["cell", "h1", "h2", "least", "copies", "size", "vector"],
                )
                # A common vector goes on once per batch.
                yield from merged(out.sort_by([("h1", "ascending"), ("h2", "ascending")])).combine_chunks().to_batches()

    in_order = good.mapInArrow(placed, "cell binary, h1 long, h2 long, least long, copies long, size long, vector binary")
    # Few vectors that come many times are still dealt to several tasks.
    parts = max(1, -(-distinct // (4 * block_rows)), min(-(-many // (16 * block_rows)), 4 * distinct // block_rows))
    # The hash last: one crowded cell is spread over several ranges.
    order = ["cell", "h1", "h2"]
    in_order = in_order.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    lists = {"h1": "h1", "h2": "h2", "least": "least", "copies": "copies", "sizes": "size"}
    shape = "part long, piece long, low array<double>, high array<double>, vectors binary, " + ", ".join(f"{name} array<long>" for name in lists)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = 0, None

        def emit(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0]
            raw = b"".join(rows.column("vector").to_pylist())
            c = boxes(unit(np.frombuffer(raw, dtype), rows.column("size").to_numpy(), dim), axes)
            return pa.RecordBatch.from_pydict(
                {"part": rows.column("part")[:1], "piece": [piece], "low": [c.min(0).tolist()], "high": [c.max(0).tolist()], "vectors": pa.array([raw], pa.binary())}
                | {name: whole_list(rows.column(of)) for name, of in lists.items()}
            )

        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = merged(more if held is None else pa.concat_tables([held, more]))
            while held.num_rows > block_rows:  # copies of the last row may follow
                yield emit(held[:block_rows])
                piece, held = piece + 1, held[block_rows:]
        if held is not None and held.num_rows:
            yield emit(held)

    found = kept(in_order.mapInArrow(blocked, shape))
    # One row per range partition: how many blocks come before it.
    counts = sorted((r["part"], r["count"]) for r in found.groupBy("part").count().collect())
    before = np.cumsum([0, *[c for _, c in counts]]).tolist()
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part long, before long")
    blocks = found.join(F.broadcast(offsets), "part").withColumn("block", F.col("before") + F.col("piece")).drop("part", "piece", "before")
    rounds = block_links(blocks, interval_pairs(blocks, eps), before[-1], axes, least, block_rows, dtype)
    weights, whole = folded(spark, rounds)
    nodes = blocks.select("block", F.posexplode(F.arrays_zip("h1", "h2", "least", "copies")).alias("at", "of"))
    nodes = nodes.select((F.col("block") * block_rows + F.col("at")).alias("id"), "of.*")
    # Those without a link or a copy are what the others' lack says.
    classes = kept(
        nodes.join(weights, "id", "left").join(whole, nodes["id"] == whole["node"], "left")
        .select("h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
        .where("n_links > 0")
    )
    forget(found, whole, *rounds)
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(smallest, "component").select("h1", "h2", "n_links", "component_id")
    linked = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = kept(linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")))
    forget(classes)
    # Rows that share an id are one node: the components they are in are one.
    chains = out.where("vec_id is not null").groupBy("vec_id").agg(F.min("component_id").alias("u"), F.max("component_id").alias("v")).where("u < v")
    if chains.take(1):
        over = components(out.join(chains, "vec_id").where("component_id != u").select("u", F.col("component_id").alias("v")), tidy=True)
        out = out.join(over, out["component_id"] == over["node"], "left").select("vec_id", "n_links", F.coalesce("component", "component_id").alias("component_id"))
    return out.withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
