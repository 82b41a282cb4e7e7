"""Removal of repeated byte strings by suffix sorting with a difference cover.

A byte goes when it is covered by a string of ``width`` bytes that also starts earlier.  All
documents together are one text whose suffixes are sorted by their first ``width`` bytes; of
those with equal prefixes, which stand side by side, all but the earliest are copies.

Distribution.  Equal strings must meet in one task, so suffixes are dealt out by content: of
the short grams inside a string the one with the smallest hash is its anchor, and equal
strings have equal anchors at equal places.  The strings of one anchor occurrence form its
context.  Three facts keep the sorting small without changing its outcome: an anchor gram
that occurs once has no copies; occurrences with equal contexts are copies of the earliest as
a whole; and an anchor with one distinct context needs no comparison.  What remains, distinct
contexts of anchors that have several, is sorted task by task with the difference-cover
algorithm (``suffix_order``): triples of sampled positions are sorted and named, the names are
sorted recursively, the other suffixes are merged in, and neighbours' prefixes are compared.
An anchor with very many distinct contexts is cut into parts; strings that are first in their
part meet again by their digest, aggregated before the shuffle.

Texts are UTF-8 bytes, null texts are empty, and matches never cross documents.  Every row
gives one row.  Order is by doc_id (nulls first), and among rows that share one by the hash
of their text: a repeated row counts as a later document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from pagelake.llm.common import as_bytes, kept, mix, text_column
from pagelake.operators.ordered import number_rows

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Most strings in one span of starts; spans are packed as first start * 256 + number.
MOST = 255


def suffix_order(s: np.ndarray, largest: int) -> np.ndarray:
    """Start positions of the suffixes of an integer string (values 1..largest) in order.

    Sampled positions are those that 3 does not divide.  The string must be shorter than
    2**20, so that three names fit into 63 bits.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    c = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    wide = largest + 1
    ones = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    triples = (c[sample] * wide + c[sample + 1]) * wide + c[sample + 2]
    order = np.argsort(triples, kind="stable")
    ordered = triples[order]
    names = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    if names[-1] < len(sample):
        named = np.empty(len(sample), np.int64)
        named[order] = names
        order = suffix_order(named, int(names[-1]))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    many = len(sample) + 2
    others = np.arange(0, n, 3)
    own = c[others] * many + rank[others + 1]
    others = others[np.argsort(own, kind="stable")]
    placed = sample[order]
    placed = placed[placed < n]
    first, second = placed[placed % 3 == 1], placed[placed % 3 == 2]
    before = np.searchsorted(c[first] * many + rank[first + 1], c[others] * many + rank[others + 1])
    before += np.searchsorted(
        (c[second] * wide + c[second + 1]) * many + rank[second + 2], (c[others] * wide + c[others + 1]) * many + rank[others + 2]
    )
    out = np.empty(n, np.int64)
    spots = before + np.arange(len(others))
    out[spots] = others
    free = np.ones(n, bool)
    free[spots] = False
    out[free] = placed
    return out


class Anchors:
    """Anchor occurrences of texts, for strings of one width."""

    def __init__(self, width: int):
        self.width = width
        self.gram = max(1, width * 36 // 100)
        self.window = width - self.gram + 1
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _BACK)):
                p = np.full(n, base)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram hashes, context hashes and spans of starts (first * 256 + number)."""
        n, width = len(text), self.width
        if n < width:
            return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),)
        self.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        grams = mix((total[self.gram :] - total[: -self.gram]) * self.down[: n - self.gram + 1])
        # Leftmost smallest gram of each window, by doubling the length seen.
        best, at, seen = grams, np.arange(len(grams), dtype=np.int32), 1
        while seen < self.window:
            step = min(seen, self.window - seen)
            left = best[:-step] <= best[step:]
            best, at = np.where(left, best[:-step], best[step:]), np.where(left, at[:-step], at[step:])
            seen += step
        first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
        number = np.diff(np.append(first, len(at)))
        if number.max() > MOST:  # cannot be for usual widths; keeps the packing safe
            raise ValueError("width is too large")
        end = first + number - 1 + width
        place = at[first].astype(np.int64)
        shape = ((place - first) * 65536 + number).astype(np.uint64)
        context = mix(mix((total[end] - total[first]) * self.down[first]) + shape * _BASE)
        return grams[place], context, first * 256 + number


def spans_of(uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single starts to spans of consecutive ones."""
    if not len(uid):
        return uid, start
    order = np.lexsort((start, uid))
    uid, start = uid[order], start[order]
    new = np.concatenate([[True], (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + 1)])
    index = np.arange(len(uid)) - np.maximum.accumulate(np.where(new, np.arange(len(uid)), 0))
    first = np.nonzero(new | (index % MOST == 0))[0]
    number = np.diff(np.append(first, len(uid)))
    return uid[first], start[first] * 256 + number


def copies(contexts: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, ...]:
    """Starts that repeat an earlier string among contexts (uid, span, bytes); and the firsts.

    Returns uid and start of the copies, then uid, start and position in the joined bytes of
    the first of each string, and the joined bytes.
    """
    joined = b"\n".join(b for _, _, b in contexts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(b) + 1 for _, _, b in contexts])
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    s = raw.astype(np.int64) + 2
    s[offset + lengths - 1] = 1
    number = np.array([span & 255 for _, span, _ in contexts])
    owner = np.repeat(np.arange(len(contexts)), number)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    at = offset[owner] + inner
    uid = np.array([u for u, _, _ in contexts], np.int64)[owner]
    start = np.array([span >> 8 for _, span, _ in contexts], np.int64)[owner] + inner
    which = np.full(len(raw), -1, np.int64)
    which[at] = np.arange(len(at))
    order = which[suffix_order(s, 258)]
    order = order[order >= 0]
    # Prefixes of neighbours, eight bytes at a time.
    spare = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(spare, 8)).view(np.uint64).ravel()
    one, two = at[order[:-1]], at[order[1:]]
    equal = np.ones(len(one), bool)
    for k in [*range(0, width - 7, 8), max(0, width - 8)]:
        equal &= eight[one + k] == eight[two + k]
    group = np.cumsum(np.concatenate([[0], ~equal]))
    by_age = np.lexsort((start[order], uid[order], group))
    order, group = order[by_age], group[by_age]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    rest, firsts = order[~first], order[first]
    return uid[rest], start[rest], uid[firsts], start[firsts], at[firsts], raw


def unique_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id and text; uid is unique and follows the documents' order.

    The id itself where it can be, else numbers given after sorting by (id, text hash).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    ids = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if not ids.take(1):
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    numbered = number_rows(rows.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], "uid")
    return numbered.select("uid", "doc_id", "text")


def anchored(rows: DataFrame, width: int) -> DataFrame:
    """(h, c, later, uid, span) of anchor occurrences; later: the batch holds the same earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(width)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                ids = batch.column("uid").to_numpy()
                found = [anchors.of(t) for t in as_bytes(batch.column("text"))]
                h, c, span = (np.concatenate([f[k] for f in found]) for k in range(3))
                uid = np.repeat(ids, [len(f[0]) for f in found])
                order = np.lexsort((span, uid, c, h))
                h, c, uid, span = h[order], c[order], uid[order], span[order]
                later = np.zeros(len(h), bool)
                later[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "c": c.view(np.int64), "later": later, "uid": uid, "span": span})

    return rows.select("uid", "text").mapInArrow(run, "h long, c long, later boolean, uid long, span long")


def compared(found: DataFrame, part: int) -> DataFrame:
    """Copies (part is null) and contexts to sort: rows arrive by h, c and age.

    Contexts of an anchor are numbered as they come; every ``part`` of them form a part.
    What a batch knew to be later
    comes last and is a copy in any case.  State is one pending row, whatever the number of occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = last_c = None
        number, pending = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, uid, span = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "c", "uid", "span"))
            new_h = np.concatenate([[h[0] != last_h], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[c[0] != last_c], c[1:] != c[:-1]])
            copy = ~new_c
            heads = np.nonzero(new_c)[0]
            out_h, out_part, out_uid, out_span = [h[copy]], [np.full(copy.sum(), -1)], [uid[copy]], [span[copy]]
            if len(heads):
                # Numbers of contexts within their anchor, going on from the batch before.
                fresh = new_h[heads]
                count = np.arange(len(heads)) - np.maximum.accumulate(np.where(fresh, np.arange(len(heads)), -1))
                lead = np.cumsum(fresh) == 0
                count[lead] = number + 1 + np.arange(lead.sum())
                follows = np.append(~fresh[1:], False)
                several = (count > 0) | follows
                several[-1] = count[-1] > 0
                if lead[0] and number == 0 and pending is not None:
                    out_h.append([pending[0]])
                    out_part.append([0])
                    out_uid.append([pending[1]])
                    out_span.append([pending[2]])
                some = heads[several]
                out_h.append(h[some])
                out_part.append(count[several] // part)
                out_uid.append(uid[some])
                out_span.append(span[some])
                number = int(count[-1])
                pending = (h[heads[-1]], uid[heads[-1]], span[heads[-1]])
            last_h, last_c = h[-1], c[-1]
            parts = np.concatenate(out_part).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "h": np.concatenate(out_h).astype(np.int64), "part": pa.array(parts, mask=parts < 0),
                    "uid": np.concatenate(out_uid).astype(np.int64), "span": np.concatenate(out_span).astype(np.int64),
                }
            )

    keyed = found.repartition("h").sortWithinPartitions("h", "c", "later", "uid", "span")
    return keyed.mapInArrow(run, "h long, part long, uid long, span long")


def with_bytes(rows: DataFrame, contexts: DataFrame, width: int) -> DataFrame:
    """(h, part, uid, span, bytes): the text of each context."""
    wanted = contexts.groupBy("uid").agg(F.collect_list(F.struct("h", "part", "span")).alias("wanted")).withColumnRenamed("uid", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            lists = batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            h, part, span = lists.flatten().flatten()
            spans = span.to_numpy().tolist()
            found = [texts[i][s >> 8 : (s >> 8) + (s & 255) - 1 + width] for i, s in zip(owner.tolist(), spans, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"h": h, "part": part, "uid": batch.column("uid").take(pa.array(owner)), "span": span, "bytes": pa.array(found, pa.binary())}
            )

    return rows.join(wanted, rows["uid"] == wanted["of"]).select("uid", "text", "wanted").mapInArrow(run, "h long, part long, uid long, span long, bytes binary")


def sorted_copies(contexts: DataFrame, width: int, part: int, chunk: int = 900_000) -> DataFrame:
    """(uid, span) of copies, and (w, uid, span) of strings that are first in a part of a divided anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group, last = [], 0, [], None

        def work(some: list, divided: bool) -> pa.RecordBatch:
            uid, start, uid1, start1, at1, raw = copies(some, width)
            uid, span = spans_of(uid, start)
            w = [None] * len(uid)
            if divided:
                whole = raw.tobytes()
                w += [xxh3_128_digest(whole[a : a + width]) for a in at1.tolist()]
                uid, span = np.concatenate([uid, uid1]), np.concatenate([span, start1 * 256 + 1])
            return pa.RecordBatch.from_pydict({"w": pa.array(w, pa.binary()), "uid": uid, "span": span})

        def close() -> Iterator[pa.RecordBatch]:
            # A full part, or a later one, has siblings in other tasks.
            nonlocal held, size, group
            if group and (len(group) == part or last[1] > 0):
                yield work(group, True)
            else:
                held += group
                size += sum(len(b) + 1 for _, _, b in group)
            group = []
            if size > chunk // 2:
                yield work(held, False)
                held, size = [], 0

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("h", "part", "uid", "span", "bytes"))
            for h, p, uid, span, b in zip(*columns, strict=True):
                if (h, p) != last:
                    yield from close()
                    last = (h, p)
                group.append((uid, span, b))
        yield from close()
        if held:
            yield work(held, False)

    dealt = contexts.repartition("h", "part").sortWithinPartitions("h", "part")
    return dealt.mapInArrow(run, "w binary, uid long, span long")


def remove_repeats(docs: DataFrame, width: int = 100, part: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    ``part`` bounds how many contexts of one anchor a task sorts at once.
    """
    rows = unique_rows(docs, id_col, text_col)
    found = anchored(rows, width)
    judged = kept(compared(found, part))
    contexts = with_bytes(rows, judged.where("part is not null"), width)
    # Parts are of bounded length: width + 255 bytes a context.
    ordered = kept(sorted_copies(contexts, width, part))
    firsts = ordered.where("w is not null")
    least = firsts.groupBy("w").agg(F.min(F.struct("uid", "span")).alias("first"))
    again = firsts.join(least, "w").where(F.struct("uid", "span") > F.col("first")).select("uid", "span")
    spans = judged.where("part is null").select("uid", "span").unionByName(ordered.where("w is null").select("uid", "span")).unionByName(again)
    gone = spans.groupBy("uid").agg(F.collect_list("span").alias("spans")).withColumnRenamed("uid", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests, kept = [], [], [], []
            texts = as_bytes(batch.column("text"))
            for text, some in zip(texts, batch.column("spans"), strict=True):
                if not some.is_valid:
                    left, n, parts = text, 0, 0
                else:
                    s = some.values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, s >> 8, 1)
                    np.add.at(edge, (s >> 8) + (s & 255) - 1 + width, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    left = np.frombuffer(text, np.uint8)[keep].tobytes()
                    n, parts = len(text) - len(left), int((~keep[1:] & keep[:-1]).sum() + (not keep[0]))
                removed.append(n)
                runs.append(parts)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary()),
                }
            )

    joined = rows.join(gone, rows["uid"] == gone["of"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
