"""Packing documents into fixed windows by minimum bin slack.

Every document becomes its token ids and one end id.  Full windows are cut off first; what
remains of each document is a piece shorter than a window.  The pieces of one shard (a hash
of the document, so that no shard follows a hot source) are packed window by window: a
bitset holds every sum that the remaining lengths can reach, the longest piece is placed,
and the multiset of lengths whose sum comes closest to the capacity is read back from the
bitsets with its counts, then used as often as the remaining counts allow.  What a shard
cannot fill to a full window at its end is cut into powers of two, which need no padding.

Null text counts as empty (one piece: the end id).  Rows are packed one by one, so repeated
rows and equal or null ids are each packed; an empty table gives no rows.  Only the id and
text columns are read, whatever else the table holds.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Memo, blocks, coded_parts, text_column

CUTS = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("shard", pa.int64()), ("ids", pa.binary()),
    ]
)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

PUNCTUATION = string.punctuation


class Tokenizer:
    """Token ids of whole texts as packed 32-bit integers.

    The vocabulary drops white space and never joins across it, so a text's ids are those of
    its white-space separated parts, each of which is tokenised once and remembered.
    """

    def __init__(self, path: str, known: int = 300_000):
        # One task is one thread; the library's own threads would take other tasks' cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Native

        self.native, self.memo = Native.from_file(path), Memo(known)
        # For words: no steps before the model but to part them and to write bytes as characters.
        shape = json.loads(self.native.to_str())
        steps = [{"type": "WhitespaceSplit"}, *(s for s in shape["pre_tokenizer"]["pretokenizers"] if s["type"] == "ByteLevel")]
        bare = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "added_tokens": []}
        self.words = Native.from_str(json.dumps(shape | bare))
        self.marks: dict[str, bytes] = {}
        # A word's last id, and no other of its ids, stands for an ending.
        ending = [i for t, i in self.native.get_vocab(False).items() if t.endswith(shape["model"]["end_of_word_suffix"])]
        self.ending = np.zeros(max(ending) + 1, bool)
        self.ending[ending] = True

    def word_of(self, part: str) -> tuple[str, str] | None:
        """A part's letters in lower case and the punctuation after them, where the tokenizer does nothing else to it."""
        stem = part.rstrip(PUNCTUATION)
        if not stem.isalpha() or "<|" in part:
            return None
        if not stem.isascii():
            if not is_normalized("NFC", stem):
                return None
            low = stem.lower()
            # Up to here lower-casing is a matter of single letters; the tokenizer's own may differ beyond.
            if low != stem and (max(stem) >= "\u0250" or "\u0130" in stem):
                return None
            stem = low
        return stem, part[len(stem) :]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of parts; lower-case ASCII ones are looked up as they are, what is not known is worked out once."""
        packed = list(map(self.memo.young.get, parts))
        absent = [i for i, ids in enumerate(packed) if ids is None]
        new = self.memo.missing(dict.fromkeys(map(parts.__getitem__, absent)))
        known, words, others = self.memo.young, {}, []
        for part in new:
            word = (part, "") if part.isascii() and part.isalpha() else self.word_of(part)
            if word is None:
                others.append(part)
            else:
                words[part] = word
        ids = self.ids_of_words(list(dict.fromkeys(w for w, _ in words.values())))
        for part, (word, marks) in words.items():
            known[part] = ids[word] + self.ids_of_marks(marks) if marks else ids[word]
        for i in range(0, len(others), 4096):
            some = others[i : i + 4096]
            for part, e in zip(some, self.native.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[part] = np.array(e.ids, "<u4").tobytes()
        for i in absent:
            packed[i] = known[parts[i]]
        return packed

    def ids_of_marks(self, marks: str) -> bytes:
        """The ids of a run of punctuation, which is one pre-token."""
        ids = self.marks.get(marks)
        if ids is None:
            ids = np.array(self.native.encode(marks, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.marks) < 10_000:
                self.marks[marks] = ids
        return ids

    def ids_of_words(self, words: list[str], run: int = 256) -> dict[str, bytes]:
        """The ids of lower-case words, asked for by runs of words and cut where words end."""
        runs = [" ".join(words[i : i + run]) for i in range(0, len(words), run)]
        # One run at a time: what the library holds besides the ids is freed at once.
        found = (self.words.encode_batch_fast([r], add_special_tokens=False)[0].ids for r in runs)
        ids = np.fromiter(chain.from_iterable(found), "<u4")
        ends, packed = (4 * np.nonzero(self.ending[ids])[0] + 4).tolist(), ids.tobytes()
        return dict(zip(words, (packed[i:j] for i, j in pairwise([0, *ends])), strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; memory follows the size of all of them together."""
        parts, at, bounds = coded_parts(texts)
        ids = self.ids_of(lowered(parts))
        pool = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(length) - length
        ends = np.concatenate([[0], np.cumsum(length[at])])
        flat = pool[np.repeat(first[at] - ends[:-1], length[at]) + np.arange(ends[-1])]
        return [flat[i:j].tobytes() for i, j in pairwise(ends[bounds].tolist())]


def lowered(parts: list[str]) -> list[str]:
    """Parts of ASCII characters in lower case, which is the tokenizer's own first step; special ids are matched before it."""
    column = pa.array(parts, pa.large_string())
    plain = pc.and_(pc.string_is_ascii(column), pc.invert(pc.match_substring(column, "<|")))
    return pc.if_else(plain, pc.ascii_lower(column), column).to_numpy(zero_copy_only=False).tolist()


@lru_cache(1)
def tokenizer_at(path: str) -> Tokenizer:
    """One tokenizer for all tasks of a Python worker, with what it remembers."""
    return Tokenizer(path)


def bin_slack(counts: Counter, capacity: int) -> tuple[list[int], int]:
    """The multiset of lengths with the longest one in it that fills the capacity best, and its uses.

    Bit s of a bitset says that some multiset sums to s.  Lengths enter from the longest
    down, in binary parts of their counts, until the capacity is reached.
    """
    first = max(counts)
    room = capacity - first
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    if room:
        for length in sorted((x for x in counts if x <= room), reverse=True):
            left, part = min(counts[length] - (length == first), room // length), 1
            while left > 0 and not reach >> room & 1:
                take = min(part, left)
                steps.append((length, take, reach))
                reach |= reach << length * take & mask
                left, part = left - take, part * 2
            if reach >> room & 1:
                break
    at, chosen = reach.bit_length() - 1, [first]
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    used = Counter(chosen)
    return chosen, min(counts[x] // n for x, n in used.items())


def pack_shard(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (by index) to windows: lists of (index, from, length); pieces are cut only at the end.

    Two or more windows that stay short are put end to end and cut into full windows, and
    the last short one into powers of two.
    """
    stacks: dict[int, list[int]] = defaultdict(list)
    for i in reversed(range(len(lengths))):
        stacks[lengths[i]].append(i)
    counts = Counter(lengths)
    windows, short = [], []
    while counts:
        chosen, times = bin_slack(counts, capacity)
        full = sum(chosen) == capacity
        for _ in range(times):
            (windows if full else short).append([(stacks[x].pop(), 0, x) for x in chosen])
        for x in chosen:
            counts[x] -= times
            if not counts[x]:
                del counts[x]
    loose = [piece for w in short for piece in w]
    total = sum(n for _, _, n in loose)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    for room in sizes:
        window = []
        while room:
            i, at, n = loose.pop()
            take = min(n, room)
            window.append((i, at, take))
            room -= take
            if take < n:
                loose.append((i, at + take, n - take))
        windows.append(window)
    return windows


def shard_count(docs: DataFrame, rows_per_shard: int) -> int:
    """Shards by the number of rows, at least one."""
    return max(1, -(-docs.count() // rows_per_shard))


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    rows_per_shard: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it comes from, its ids' checksum, and where it lies.

    ``rows_per_shard`` is how many documents are packed together; it bounds a task's memory
    (their remainders, under a window each).  A window's id is the shard's number times
    2**32 plus its number there.  Windows cut off a document whole are numbered the same way.
    """
    shards = shard_count(docs, rows_per_shard)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_at(tokenizer)
        for block in blocks(batches, "text"):
            out = {name: [] for name in CUTS.names}
            ids = block.column("doc_id").to_pylist()
            for doc_id, packed in zip(ids, tokens.encode(block.column("text")), strict=True):
                packed += end
                n, whole = len(packed) // 4, zlib.crc32(packed)
                for start in range(0, n, capacity):
                    piece = packed[4 * start : 4 * (start + capacity)]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(n)
                    out["shard"].append((whole ^ zlib.crc32(str(doc_id).encode())) % shards)
                    # Only what may be cut further needs its ids later.
                    out["ids"].append(b"" if len(piece) == 4 * capacity else piece)
            yield pa.RecordBatch.from_pydict(out, schema=CUTS)

    cuts = rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard long, ids binary")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = cuts.repartition(max(int(parts), 1), "shard").sortWithinPartitions("shard", "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(_packer(capacity), PIECES)


def _packer(capacity: int) -> Callable:
    def place(shard: int, rows: list[tuple]) -> dict:
        out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        number = shard << 32

        def put(row: tuple, at: int, n: int, offset: int) -> None:
            doc_id, start, length, crc, doc_tokens, ids = row
            crc = crc if n == length else zlib.crc32(ids[4 * at : 4 * (at + n)])
            for name, v in zip(out, (doc_id, start + at, n, crc, doc_tokens, number, offset), strict=True):
                out[name].append(v)

        for row in rows:
            if row[2] == capacity:
                put(row, 0, capacity, 0)
                number += 1
        rest = [r for r in rows if r[2] < capacity]
        for window in pack_shard([r[2] for r in rest], capacity):
            offset = 0
            for i, at, n in window:
                put(rest[i], at, n, offset)
                offset += n
            number += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
            for shard, *row in zip(batch.column("shard").to_pylist(), *(batch.column(c).to_pylist() for c in names), strict=True):
                if shard != current and rows:
                    yield pa.RecordBatch.from_pydict(place(current, rows))
                    rows = []
                current = shard
                rows.append(row)
        if rows:
            yield pa.RecordBatch.from_pydict(place(current, rows))

    return run
