"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators of n-grams (words, word pairs, word shapes, shape pairs, words that repeat) are
hashed into a fixed number of slots.  Each slot is scaled by the log ratio of its smoothed
share in the two classes, and a linear hinge-loss model over the scaled indicators is fitted
by dual coordinate descent.  The fitted weights, already multiplied with the ratios, are one
array of fixed size that every task gets.

Null and empty texts have no n-grams and get the model's bias as score.  Labels that are
null are not learned from; without labels of both classes every score is 0.5.  Each input
row gives one output row, repeated rows and null ids included.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pagelake.llm.common import Memo, as_bytes, blocks, check_remainder, mix, per_batch, small_batches, text_column

#: Shares of a text's n-grams from which a shape has a further indicator.
LEVELS = (0.02, 0.1, 0.3, 0.6)
_RUNS = (
    (re.compile(rb"[A-Z]{2,}"), b"U"), (re.compile(rb"[A-Z]"), b"u"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"),
    (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+"), rb"\1\1"),
)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(word: bytes) -> bytes:
    """Runs of capitals, letters, digits and marks, each in short."""
    for pattern, short in _RUNS:
        word = pattern.sub(short, word)
    return word


class Indicators:
    """Slots of the n-gram indicators of a text; a known word's two hashes are 16 bytes."""

    def __init__(self, bits: int, known: int = 100_000):
        self.mask, self.memo = np.uint64((1 << bits) - 1), Memo(known)

    def slots(self, text: bytes) -> np.ndarray:
        parts = text.split()
        if not parts:
            return np.empty(0, np.int64)
        memo = self.memo
        for p in memo.missing(set(parts)):
            memo.young[p] = struct.pack("=QQ", xxh3_64_intdigest(p.lower()), xxh3_64_intdigest(shape(p), 7))
        pairs = np.frombuffer(b"".join([memo.young[p] for p in parts]), np.uint64).reshape(-1, 2)
        words, shapes = pairs[:, 0], pairs[:, 1]
        found = [mix(words), mix(words[:-1] * _A + words[1:])]
        same = np.zeros(len(parts), np.uint64)
        for back in (1, 2, 3, 4):
            same[back:] |= (words[back:] == words[:-back]).astype(np.uint64) << np.uint64(back)
        for salt, grams in ((1, shapes), (2, shapes[:-1] * _A + shapes[1:]), (3, same)):
            kinds, n = np.unique(grams, return_counts=True)
            kinds = mix(kinds * _B + np.uint64(salt))
            found.append(kinds)
            for k, level in enumerate(LEVELS):
                found.append(mix(kinds[n >= level * len(parts)] + np.uint64(k + 1)))
        return np.unique((np.concatenate(found) & self.mask).astype(np.int64))


def fit_support_vectors(
    rows: list[np.ndarray], labels: np.ndarray, slots: int, cost: float = 1.0, rounds: int = 20, seed: int = 13
) -> tuple[np.ndarray, float]:
    """Weights (ratios times hinge-loss weights) and bias.

    Dual coordinate descent: one dual variable per row, each step solves its own variable
    exactly within [0, cost].  The rarer class gets the larger cost.  Rows are scaled to
    unit length.
    """
    weight, bias = np.zeros(slots), 0.0
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([(y < 0).sum(), (y > 0).sum()])
    if not share.all():
        return weight, bias
    counts = np.ones((2, slots))
    for x, s in zip(rows, y, strict=True):
        counts[int(s > 0), x] += 1
    counts /= counts.sum(1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    scale = np.array([1 / max(np.sqrt((ratio[x] ** 2).sum()), 1e-12) for x in rows])
    costs = np.where(y > 0, cost * share.sum() / (2 * share[1]), cost * share.sum() / (2 * share[0]))
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = rows[i]
            values = ratio[x] * scale[i]
            gradient = y[i] * (weight[x] @ values + bias) - 1
            square = values @ values + 1
            new = min(max(alpha[i] - gradient / square, 0.0), costs[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weight[x] += step * values
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight * ratio, bias


def train(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 18,
    fit_rows: int = 12_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, ratios' squares, bias) from at most ``fit_rows`` labelled rows, chosen by a hash of the id.

    The bound is what keeps the join's small side (an id and a label per row) and the one
    fitting task small, however large the tables are.
    """
    slots = 1 << bits
    some = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), text_column(docs, text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("slots", pa.binary())])

    def gather():
        features = Indicators(bits)

        def handle(batch: pa.RecordBatch) -> dict:
            found = [features.slots(t).astype("<i4").tobytes() for t in as_bytes(batch.column("text"))]
            return {"id": batch.column("id"), "label": batch.column("label"), "slots": found}

        return handle

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [r for b in batches for r in b.to_pylist()]
        table.sort(key=lambda r: (r["id"], r["slots"]))
        found = [np.frombuffer(r["slots"], "<i4") for r in table]
        y = np.array([r["label"] for r in table])
        weight, bias = fit_support_vectors(found, y, slots)
        square = np.zeros(slots)
        if weight.any():
            counts = np.ones((2, slots))
            for x, s in zip(found, y, strict=True):
                counts[int(s > 0), x] += 1
            counts /= counts.sum(1, keepdims=True)
            square = np.log(counts[1] / counts[0]) ** 2
        yield pa.RecordBatch.from_pydict({"weight": [weight.tobytes()], "square": [square.tobytes()], "bias": [bias]})

    labelled = rows.join(F.broadcast(some), "id").select("id", "label", "text")
    with small_batches(docs.sparkSession):
        model = (
            labelled.mapInArrow(per_batch(gather, schema), "id long, label int, slots binary")
            .repartition(1).mapInArrow(fit, "weight binary, square binary, bias double").collect()
        )
    if not model:
        return np.zeros(slots), np.zeros(slots), 0.0
    return np.frombuffer(bytes(model[0].weight)), np.frombuffer(bytes(model[0].square)), model[0].bias


def score(
    docs: DataFrame,
    model: tuple[np.ndarray, np.ndarray, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id and score in 0..1 (0.5 on the separating plane), with further columns of the row.

    Python gets the text alone and gives the score alone; what is kept stays where it is.
    """
    weight, square, bias = model
    bits = len(weight).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((weight, square))

    @F.arrow_udf("double")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, q = shared.value
        features = Indicators(bits)
        for text in texts:
            scores = []
            for block in blocks(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
                for t in as_bytes(block.column("text")):
                    x = features.slots(t)
                    margin = w[x].sum() / max(np.sqrt(q[x].sum()), 1e-12) + bias if len(x) else bias
                    scores.append(1 / (1 + np.exp(-np.clip(2 * margin, -500, 500))))
            yield pa.array(scores, pa.float64())

    kept = [F.struct(*keep).alias("kept")] if keep else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, judge(text_column(docs, text_col)).alias("score"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    divisor: int = 3,
    held_out: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Learn from the labels outside one remainder of the id's checksum, score every row."""
    held = check_remainder(id_col, divisor) == held_out
    model = train(docs, labels.where(~held), id_col=id_col, text_col=text_col, label_col=label_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(
        "doc_id",
        (check_remainder("doc_id", divisor) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
