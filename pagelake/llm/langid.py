"""Language identification by words first, then shorter and shorter character n-grams.

A known word votes with its log frequency in each language.  An unseen word backs off: the
n-grams of the longest length at which any of its (edge-marked) n-grams is known vote
instead, and an entirely unknown word votes for nothing.  Log frequencies are smoothed per
language; votes are averaged over the text's words, and the score is the winner's share
after exponentiation.

Words are runs of letters (category L), lower-cased.  A null text, or one without letters, is ``und``
with score 0.  Texts or languages that are null are not learned from.  Every input row gives
one output row; ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pagelake.llm.common import Memo, check_remainder, forget, kept, text_column
from pagelake.operators.dedup import first_per_key

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Character n-gram lengths, the longest first.
ORDERS = (4, 3, 2, 1)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters. Numbers that are no digits, as fractions, are no letters."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for w in found for alpha, run in groupby(w, str.isalpha) if alpha]


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its edge marks; the marks alone are no 1-gram."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Table:
    """Vectors of log frequencies by term. Terms are held as 64-bit hashes, so that a table of all words stays small."""

    def __init__(self, size: int, hashes: np.ndarray, vectors: np.ndarray):
        self.size, self.vectors = size, vectors
        self.rows = dict(zip(hashes.tolist(), range(len(hashes)), strict=True))

    def get(self, term: str) -> np.ndarray | None:
        row = self.rows.get(xxh3_64_intdigest(term, self.size))
        return None if row is None else self.vectors[row]


def learn(
    docs: DataFrame,
    fit_rows_per_language: int = 4000,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
) -> dict:
    """Log frequencies of all words and n-grams, as hashes and vectors by n-gram length.

    Each language is learned from at most ``fit_rows_per_language`` different rows, chosen by a
    hash of the id; all their words are kept, so the model grows with the number of languages
    and not with the corpus. Equal rows count once; rows that share an id are learned each with its
    own language.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    marked = usable.withColumn("w", F.xxhash64("text"))
    named = marked.select("id", "lang", "w").distinct().withColumn("h", F.xxhash64("id"))
    chosen = kept(first_per_key(named, ["lang"], ["h", "id", "w"], fit_rows_per_language).select("id", "lang", "w"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.lang") == F.col("b.lang")) & (F.col("a.w") == F.col("b.w"))
    rows = marked.alias("a").join(chosen.alias("b"), same, "left_semi").dropDuplicates(["id", "lang", "w"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in words_of(text):
                    found[lang, w] = found.get((lang, w), 0) + 1
            out = {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": pa.array(found.values(), pa.int64())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) if k != "n" else v for k, v in out.items()})

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for size in ORDERS:
                    for g in grams(word, size):
                        found[lang, size, g] = found.get((lang, size, g), 0) + n
            keys = list(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in keys], pa.string()), "size": pa.array([k[1] for k in keys], pa.int32()),
                    "term": pa.array([k[2] for k in keys], pa.string()), "n": pa.array([found[k] for k in keys], pa.int64()),
                }
            )

    words = kept(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    parts = words.mapInArrow(gram_counts, "lang string, size int, term string, n long").groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))
    terms = kept(words.select("lang", F.lit(0).alias("size"), F.col("word").alias("term"), "n").unionByName(parts))
    totals = {(r["lang"], r["size"]): r["n"] for r in terms.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    place = {lang: i for i, lang in enumerate(langs)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, packed = [], []
            for size, term, by in zip(*(batch.column(c).to_pylist() for c in ("size", "term", "by")), strict=True):
                n = np.zeros(len(langs))
                for entry in by:
                    n[place[entry["lang"]]] = entry["n"]
                # Half a count for a language that lacks the term keeps its log finite.
                hashes.append(xxh3_64_intdigest(term, size))
                packed.append((np.log(n + 0.5) - bases[size]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({"size": batch.column("size"), "h": np.array(hashes, np.uint64).view(np.int64), "v": pa.array(packed, pa.binary())})

    bases = {size: np.log(np.array([totals.get((lang, size), 0) + 1.0 for lang in langs])) for size in (0, *ORDERS)}
    by_term = terms.groupBy("size", "term").agg(F.collect_list(F.struct("lang", "n")).alias("by"))  # one entry a language
    found = by_term.mapInArrow(vectors, "size int, h long, v binary").toArrow()
    tables = {}
    for size in (0, *ORDERS):
        mine = found.filter(pa.compute.equal(found["size"], size)).combine_chunks()
        packed = b"".join(mine["v"].to_pylist())
        tables[size] = (mine["h"].to_numpy().view(np.uint64), np.frombuffer(packed, "<f4").reshape(mine.num_rows, len(langs)))
    forget(chosen, words, terms)
    return {"langs": langs, "tables": tables}


def vote(word: str, tables: dict[int, Table] | dict[int, dict[str, np.ndarray]]) -> np.ndarray | None:
    """A word's log frequencies by language, from the first table that knows it or part of it."""
    known = tables[0].get(word)
    if known is not None:
        return known
    for size in ORDERS:
        found = [v for g in grams(word, size) if (v := tables[size].get(g)) is not None]
        if found:
            return np.mean(found, axis=0)
    return None


def predict(docs: DataFrame, model: dict, known: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value["langs"]
        tables = {size: Table(size, *packed) for size, packed in shared.value["tables"].items()}
        memo = Memo(known)
        nothing = np.zeros(len(langs), np.float32)
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not words or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                for w in memo.missing(set(words)):
                    v = vote(w, tables)
                    memo.young[w] = nothing if v is None else v
                votes = np.array([memo.young[w] for w in words], np.float32).sum(0, dtype=np.float64) / len(words)
                share = np.exp(votes - votes.max())
                best = int(share.argmax())
                names.append(langs[best])
                scores.append(float(share[best] / share.sum()))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            )

    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, divisor: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows outside one remainder of the id's checksum, predict every row."""
    held = check_remainder(id_col, divisor) == held_out
    model = learn(docs.where(~held), text_col=text_col, lang_col=lang_col, id_col=id_col)
    return predict(docs, model, id_col=id_col, text_col=text_col).select(
        "doc_id", (check_remainder("doc_id", divisor) == held_out).alias("held_out"), "lang_pred", "score"
    )
