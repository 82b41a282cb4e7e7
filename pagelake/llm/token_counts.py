"""Token counts by unigram scores over a trie of pre-tokens.

The distinct pre-tokens (runs between white space, with a leading word mark) are put into a
trie in sorted order.  A node holds the forward score of its prefix: the best sum of piece
scores that spell it, and how many pieces that takes.  Sharing a prefix means sharing these,
so every prefix is scored once; terminal nodes store the counts, and a text's count is the
sum over its pre-tokens.

Characters that no piece covers cost one token each.  Ties in score go to fewer pieces.
Null and empty texts have no tokens.  Every row gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Memo, blocks, coded_parts, text_column

MARK = "▁"
#: Score of a character that no piece covers, below that of any piece.
UNCOVERED = -40.0


def pieces_of(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file and their log shares by rank (the rank-frequency rule)."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    normal = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return {p.id_to_piece(i): -math.log(rank + 2.0) for rank, i in enumerate(normal)}


class Trie:
    """Forward scores along the path of the sorted pre-token being inserted.

    Sorted insertion visits the trie depth first, so the nodes of one path are all that must
    be kept; nodes of the common prefix with the pre-token before are reused as they are.
    """

    def __init__(self, pieces: dict[str, float]):
        # Every ending of a piece, with the score where it is a piece itself.
        self.endings: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(len(p))} | pieces
        self.path = ""
        self.nodes: list[tuple[float, int]] = [(0.0, 0)]
        self.scored = 0

    def insert(self, word: str) -> int:
        """The token count of a pre-token's best segmentation."""
        shared, most = 0, min(len(word), len(self.path))
        while shared < most and word[shared] == self.path[shared]:
            shared += 1
        nodes, endings = self.nodes, self.endings
        del nodes[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            score, n = nodes[end - 1]
            best = (score + UNCOVERED, -n - 1)
            for start in range(end - 1, -1, -1):
                own = endings.get(word[start:end], 0.0)
                if own == 0.0:  # no piece ends so
                    break
                if own is not None:
                    score, n = nodes[start]
                    best = max(best, (score + own, -n - 1))
            nodes.append((best[0], -best[1]))
        self.scored += len(word) - shared
        self.path = word
        return nodes[-1][1]


def count_tokens(docs: DataFrame, vocabulary: str, known: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row.

    A task keeps the counts of up to twice ``known`` pre-tokens; of the trie only the current
    path exists.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = Trie(pieces_of(vocabulary)), Memo(known)
        for block in blocks(batches, "text", 4 << 20):
            parts, at, bounds = coded_parts(block.column("text"))
            for word in sorted(memo.missing(set(parts) - {""})):
                memo.young[word] = trie.insert(MARK + word)
            tokens = np.array([memo.young[p] if p else 0 for p in parts], np.int64)
            real = np.array([p != "" for p in parts], np.int64)
            counts = [np.concatenate([[0], np.cumsum(each[at])])[bounds] for each in (real, tokens)]
            words, tokens = (np.diff(c).astype(np.int64) for c in counts)
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "n_pretokens": words, "n_tokens": tokens})

    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
