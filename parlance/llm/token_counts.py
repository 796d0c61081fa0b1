"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie over bytes.  Following Song et al. (2021), every node has a failure link to
the node of what is left after the longest pieces were taken from its string, and the number of
pieces popped on the way, so a word is counted in one pass over its bytes, without backtracking and
without building pieces.  A word is preceded by the vocabulary's word mark; bytes that no piece holds
count one each (byte fallback), so every word has a length.

A worker keeps the lengths of short words it has met in a bounded store.

Edge cases: null and blank texts have no words and no pieces; a word of any length is counted whole;
repeated rows get equal values; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

MARK = "▁".encode()  # precedes each word in the vocabulary
KEPT_WORDS, KEPT_BYTES = 1 << 19, 48


class Automaton:
    """Counts the pieces of greedy longest match, left to right, over a vocabulary of byte strings."""

    def __init__(self, vocabulary: list[bytes]):
        self.child: dict[int, int] = {}
        final = [False]
        for piece in [*vocabulary, *(bytes([b]) for b in range(256))]:
            node = 0
            for byte in piece:
                step = node << 8 | byte
                if step not in self.child:
                    self.child[step] = len(final)
                    final.append(False)
                node = self.child[step]
            final[node] = True
        final[0] = False
        self.fail, self.popped = [0] * len(final), [0] * len(final)
        below: list[list[tuple[int, int]]] = [[] for _ in final]
        for step, node in self.child.items():
            below[step >> 8].append((step & 255, node))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, to in below[node]:
                queue.append(to)
                if final[to]:
                    self.popped[to] = 1  # the whole string is a piece; nothing is left
                    continue
                at, popped = self.fail[node], self.popped[node]
                while at << 8 | byte not in self.child:
                    popped += self.popped[at]
                    at = self.fail[at]
                self.fail[to], self.popped[to] = self.child[at << 8 | byte], popped

    def count(self, text: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for byte in text:
            to = child.get(node << 8 | byte)
            while to is None:
                total += popped[node]
                node = fail[node]
                to = child.get(node << 8 | byte)
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


class Lengths(dict):
    """Word to number of pieces, counted by need."""

    def __init__(self, automaton: Automaton, mark: bytes):
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model, without control, unknown and byte tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(2)
def lengths(path: str) -> Lengths:
    return Lengths(Automaton(read_vocabulary(path)), MARK)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    of = lengths(path)
    for batch in batches:
        data, offs = text_bytes(batch["text"])
        words, pieces = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            found = data[a:b].tobytes().split()
            words[i], pieces[i] = len(found), sum(map(of.__getitem__, found))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words), pa.array(pieces)], ["doc_id", "n_words", "n_pieces"])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_pieces) of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_count, path=path or default_path()), "doc_id long, n_words long, n_pieces long")
