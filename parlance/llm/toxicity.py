"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word between, each with
the words as they stand and with the words freed of ASCII punctuation at both ends ("scum!!" is also "scum").
Training (McMahan et al. 2013) keeps a gradient sum and a squared-gradient sum for every
coordinate, so each has its own rate, and the L1 term leaves most weights at zero; what is
left is a short list that is broadcast for scoring.  ``SLOTS`` bounds it.

The classifier is fitted in one task on at most about ``TRAIN_ROWS`` labelled rows, chosen by a
hash of the id; scoring covers every row and every whole text.

Edge cases: null and blank texts have no features and get the score of the bias; rows with a
null label train nothing; with no training row every score is ``PRIOR``; several labels of one
document train as several rows; repeated rows get equal scores; other columns are ignored; an
empty table gives an empty result.  A null id counts as the empty text in the fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, gram_hashes, mix, slices, word_hashes, word_spans

BITS = 20
SLOTS = 1 << BITS  # bound of the weight list
TRAIN_ROWS = 12_000  # bound of the labelled sample
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.5, 0.1
PRIOR = 0.1  # share of toxic texts assumed at the start of training

_SKIP = np.uint64(0x9E6C63D0876A9A47)
_SHIFT = np.uint64(64 - BITS)
_SOLID = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])  # bytes of letters and digits; all of other scripts


def bare_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII punctuation at their ends, and where they differ; words of nothing else stay whole."""
    solid = np.flatnonzero(_SOLID[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    new = np.flatnonzero(low < high)
    first, last = solid[low[new]], solid[high[new] - 1] + 1
    cut = (first > starts[new]) | (last < ends[new])
    new, first, last = new[cut], first[cut], last[cut]
    bare, differs = words.copy(), np.zeros(len(words), bool)
    bare[new], differs[new] = word_hashes(data, first, last), True
    return bare, differs


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each slice of rows: row of each feature, its slot, and the number of rows (with repeats)."""
    for _, _, data, offs in slices(column):
        starts, ends, bounds = word_spans(data, offs)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
        words = word_hashes(data, starts, ends)
        slots, rows = [], []
        for hashes, new in ((words, None), bare_words(data, starts, ends, words)):
            for gap, hashed in enumerate((hashes, gram_hashes(hashes, 2), mix(hashes[:-2] * np.uint64(3) + hashes[2:] * _SKIP) if len(hashes) > 2 else hashes[:0])):
                last = len(row) - gap
                use = row[: max(last, 0)] == row[gap:]
                if new is not None:
                    use &= new[: max(last, 0)] | new[gap:]
                slots.append((hashed >> _SHIFT)[use])
                rows.append(row[: max(last, 0)][use])
        yield np.concatenate(rows), np.concatenate(slots).astype(np.int64), len(offs) - 1


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row, slot, n in features(batch["text"]):
            keys = np.unique(row * SLOTS + slot)
            edges = np.searchsorted(keys, np.arange(n + 1) * SLOTS)
            found += [(keys[a:b] & (SLOTS - 1)).astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["y"], pa.array(found, pa.binary())], ["key", "y", "slots"])


class Ftrl:
    """Per-coordinate FTRL-proximal; slot SLOTS is the bias, which has no L1 term."""

    def __init__(self):
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
        self.z[SLOTS] = -np.log(PRIOR / (1 - PRIOR)) * (BETA / ALPHA + L2)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at == SLOTS
        small = np.sign(z) * np.maximum(np.abs(z) - np.where(free, 0, L1), 0)
        return -small / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, y: int) -> None:
        at = np.append(slots, SLOTS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((k, y, s) for b in batches for k, y, s in zip(b["key"].to_pylist(), b["y"].to_pylist(), b["slots"].to_pylist(), strict=True))
    model = Ftrl()
    for epoch in range(EPOCHS):
        order = np.argsort(mix(np.arange(len(rows), dtype=np.uint64) + np.uint64(epoch << 32)))
        for i in order.tolist():
            model.learn(np.frombuffer(rows[i][2], np.int32).astype(np.int64), rows[i][1])
    w = model.weights(np.arange(SLOTS + 1))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["slot", "weight"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights, learnt from rows of ``docs`` that have a label."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    rows = labels.count()
    share = min(1.0, TRAIN_ROWS / max(rows, 1))
    sample = F.broadcast(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))  # bounded by TRAIN_ROWS
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id").select(F.xxhash64("doc_id").alias("key"), "y", "text")
    fitted = texts.mapInArrow(_examples, "key long, y int, slots binary").repartition(1).mapInArrow(_fit, "slot int, weight double").toArrow()
    if not fitted.num_rows:  # no training row at all
        return np.array([SLOTS]), np.array([np.log(PRIOR / (1 - PRIOR))])
    return fitted["slot"].to_numpy().astype(np.int64), fitted["weight"].to_numpy()


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The score of each text; ``weights`` has SLOTS entries and the bias."""
    out = []
    for row, slot, n in features(column):
        used = weights[slot] != 0
        keys = np.unique(row[used] * SLOTS + slot[used])
        total = np.bincount(keys // SLOTS, weights[keys & (SLOTS - 1)], n) + weights[SLOTS]
        out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def _dense(model) -> np.ndarray:
    at, w = model.value
    weights = np.zeros(SLOTS + 1)
    weights[at] = w
    return weights


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weights = _dense(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores(batch["text"], weights))], ["doc_id", "held_out", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model, below: float) -> Iterator[pa.RecordBatch]:
    weights = _dense(model)
    for batch in batches:
        yield batch.filter(pa.array(scores(batch["text"], weights) < below))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_score, model=shared), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is less than ``below``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_keep, model=shared, below=below), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled rows whose fold by 5 is not 0 and scores every row."""
    return score(docs, train(docs, labels.where(fold(F.col("doc_id"), 5) != 0)))
