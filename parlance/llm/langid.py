"""Language identification by hyperdimensional profiles.

Every letter (lower-cased code point; a run of anything else is one blank) has a random vector
of +1 and -1 that depends on its code point alone.  A letter n-gram is bound by multiplying its
letters' vectors, each permuted (rotated) by its place; a text is the sum (bundle) of the vectors
of its n-grams, and a language's prototype the sum of its training texts' normalised vectors.
A text gets the language with the largest cosine.

The bundle of a text is built from its distinct n-grams and their counts, so its cost follows
the number of distinct n-grams, while every character of the text counts.

Edge cases: null texts and texts without a letter are ``und`` with score 0; rows whose lang is
null train nothing; with no training row at all every text is ``und``; ties go to the language
that sorts first; repeated rows get equal values; other columns are ignored; an empty table
gives an empty result.  A null id counts as the empty text in the fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mix, seeded

DIMS = 1024
GRAM = 3
PART_LANGS = 4096  # prototypes broadcast at once (32 MB); more languages take another pass over the texts
HELD_LANGS = 512  # partial prototypes a task holds before it sends them
MIN_LETTERS_CACHE = 1 << 15  # n-gram vectors kept by a worker


class Encoder:
    """Letter and n-gram vectors by need; the n-gram store is emptied when it is full."""

    def __init__(self, dims: int = DIMS, gram: int = GRAM):
        self.dims, self.gram, self.letters = dims, gram, {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((256, dims), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 4096:
                self.letters.clear()
            bits = seeded(int(mix(np.array([code + 1], np.uint64))[0]), (self.dims + 63) // 64)
            self.letters[code] = np.unpackbits(bits.view(np.uint8))[: self.dims].astype(np.int8) * 2 - 1
        return self.letters[code]

    def bound(self, key: int) -> np.ndarray:
        v = np.ones(self.dims, np.int8)
        for place in range(self.gram):
            v = v * np.roll(self.letter(key >> (21 * place) & 0x1FFFFF), place)
        return v

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), np.int64)
        if len(self.rows) + len(keys) > MIN_LETTERS_CACHE:
            self.rows.clear()
        for i, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                if row >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[row] = self.bound(key)
            out[i] = row
        return out

    def encode(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text, or None where it has no letter."""
        keys, counts = gram_counts(text, self.gram)
        if keys is None:
            return None
        total = np.zeros(self.dims, np.float32)
        for a in range(0, len(keys), 2048):
            rows = self.lookup(keys[a : a + 2048])
            total += counts[a : a + 2048].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total.astype(np.float64)



def _letter_table() -> np.ndarray:
    """Code point to lower-case letter, or blank for what is no letter (the first 64 Ki code points)."""
    table = np.full(0x10000, 32, np.int64)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: np.ndarray | None = None


def gram_counts(text: str | None, gram: int = GRAM) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Distinct letter n-grams of a whole text, packed 21 bits a letter, and their counts."""
    global _TABLE
    if not text:
        return None, None
    if _TABLE is None:
        _TABLE = _letter_table()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    high = codes >= 0x10000
    letters = _TABLE[np.where(high, 0, codes)]
    if high.any():
        letters[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    if not (letters != 32).any():
        return None, None
    letters = np.concatenate([[32], letters, [32]])
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    letters = letters[keep]
    if len(letters) < gram:
        letters = np.concatenate([letters, np.full(gram - len(letters), 32)])
    keys = np.zeros(len(letters) - gram + 1, np.int64)
    for place in range(gram):
        keys |= letters[place : place + len(keys)] << (21 * place)
    return np.unique(keys, return_counts=True)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def _sums(batches: Iterator[pa.RecordBatch], dims: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Partial prototypes of a task, in fixed point so that any order gives the same sum."""
    encoder, sums = Encoder(dims, gram), {}

    def rows():
        langs = sorted(sums)
        names = pa.array(np.repeat(np.arange(len(langs)), dims)).cast(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()).take(names), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(langs))), pa.array(np.concatenate([sums[k] for k in langs]))], ["lang", "dim", "total"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            v = encoder.encode(text.as_py())
            if v is not None:
                if lang not in sums and len(sums) >= HELD_LANGS:
                    yield from rows()
                sums[lang] = sums.get(lang, np.zeros(dims, np.int64)) + np.rint(_unit(v) * (1 << 20)).astype(np.int64)
    if sums:
        yield from rows()


Model = list[tuple[list[str], np.ndarray]]


def train(docs: DataFrame, dims: int = DIMS, gram: int = GRAM) -> Model:
    """Languages in order and their unit prototypes, in parts of PART_LANGS, from rows (text, lang) with a lang.

    Tasks' sums are added by language and dimension, so what reaches the driver doesn't depend on their number.
    """
    rows = docs.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    added = rows.mapInArrow(partial(_sums, dims=dims, gram=gram), "lang string, dim int, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    whole = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "total"))), lambda x: x.total).alias("sums"))  # dims entries
    table = whole.toArrow()
    order = sorted(range(table.num_rows), key=lambda i: table["lang"][i].as_py())
    parts = []
    for a in range(0, len(order), PART_LANGS):
        some = order[a : a + PART_LANGS]
        parts.append(([table["lang"][i].as_py() for i in some], np.array([_unit(np.array(table["sums"][i].as_py(), float)) for i in some])))
    return parts


def guesses(column: pa.Array, langs: list[str], prototypes: np.ndarray, encoder: Encoder) -> tuple[list[str | None], list[float]]:
    """The nearest language of each text and its cosine; None and -2 for a text without a letter."""
    names, scores = [], []
    for text in column:
        v = encoder.encode(text.as_py())
        if v is None:
            names.append(None)
            scores.append(-2.0)
        else:
            cosines = prototypes @ _unit(v)
            best = int(np.argmax(cosines))
            names.append(langs[best])
            scores.append(float(cosines[best]))
    return names, scores


def _guess(batches: Iterator[pa.RecordBatch], model, gram: int, name: str, score: str) -> Iterator[pa.RecordBatch]:
    """Replaces the columns ``name`` and ``score`` where a language of this part of the model is nearer."""
    langs, prototypes = model.value
    encoder = Encoder(prototypes.shape[1], gram)
    for batch in batches:
        names, scores = guesses(batch["text"], langs, prototypes, encoder)
        held = zip(names, scores, batch[name].to_pylist(), batch[score].to_pylist(), strict=True)
        best = [(n, s) if s > t else (m, t) for n, s, m, t in held]
        cols = {**{c: batch[c] for c in batch.schema.names if c not in (name, score)}, name: pa.array([n for n, _ in best], pa.string()), score: pa.array([s for _, s in best], pa.float64())}
        yield pa.RecordBatch.from_pydict({c: cols[c] for c in batch.schema.names})


def guessed(rows: DataFrame, model: Model, name: str, score: str, gram: int = GRAM) -> DataFrame:
    """``rows`` (text, ...) with the nearest language and its cosine, null and -2 where there is none.

    The model is broadcast part by part, each of at most PART_LANGS prototypes; texts usually need one pass.
    """
    out = rows.withColumn(name, F.lit(None).cast("string")).withColumn(score, F.lit(-2.0))
    for part in model:
        shared = rows.sparkSession.sparkContext.broadcast(part)
        out = out.mapInArrow(partial(_guess, model=shared, gram=gram, name=name, score=score), out.schema)
    return out


def predict(docs: DataFrame, model: Model, gram: int = GRAM) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; the score is the cosine, cut to 0 and 1."""
    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("text").cast("string"))
    out = guessed(rows, model, "lang_pred", "score", gram)
    return out.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def agreeing(docs: DataFrame, model: Model, sure: float = 0.5, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a letter and whose own lang isn't contradicted by a score of ``sure`` or more.

    Rows without a lang stay if they have a letter; a model without languages rejects nothing.
    """
    if not model:
        return docs
    name, score = (next(n for n in (base + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("lang_guess", "lang_score"))
    out = guessed(docs, model, name, score, gram)
    told = F.col("lang").cast("string")
    return out.where(F.col(name).isNotNull() & (told.isNull() | (F.col(name) == told) | (F.col(score) < sure))).select(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose fold by 4 is not 2 and predicts every row."""
    return predict(docs, train(docs.where(fold(F.col("doc_id"), 4) != 2)))
