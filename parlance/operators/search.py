"""Exact cosine search over an impact-ordered inverted index in shards.

*Bags.*  Terms are 64-bit hashes; those of neighbours are made of both words' hashes.  A text's terms are counted within its
row, so nothing is shuffled.  *Vocabulary.*  Only sums of terms are shuffled, added up by task first.  *Shards.*  Texts with their weights are packed, as they come, into shards of some two million postings,
each one row: for every term of the shard its postings from the greatest impact (weight without idf, in a text of length 1) down,
in blocks of 128 with the block's greatest impact, and for every text its terms.

*Search.*  Each shard answers a block of queries at once.  A query's terms are taken from the one that can add most.  What the
terms after a place can add to any text is bounded twice: by the sum of their greatest additions and by the length of the rest of
the query's vector, as a text's vector has length 1.  Terms are read until that bound is below the threshold; blocks whose greatest
addition and the rest together are below it are left out.  The threshold is the ``top``-th score among the texts met so far, in this
shard or an earlier one of the task.  Texts that can still reach it are scored in full from their own terms.  So the result is
exact, and the postings of frequent terms are rarely read.

A task hands on the ``top`` best of all its shards for each query.  The queries of a block are broadcast; its number of terms is
bounded (``Bounds``), and more queries make more blocks, each another pass over the index.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ACCENTED, PLAIN
from ..sources.tables import cached, discard, stored

VERSION = "1"  # of what an index holds
BAGS = "id long, terms array<long>, tf array<int>"
VECTORS = BAGS + ", raw array<double>, norm double"
MARGIN = 1e-9  # more than sums in another order can move a cosine
ROUNDED = 1e-6 + MARGIN  # two cosines that are equal when rounded are no further apart

WORD = re.compile(r"\w{2,}")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Bounds(NamedTuple):
    """Sizes that keep tasks small.  No result depends on them."""

    shard_postings: int = 1 << 21
    shard_texts: int = 1 << 16  # at most, as a text's place in its shard has 16 bits
    block: int = 128  # postings of a block
    block_terms: int = 1 << 21  # terms of all queries of a block: 50 MB on the driver and in each worker
    slice_terms: int = 1 << 20  # words counted at once within a batch
    known_words: int = 1 << 20  # words whose hashes a task holds
    counted: int = 1 << 22  # terms of texts a task holds before it hands on their counts
    vocabulary: int = 1 << 22  # terms up to which the vocabulary is broadcast: 64 MB
    packed: int = 1 << 22  # terms of texts that one task joins with a longer vocabulary
    first: int = 32  # terms read before there is a threshold


USUAL = Bounds()


class Index(NamedTuple):
    vocabulary: DataFrame  # (term, idf)
    shards: DataFrame


# ---------------------------------------------------------------- bags


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two neighbours each."""
    x = (a.view(np.uint64) * _A) ^ ((b.view(np.uint64) + _A) * _B)
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _counted(word: np.ndarray, offsets: np.ndarray, bigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of rows, terms, tf) of rows of word hashes; a row's terms are sorted."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if bigrams and len(word) > 1:
        both = np.flatnonzero(row[1:] == row[:-1])
        word, row = np.concatenate([word, pair_hashes(word[both], word[both + 1])]), np.concatenate([row, row[both]])
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])) if len(word) else np.zeros(0, np.int64)
    return np.searchsorted(row[first], np.arange(len(offsets))), word[first], np.diff(np.append(first, len(word)))


class Words(dict):
    """Words and their hashes; forgets them when there are ``most``."""

    def __init__(self, most: int = USUAL.known_words):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = hashed = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return hashed


def _bags(batches: Iterator[pa.RecordBatch], bigrams: bool, accents: bool, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    known, plain = Words(bounds.known_words), str.maketrans(ACCENTED, PLAIN)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            found, size, end = [], 0, at
            while end < batch.num_rows and (end == at or size < bounds.slice_terms):
                text = (batch["text"][end].as_py() or "").lower()
                if not (accents or text.isascii()):
                    text = text.translate(plain)
                found.append(np.fromiter(map(known.__getitem__, WORD.findall(text)), np.int64))
                size, end = size + len(found[-1]), end + 1
            ends, term, tf = _counted(np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]), bigrams)
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["id"].slice(at, end - at), pa.ListArray.from_arrays(ends, pa.array(term)), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], ["id", "terms", "tf"])
            at = end


def bags(docs: DataFrame, bigrams: bool = True, accents: bool = False, bounds: Bounds = USUAL) -> DataFrame:
    """(id, terms, tf): the distinct terms of each text, as hashes, and how often it has them; ``docs`` has (id, text).

    Terms are lower-cased words of two or more letters, digits or underscores, without marks on Latin letters unless ``accents``,
    and by default pairs of neighbours.  A null text has none.
    """
    rows = docs.select(F.col("id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_bags, bigrams=bigrams, accents=accents, bounds=bounds), BAGS)


def _frequencies(batches: Iterator[pa.RecordBatch], buckets: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """(bucket, terms, dfs) of a task, packed; handed on whenever many terms are held."""
    held: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        term, df = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        bucket = (term.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        term, df = term[order], df[order].astype(np.int32)
        return _rows(["bucket", "terms", "dfs"], [(b, term[i:j], df[i:j]) for b, i, j in _cut(bucket[order], buckets)])

    size = 0
    for batch in batches:
        held.append(batch["terms"].flatten().to_numpy())
        size += len(held[-1])
        if size >= bounds.counted:
            yield summed()
            size = 0
    if size:
        yield summed()


def _totals(table: pa.Table, min_df: int) -> pa.Table:
    """(term, df) of a bucket's terms in ``min_df`` texts or more."""
    term, df = _joined(table, "terms", np.int64), _joined(table, "dfs", np.int32).astype(np.int64)
    order = np.argsort(term, kind="stable")
    term, df = term[order], df[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    df = np.add.reduceat(df, first)
    often = df >= min_df
    return pa.table({"term": term[first][often], "df": df[often]})


def vocabulary(bags: DataFrame, n: int, min_df: int, bounds: Bounds = USUAL) -> DataFrame:
    """(term, idf): ln((1 + N) / (1 + df)) + 1 of terms in at least ``min_df`` texts.

    Each task's terms are shuffled in packed rows, a row a bucket.
    """
    entries = bags.agg(F.sum(F.size("terms"))).first()[0] or 0
    buckets = -(-max(entries, 1) // bounds.packed)
    df = bags.select("terms").mapInArrow(partial(_frequencies, buckets=buckets, bounds=bounds), "bucket int, terms binary, dfs binary").groupBy("bucket").applyInArrow(lambda t: _totals(t, min_df), "term long, df long")
    return df.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def _weighed(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Vectors of bags, by a broadcast vocabulary."""
    known, idf = table.value
    for batch in batches:
        term, tf = (batch[c].flatten().to_numpy() for c in ("terms", "tf"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch["terms"].offsets.to_numpy()))
        at = np.searchsorted(known, term)
        at[at == len(known)] = 0
        own = np.flatnonzero(known[at] == term) if len(known) else np.zeros(0, np.int64)
        row, term, tf, raw = row[own], term[own], tf[own], _impact(tf[own]) * idf[at[own]]
        texts, start = np.unique(row, return_index=True)
        if len(texts):
            bounds = pa.array(np.append(start, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (term, tf, raw)]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(texts)), *lists, pa.array(np.sqrt(np.add.reduceat(raw * raw, start)))], ["id", "terms", "tf", "raw", "norm"])


def _broadcast(table: DataFrame, most: int):
    """A vocabulary of at most ``most`` terms as sorted arrays in a broadcast; None for a longer one."""
    if table.count() > most:
        return None
    rows = table.toArrow()
    term, idf = rows["term"].to_numpy(), rows["idf"].to_numpy()
    order = np.argsort(term)
    return table.sparkSession.sparkContext.broadcast((term[order], idf[order]))


def vectors(bags: DataFrame, table: DataFrame, bounds: Bounds = USUAL) -> DataFrame:
    """(id, terms, tf, raw, norm): a text's terms, raw being sublinear tf times idf, and the length of raw; texts without any are left out.

    A vocabulary of at most ``bounds.vocabulary`` terms is broadcast and texts stay where they are; a longer one is joined by term,
    in packed rows: each term of a task's texts once.
    """
    shared = _broadcast(table, bounds.vocabulary)
    if shared is not None:
        return bags.mapInArrow(partial(_weighed, table=shared), VECTORS)
    entries = bags.agg(F.sum(F.size("terms"))).first()[0] or 0
    buckets = -(-max(entries, 1) // bounds.packed)
    packed = "bucket int, terms binary, counts binary, ids binary, tfs binary, idfs binary"
    sent = bags.select("id", "terms", "tf").mapInArrow(partial(_dealt, buckets=buckets, bounds=bounds), packed).unionByName(table.select("term", "idf").mapInArrow(partial(_told, buckets=buckets), packed))
    known = sent.groupBy("bucket").applyInArrow(lambda t: _known(t, buckets), "block int, ids binary, terms binary, tfs binary, idfs binary")
    return known.groupBy("block").applyInArrow(_assembled, VECTORS)


def _cut(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets that have something."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, cut[b], cut[b + 1]


def _squeezed(name: str, x: np.ndarray) -> bytes:
    """An array in few bytes: the first bytes of all numbers, then the second ones, ..., compressed; of terms, which are sorted, the steps."""
    if not len(x):
        return b""
    x = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if name == "terms" else x)
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), "zstd", asbytes=True)


def _unsqueezed(name: str, packed: pa.Buffer, kind: type) -> np.ndarray:
    if not len(packed):
        return np.zeros(0, kind)
    n, size = int.from_bytes(packed[:8].to_pybytes(), "little"), np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(pa.decompress(packed[8:], n * size, "zstd"), np.uint8).reshape(size, n).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if name == "terms" else x


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """A whole number and packed arrays a row."""
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array([_squeezed(name, x) for x in c], pa.binary()) for name, c in zip(names[1:], cols[1:], strict=True))], names)


_PACKED = ["bucket", "terms", "counts", "ids", "tfs", "idfs"]


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """The terms of many texts in one row a bucket: each term once, then the texts that have it."""
    held: list[tuple[np.ndarray, ...]] = []

    def sent() -> pa.RecordBatch:
        term, ids, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket = (term.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ids, term, bucket))
        term, ids, tf, bucket = term[order], ids[order], tf[order], bucket[order]
        rows = []
        for b, i, j in _cut(bucket, buckets):
            first = np.flatnonzero(np.concatenate([[True], term[i + 1 : j] != term[i : j - 1]]))
            rows.append((b, term[i:j][first], np.diff(np.append(first, j - i)).astype(np.int32), ids[i:j], tf[i:j], np.zeros(0)))
        return _rows(_PACKED, rows)

    size = 0
    for batch in batches:
        held.append((batch["terms"].flatten().to_numpy(), np.repeat(batch["id"].to_numpy(), np.diff(batch["terms"].offsets.to_numpy())), batch["tf"].flatten().to_numpy()))
        size += len(held[-1][0])
        if size >= bounds.counted:
            yield sent()
            size = 0
    if size:
        yield sent()


def _told(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A vocabulary in rows like those of ``_dealt``."""
    none = np.zeros(0, np.int32)
    for batch in batches:
        term, idf = batch["term"].to_numpy(), batch["idf"].to_numpy()
        bucket = (term.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((term, bucket))
        yield _rows(_PACKED, [(b, term[order[i:j]], none, none, none, idf[order[i:j]]) for b, i, j in _cut(bucket[order], buckets)])


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([_unsqueezed(name, x.as_buffer(), kind) for x in table[name]])


def _known(table: pa.Table, blocks: int) -> pa.Table:
    """A bucket's terms that the vocabulary has, with its idf, in one row a block of texts."""
    of_vocabulary = np.array([len(x.as_buffer()) > 0 for x in table["idfs"]])
    told, asked = table.filter(pa.array(of_vocabulary)), table.filter(pa.array(~of_vocabulary))
    names = ["block", "ids", "terms", "tfs", "idfs"]
    if not (told.num_rows and asked.num_rows):
        return pa.Table.from_batches([_rows(names, [])])
    words, idf = _joined(told, "terms", np.int64), _joined(told, "idfs", float)
    order = np.argsort(words)
    words, idf = words[order], idf[order]
    term = _joined(asked, "terms", np.int64)
    at = np.minimum(np.searchsorted(words, term), len(words) - 1)
    counts = _joined(asked, "counts", np.int32)
    own = np.repeat(words[at] == term, counts)
    at = np.repeat(at, counts)[own]
    ids, tf = _joined(asked, "ids", np.int64)[own], _joined(asked, "tfs", np.int32)[own]
    block = (((ids.view(np.uint64) * _A) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((at, block))
    at, ids, tf, block = at[order], ids[order], tf[order], block[order]
    return pa.Table.from_batches([_rows(names, [(b, ids[i:j], words[at[i:j]], tf[i:j], idf[at[i:j]]) for b, i, j in _cut(block, blocks)])])


def _assembled(table: pa.Table) -> pa.Table:
    """Vectors of a block's texts."""
    ids, term, tf, idf = (_joined(table, c, kind) for c, kind in (("ids", np.int64), ("terms", np.int64), ("tfs", np.int32), ("idfs", float)))
    order = np.lexsort((term, ids))
    ids, term, tf, raw = ids[order], term[order], tf[order], _impact(tf[order]) * idf[order]
    texts, start = np.unique(ids, return_index=True)
    ends = pa.array(np.append(start, len(ids)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term, tf, raw)]
    return pa.table([pa.array(texts), *lists, pa.array(np.sqrt(np.add.reduceat(raw * raw, start)))], ["id", "terms", "tf", "raw", "norm"])


# ---------------------------------------------------------------- shards

_KINDS = {"ids": np.int64, "norms": np.float64, "terms": np.int64, "starts": np.int32, "docs": np.uint16, "tfs": np.uint32, "maxima": np.float64, "own_starts": np.int32, "own_terms": np.int32, "own_tfs": np.uint32, "size": np.int32}
SHARD = ", ".join(f"{name} binary" for name in _KINDS)


def _impact(tf: np.ndarray) -> np.ndarray:
    return 1 + np.log(tf.astype(float))


class Shard:
    """Postings of some texts; its arrays are views of one row's binary columns."""

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.block = int(self.size[0])
        self.block_starts = np.concatenate([[0], np.cumsum(-(-np.diff(self.starts) // self.block))])

    @classmethod
    def of(cls, ids: np.ndarray, norms: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, block: int) -> Shard:
        """From texts with terms ``term[ends[i] : ends[i + 1]]``."""
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        terms, number = np.unique(term, return_inverse=True)
        impact = _impact(tf) / norms[doc]
        order = np.lexsort((doc, -impact, number))
        starts = np.searchsorted(number[order], np.arange(len(terms) + 1))
        sizes = np.diff(starts)
        blocks = -(-sizes // block)
        heads = np.repeat(starts[:-1], blocks) + block * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        values = (ids, norms, terms, starts, doc[order], tf[order], impact[order][heads], ends, number, tf, [block])
        return cls(**{name: np.ascontiguousarray(v, kind) for (name, kind), v in zip(_KINDS.items(), values, strict=True)})

    def row(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name in _KINDS]

    @classmethod
    def from_row(cls, row: dict) -> Shard:
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items()})

    def _read(self, lists: np.ndarray, first: np.ndarray, end: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, additions) of the blocks of these lists from ``first`` to before ``end``."""
        start, whole = self.starts[lists].astype(np.int64), (self.starts[lists + 1] - self.starts[lists]).astype(np.int64)
        sizes = np.minimum(end * self.block, whole) - np.minimum(first * self.block, whole)
        at = np.repeat(start + np.minimum(first * self.block, whole) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        doc = self.docs[at]
        return doc, np.repeat(gain, sizes) * _impact(self.tfs[at]) / self.norms[doc]

    def top(self, term: np.ndarray, gain: np.ndarray, weight: np.ndarray, top: int, least: float, first: int = USUAL.first) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(texts, scores, postings read, postings of the query's terms): all that score ``least`` or more and can be among the ``top``.

        ``gain`` is what a unit of impact adds (weight in the query times idf), ``weight`` the weight in the query, of length 1 in all.
        """
        place = np.searchsorted(self.terms, term)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == term
        lists, gain, weight = place[known], gain[known], weight[known]
        none = np.zeros(0, np.int64)
        if not len(lists):
            return none, np.zeros(0), 0, 0
        most = gain * self.maxima[self.block_starts[lists]]
        order = np.argsort(-most, kind="stable")
        lists, gain, weight, most = lists[order], gain[order], weight[order], most[order]
        sizes = self.starts[lists + 1] - self.starts[lists]
        tail = np.append(np.minimum(np.cumsum(most[::-1])[::-1], np.sqrt(np.cumsum((weight * weight)[::-1])[::-1])), 0.0)
        got, touched = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        own, rest, read, upto, floor = np.diff(self.own_starts), int(sizes.sum()), 0, 0, least
        left, skipped = [], 0.0  # blocks left out: (lists, first block, gain), and what they can add together
        while upto < len(lists):
            chosen = np.flatnonzero(touched & (got + tail[upto] + skipped >= floor))
            if floor > 0 and tail[upto] < floor and int(own[chosen].sum()) <= rest:
                scores, n = self._whole(chosen, lists, gain)
                return chosen, scores, read + n, int(sizes.sum())
            end = min(max(upto + first, 2 * upto), len(lists))
            some, n = np.arange(upto, end), -(-sizes[upto:end] // self.block)
            if floor > 0:
                n, out = self._needed(lists[some], n, gain[some], floor - tail[some + 1])
                left.append((lists[some], n, gain[some]))
                skipped += out
            doc, add = self._read(lists[some], np.zeros(len(some), np.int64), n, gain[some])
            got += np.bincount(doc, add, len(got))
            touched[doc] = True
            read, rest, upto = read + len(doc), rest - len(doc), end
            if np.count_nonzero(touched) >= top:
                floor = max(floor, float(np.partition(got, -top)[-top]) - ROUNDED)
        chosen = np.flatnonzero(touched & (got + skipped >= floor))
        if not rest:
            return chosen, got[chosen], read, int(sizes.sum())
        if int(own[chosen].sum()) <= rest:
            scores, n = self._whole(chosen, lists, gain)
            return chosen, scores, read + n, int(sizes.sum())
        for some, n, g in left:  # reading what was left out is cheaper
            doc, add = self._read(some, n, -(-(self.starts[some + 1] - self.starts[some]) // self.block), g)
            got += np.bincount(doc, add, len(got))
        return chosen, got[chosen], read + rest, int(sizes.sum())

    def _needed(self, lists: np.ndarray, blocks: np.ndarray, gain: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, float]:
        """How many blocks of each list add ``least`` or more, and what the first ones left out can add together."""
        n, out = blocks.copy(), 0.0
        for i in np.flatnonzero(blocks > 1).tolist():
            at = self.block_starts[lists[i]]
            maxima = gain[i] * self.maxima[at : at + blocks[i]]
            n[i] = np.searchsorted(-maxima, -least[i], "right")
            if n[i] < blocks[i]:
                out += float(maxima[n[i]])
        return n, out

    def _whole(self, chosen: np.ndarray, lists: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, int]:
        """Whole scores of these texts from their own terms."""
        by_list = np.zeros(len(self.terms))
        by_list[lists] = gain
        sizes = np.diff(self.own_starts)[chosen].astype(np.int64)
        at = np.repeat(self.own_starts[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        add = by_list[self.own_terms[at]] * _impact(self.own_tfs[at])
        return np.bincount(np.repeat(np.arange(len(chosen)), sizes), add, len(chosen)) / self.norms[chosen], len(at)


def _shards(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def built() -> pa.RecordBatch:
        ids, norms, sizes, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        shard = Shard.of(ids, norms, np.concatenate([[0], np.cumsum(sizes)]), term, tf, bounds.block)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.row()], [*_KINDS])

    texts = postings = 0
    for batch in batches:
        offsets = batch["terms"].offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        term, tf = (batch[name].flatten().to_numpy() for name in ("terms", "tf"))
        ids, norms, at = batch["id"].to_numpy(), batch["norm"].to_numpy(), 0
        while at < batch.num_rows:
            end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + bounds.shard_postings - postings, "right")) - 1), at + bounds.shard_texts - texts, batch.num_rows)
            a, b = offsets[at], offsets[end]
            held.append((ids[at:end], norms[at:end], np.diff(offsets[at : end + 1]), term[a:b], tf[a:b]))
            texts, postings, at = texts + end - at, postings + int(b - a), end
            if postings >= bounds.shard_postings or texts == bounds.shard_texts or at < batch.num_rows:
                yield built()
                texts = postings = 0
    if held:
        yield built()


def build(docs: DataFrame, min_df: int = 2, bounds: Bounds = USUAL) -> Index:
    """The index of ``docs`` (id, text); ids are longs.  Texts without a term of the vocabulary are in no shard."""
    counted = stored(bags(docs.select("id", "text"), bounds=bounds), "bags")
    table = stored(vocabulary(counted, counted.count(), min_df, bounds), "vocabulary")
    shards = stored(vectors(counted, table, bounds).mapInArrow(partial(_shards, bounds=bounds), SHARD), "index")
    discard(counted)
    return Index(table, shards)


def kept(source: DataFrame, name: str, docs: Callable[[DataFrame], DataFrame], min_df: int = 2) -> Index:
    """The index of ``docs(source)``, built once for the files behind ``source`` and read by every later search."""
    made: list[Index] = []

    def built(source: DataFrame) -> Index:
        if not made:
            made.append(build(docs(source), min_df))
        return made[0]

    version = f"{VERSION}-{min_df}"
    table, _ = cached(source, f"{name}-vocabulary", version, lambda s: built(s).vocabulary, move=True)
    shards, _ = cached(source, f"{name}-shards", version, lambda s: built(s).shards, move=True)
    return Index(table, shards)


# ---------------------------------------------------------------- search


def _answers(batches: Iterator[pa.RecordBatch], queries, top: int, first: int, count: bool) -> Iterator[pa.RecordBatch]:
    """(q, id, micro): of all shards of the task the best by cosine in millionths; or (q, read, postings) if ``count``."""
    names, ends, term, gain, weight = queries.value
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    reads = np.zeros((len(names), 2), np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard.from_row({name: batch[name][i].as_buffer() for name in _KINDS})
            for q in range(len(names)):
                a, b = ends[q], ends[q + 1]
                micro, ids = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                least = (micro[-1] - 0.5) * 1e-6 - MARGIN if len(micro) == top else 0.0
                docs, scores, *read = shard.top(term[a:b], gain[a:b], weight[a:b], top, least, first)
                reads[q] += read
                if len(docs):
                    micro, ids = np.concatenate([micro, np.floor(scores * 1e6 + 0.5).astype(np.int64)]), np.concatenate([ids, shard.ids[docs]])
                    order = np.lexsort((ids, -micro))[:top]
                    best[q] = micro[order], ids[order]
    if count:
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(reads[:, 0]), pa.array(reads[:, 1])], ["q", "read", "postings"])
    elif best:
        found = sorted(best)
        sizes = [len(best[q][0]) for q in found]
        micro, ids = (np.concatenate([best[q][k] for q in found]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[found], sizes)), pa.array(ids), pa.array(micro)], ["q", "id", "micro"])


def _blocks(queries: DataFrame, index: Index, bounds: Bounds) -> Iterator:
    """The queries' terms as broadcast arrays, a block of about ``bounds.block_terms`` at a time."""
    context = queries.sparkSession.sparkContext
    each = bags(queries.select("id", "text"), bounds=bounds).select("id", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select(F.col("id").alias("q"), F.col("x.terms").alias("term"), F.col("x.tf").alias("tf"))
    raw = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    asked = stored(each.join(index.vocabulary, "term").select("q", "term", raw.alias("raw"), "idf"), "asked")
    n = -(-asked.count() // bounds.block_terms)
    for block in range(n):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == block).toArrow()  # about bounds.block_terms rows
        q, term, raw, idf = (rows[c].to_numpy() for c in ("q", "term", "raw", "idf"))
        order = np.lexsort((term, q))
        q, term, raw, idf = q[order], term[order], raw[order], idf[order]
        names, start = np.unique(q, return_index=True)
        ends = np.append(start, len(q))
        weight = raw / np.repeat(np.sqrt(np.add.reduceat(raw * raw, start)) if len(q) else raw, np.diff(ends))
        shared = context.broadcast((names, ends, term, weight * idf, weight))
        yield shared
        shared.unpersist()
    discard(asked)


def _over_shards(queries: DataFrame, index: Index, top: int, bounds: Bounds, count: bool, schema: str) -> DataFrame:
    """One pass over the index for each block of queries; the passes' rows together, kept in the shared folder."""
    out = [stored(index.shards.mapInArrow(partial(_answers, queries=block, top=top, first=bounds.first, count=count), schema), "answers") for block in _blocks(queries, index, bounds)]
    if not out:
        return queries.sparkSession.createDataFrame([], schema)
    return queries.sparkSession.read.schema(out[0].schema).parquet(*(x.rpartition("/")[0] for df in out for x in df.inputFiles()[:1]))


def search(queries: DataFrame, index: Index, top: int, bounds: Bounds = USUAL) -> DataFrame:
    """(q, id, cosine, place) of the ``top`` most similar texts of the index for each query (id, text).

    The vocabulary and idf are the index's; texts that share no term aren't hits.  Ties in the rounded cosine go to the lesser id.
    """
    found = _over_shards(queries, index, top, bounds, False, "q long, id long, micro long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("micro"), "id"))).where(F.col("place") <= top)
    hits = stored(ranked.select("q", "id", (F.col("micro") / F.lit(1e6)).alias("cosine"), "place"), "hits")
    discard(found)
    return hits


def reads(queries: DataFrame, index: Index, top: int, bounds: Bounds = USUAL) -> DataFrame:
    """(q, read, postings): how many postings a search reads for each query, and how many its terms have."""
    return _over_shards(queries, index, top, bounds, True, "q long, read long, postings long").groupBy("q").agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))
