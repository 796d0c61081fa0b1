"""Language-model scoring by an interpolated modified Kneser-Ney bigram model.

The tokens of a text are its words with A-Z folded and one end token; the first is preceded by a start mark.

1. Map tasks count word pairs of the training rows and send them, as one packed block for each
   bucket of the pair's hash, to the task of that bucket.  Pair hashes spread evenly, so a common
   word loads no task; a task holds about BUCKET_BYTES of text's pairs.
2. That task adds up its blocks, writes its pairs (count >= MIN_COUNT, which is all) as an array sorted by
   hash to the shared folder, and sends for each word partial sums: as context (total, kept, pairs by
   count) and as follower (count, distinct contexts).  A common word has one row a bucket.
3. The tasks of the words' buckets add these up and write arrays sorted by word hash.
4. Discounts come from the counts of counts, a handful of numbers.  Scoring workers map the arrays
   into memory and look up the distinct pairs and words of a slice of texts by binary search.

``p(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) p1(w)``; p1 is the like over distinct contexts, with a
uniform share for V words and an unknown one.  Where ``train`` is asked for a greater least count, pairs
below it give their whole mass to g(v), which keeps the sum over w at 1; they count in full in all totals,
discounts and p1.

A written array is renamed into place, so a repeated task replaces it by an equal one.  Its length is that
of its file, so the driver holds and broadcasts the folder and two dozen numbers whatever the input.  Where
the shared folder is no local path, a worker reads an array into memory and holds HELD of them.

Edge cases: null and blank texts are the end token alone; without training rows every word is unknown
with probability 1; repeated rows count as often as they occur; other columns are ignored; an empty
table gives an empty result.  A null id counts as the empty text in the fold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fold, gram_hashes, new_path, slices, stored, word_hashes, word_spans

START, END = np.uint64(0x5bd1e9955bd1e995), np.uint64(0x9ddfea08eb382d69)  # hashes no word is expected to have
MIN_COUNT = 1  # every pair is stored
BUCKET_BYTES = 12 << 20  # bytes of training text whose pairs make a bucket
HELD = 16  # arrays that a worker holds where they can't be mapped
FLUSH_PAIRS = 3_000_000  # pairs a map task holds before it sends them
WORD_FIELDS = ("count", "contexts", "total", "kept", "k1", "k2", "k3")


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a slice, the token before each, and the bounds of the rows' tokens."""
    starts, ends, bounds = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    now = np.insert(words, bounds[1:], END)
    bounds = bounds + np.arange(len(bounds))
    before = np.empty(len(now), np.uint64)
    before[1:] = now[:-1]
    before[bounds[:-1]] = START
    return now, before, bounds


def pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    both = np.empty(2 * len(now), np.uint64)
    both[0::2], both[1::2] = before, now
    return gram_hashes(both, 2)[0::2]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- packed blocks


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def add_up(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their value rows."""
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(v, first, axis=0) if len(k) else v)


def _blocks(kind: str, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    before, now, count = pairs
    bucket = bucket_of(pair_hash(before, now), buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        at = order[edges[b] : edges[b + 1]]
        words, index = np.unique(np.concatenate([before[at], now[at]]), return_inverse=True)
        steps = np.diff(words, prepend=np.uint64(0))
        first, second = index[: len(at)].astype(np.uint32), index[len(at) :].astype(np.uint32)
        by = np.lexsort((second, first))
        rows.append((b, squeeze(steps), squeeze(np.diff(first[by], prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T), squeeze(second[by].view(np.uint8).reshape(-1, 4).T), squeeze(count[at][by].astype(np.uint32))))
        if len(rows) == 64:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], ["bucket", "words", "first", "second", "count"])


PAIR_BLOCK = "bucket long, words binary, first binary, second binary, count binary"


def _planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(x, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        before, now, count = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((now, before))
        before, now, count = before[order], now[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (now[1:] != now[:-1])]))
        return before[first], now[first], np.add.reduceat(count, first)

    fresh = 0
    for batch in batches:
        for _, _, data, offs in slices(batch["text"]):
            now, before, _ = tokens(data, offs)
            held.append((before, now, np.ones(len(now), np.int64)))
            fresh += len(now)
            if fresh >= FLUSH_PAIRS:
                held[:] = [merged()]
                fresh = 0
                if len(held[0][0]) >= FLUSH_PAIRS:
                    yield from _blocks("pairs", held[0], buckets)
                    held.clear()
    if held:
        yield from _blocks("pairs", merged(), buckets)


# ---------------------------------------------------------------- arrays in the shared folder


@lru_cache(64)
def _open(folder: str):
    return pafs.FileSystem.from_uri(folder)


def write_array(folder: str, name: str, *arrays: np.ndarray) -> None:
    fs, path = _open(folder)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(part) as out:
        for x in arrays:
            out.write(np.ascontiguousarray(x).tobytes())
    fs.move(part, f"{path}/{name}")


def _columns(raw: np.ndarray, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    rows, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for kind in kinds:
        size = rows * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size
    return tuple(out)


@lru_cache(8192)
def _mapped(path: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    try:
        return _columns(np.memmap(path, np.uint8, "r"), kinds)
    except FileNotFoundError:
        return _columns(np.zeros(0, np.uint8), kinds)


@lru_cache(HELD)
def _fetched(folder: str, name: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    fs, path = _open(folder)
    try:
        with fs.open_input_file(f"{path}/{name}") as source:
            return _columns(np.frombuffer(source.read_buffer(), np.uint8), kinds)
    except FileNotFoundError:
        return _columns(np.zeros(0, np.uint8), kinds)


def arrays(folder: str, name: str, *kinds: str) -> tuple[np.ndarray, ...]:
    """The arrays of a file, mapped into memory; empty ones where the bucket has no rows and so no file."""
    fs, path = _open(folder)
    return _mapped(f"{path}/{name}", kinds) if isinstance(fs, pafs.LocalFileSystem) else _fetched(folder, name, kinds)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches by bucket."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and held:
                yield now, held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield now, held


WORD_BLOCK = "bucket long, words binary, sums binary, parts array<long>"


def _reduce_pairs(batches: Iterator[pa.RecordBatch], folder: str, buckets: int, min_count: int) -> Iterator[pa.RecordBatch]:
    """Adds up a bucket's pairs, writes its array, and sends the words' partial sums (and, as parts, counts of counts)."""
    for bucket, rows in _runs(batches):
        before, now, count = [], [], []
        for r in rows:
            words = np.cumsum(unsqueeze(r["words"], np.uint64))
            before.append(words[np.cumsum(_planes(r["first"]), dtype=np.uint32)])
            now.append(words[_planes(r["second"])])
            count.append(unsqueeze(r["count"], np.uint32).astype(np.int64))
        before, now, count = (np.concatenate(x) for x in (before, now, count))
        order = np.lexsort((now, before))
        before, now, count = before[order], now[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (now[1:] != now[:-1])]))
        before, now, count = before[first], now[first], np.add.reduceat(count, first)
        h = pair_hash(before, now)
        keep = np.flatnonzero(count >= min_count)
        keep = keep[np.argsort(h[keep], kind="stable")]
        write_array(folder, f"pairs-{bucket}", h[keep], count[keep].astype(np.uint32).clip(0, 2**32 - 1))
        zero, one = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
        kept = count >= min_count
        as_context = np.stack([zero, zero, count, count * kept, kept & (count == 1), kept & (count == 2), kept & (count > 2)], axis=1).astype(np.int64)
        as_follower = np.stack([count, one, zero, zero, zero, zero, zero], axis=1)
        words, sums = add_up([before, now], [as_context, as_follower])
        of = bucket_of(words, buckets)
        edges = np.searchsorted(of, np.arange(buckets + 1))
        out = [(b, squeeze(np.diff(words[edges[b] : edges[b + 1]], prepend=np.uint64(0))), squeeze(sums[edges[b] : edges[b + 1]].T), None) for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]
        out.append((-1, None, None, [int((count == k).sum()) for k in (1, 2, 3, 4)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["bucket", "words", "sums", "parts"])


def _reduce_words(batches: Iterator[pa.RecordBatch], folder: str, discounts: tuple[float, float, float]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _runs(batches):
        parts = [(np.cumsum(unsqueeze(r["words"], np.uint64)), unsqueeze(r["sums"], np.int64).reshape(len(WORD_FIELDS), -1).T) for r in rows]
        words, sums = add_up([p[0] for p in parts], [p[1] for p in parts])
        count, contexts, total, kept, *k = sums.T
        spare = total - kept + sum(d * n for d, n in zip(discounts, k, strict=True))
        share = np.where(total > 0, spare / np.maximum(total, 1), 1.0)
        write_array(folder, f"words-{bucket}", words, count, contexts, total, share)
        stats = [int(count.sum()), int((count > 0).sum()), int(contexts.sum()), *(int((contexts == i).sum()) for i in (1, 2, 3, 4)), int((contexts > 2).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([stats], pa.list_(pa.int64()))], ["parts"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more (Chen and Goodman 1998)."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    return min(1.0, max(0.0, 1 - 2 * y * n2 / n1)), min(2.0, max(0.0, 2 - 3 * y * n3 / n2)), min(3.0, max(0.0, 3 - 4 * y * n4 / n3))


def train(docs: DataFrame, min_count: int = MIN_COUNT) -> dict:
    """The model of the rows of ``docs`` (text): a folder of arrays and a few numbers."""
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    folder = new_path(spark, "model")
    # each task gets one bucket by its number: a hash of the number would give some tasks several
    dealt = text.mapInArrow(partial(_count, buckets=buckets), PAIR_BLOCK).repartitionById(buckets, F.col("bucket").cast("int"))
    sums = stored(dealt.mapInArrow(partial(_reduce_pairs, folder=folder, buckets=buckets, min_count=min_count), WORD_BLOCK), "word-sums")
    add = lambda df, n: [x or 0 for x in df.agg(*(F.sum(F.col("parts")[i]) for i in range(n))).first()]
    d2 = discounts(*add(sums.where("bucket = -1"), 4))
    words = sums.where("bucket >= 0").select("bucket", "words", "sums").repartitionById(buckets, F.col("bucket").cast("int"))
    total = add(words.mapInArrow(partial(_reduce_words, folder=folder, discounts=d2), "parts array<long>"), 8)
    drop_stored(sums)
    return {
        "folder": folder, "buckets": buckets, "tokens": total[0], "types": total[1], "contexts": total[2],
        "d2": d2, "d1": discounts(*total[3:7]), "n1": (total[3], total[4], total[7])}


def _lookup(model: dict, kind: str, keys: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """Values of sorted distinct ``keys``, 0 where a key is absent."""
    out = [np.zeros(len(keys), k) for k in kinds]
    bucket = bucket_of(keys, model["buckets"])
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True) if len(keys) else ():
        held, *values = arrays(model["folder"], f"{kind}-{bucket[a]}", "u8", *kinds)
        if len(held):
            mine = keys[a:z]
            at = np.searchsorted(held, mine)
            at[at == len(held)] = 0
            hit = held[at] == mine
            for x, v in zip(out, values, strict=True):
                x[a:z][hit] = v[at[hit]]
    return out


def _discount(d: tuple[float, float, float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def score_slice(model: dict, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of the rows of a slice."""
    now, before, bounds = tokens(data, offs)
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    words, at = np.unique(np.concatenate([now, before]), return_inverse=True)
    count, contexts, total, share = _lookup(model, "words", words, ("i8", "i8", "i8", "f8"))
    all_contexts, types = model["contexts"], model["types"]
    spare = sum(d * n for d, n in zip(model["d1"], model["n1"], strict=True)) / all_contexts if all_contexts else 1.0
    p1 = np.maximum(contexts - _discount(model["d1"], contexts), 0) / max(all_contexts, 1) + spare / (types + 1)
    now_at, before_at = at[: len(now)], at[len(now) :]
    pairs, pair_at = np.unique(pair_hash(before, now), return_inverse=True)
    (c,) = _lookup(model, "pairs", pairs, ("u4",))
    c = c.astype(np.int64)
    top = np.maximum(c - _discount(model["d2"], c), 0)[pair_at]
    seen = total[before_at]
    p = np.where(seen > 0, top / np.maximum(seen, 1) + share[before_at] * p1[now_at], p1[now_at])
    base = np.log10((count[now_at] + 1) / (model["tokens"] + types + 1))
    return np.diff(bounds), np.bincount(row, count[now_at] > 0, rows).astype(np.int64), np.bincount(row, base, rows), np.bincount(row, np.log10(p), rows)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        parts = [score_slice(model, data, offs) for _, _, data, offs in slices(batch["text"])]
        cols = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0), k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *cols], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # where the arrays are, not the arrays
    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), 7) == 2).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(partial(_score, shared=shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def scored(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose fold by 7 is not 2 and scores every row."""
    return score(docs, train(docs.where(fold(F.col("doc_id"), 7) != 2)))
