"""Pieces shared by the corpus operators: intermediate tables, Arrow text batches, word hashing.

Texts reach Python as Arrow string columns.  All word work is done on the UTF-8 bytes of a
slice of rows at once with numpy, so that no Python string is built per word.  A slice
holds a few megabytes (or one row), which bounds the worker's memory whatever the batch.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one numpy call; longer single texts form a slice of their own.
SLICE_BYTES = 2 << 20
#: The same where shingles are made: their arrays, eight bytes for each of the text, then stay in a core's cache.
SET_BYTES = 1 << 18

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- intermediate tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that every node of the cluster sees (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder is set for it if driver and executors are one process;
    on a cluster that is an error, as no folder of the driver's is seen by executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        found = f"file://{tempfile.mkdtemp(prefix='parlance-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parlance/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more, and frees their shuffle files."""
    for df in frames:
        spark = df.sparkSession
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:  # one, or those of a union
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs stay until the driver collects its garbage; this asks for it."""
    gc.collect()
    spark._jvm.System.gc()


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- Arrow text batches


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar(b"").cast(column.type))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) for slices of about ``most`` bytes, SLICE_BYTES if not given."""
    most = most or SLICE_BYTES
    data, offs = text_bytes(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = int(np.searchsorted(offs, offs[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


# ---------------------------------------------------------------- words and hashes

#: Space and \t \n \v \f \r separate words; every other byte belongs to one.
_NONSPACE = np.ones(256, bool)
_NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the range of its words (rows + 1 bounds)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = _NONSPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that scatters their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit integers that depend on the seed alone."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = seeded(11, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0xD1342543DE82EF95 | 2  # odd, and one less is twice an odd number
_BASE = (_BASE & ~3) | 3
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z folded to a-z, from one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * power, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


_PLACE = seeded(23, 64) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, row bounds ignored (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m] * _PLACE[0]
    for j in range(1, n):
        total += words[j : j + m] * _PLACE[j]
    return mix(total)


def short_hash(words: np.ndarray) -> np.uint64:
    """The hash of a whole sequence that is shorter than a gram; its length is part of it."""
    return mix((words * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _PLACE[32 + len(words)])[0]


def flat_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) for slices of rows: the sorted distinct hashes of each row's n-word shingles, row after row."""
    for first, _, data, offs in slices(column, SET_BYTES):
        starts, ends, bounds = word_spans(data, offs)
        words = word_hashes(data, starts, ends)
        flat = words.copy()
        grams = gram_hashes(words, n)
        flat[: len(grams)] = grams
        count = np.diff(bounds)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                flat[a : b - n + 1].sort()
            elif b > a:
                flat[a] = short_hash(words[a:b])
        place = np.arange(len(flat)) - np.repeat(bounds[:-1], count)
        keep = place < np.repeat(np.where(count >= n, count - n + 1, 1), count)
        keep[1:] &= (flat[1:] != flat[:-1]) | (place[1:] == 0)
        yield first, flat[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles (see ``ngram_join``)."""
    for _, flat, bounds in flat_sets(column, n):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield flat[a:b]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
