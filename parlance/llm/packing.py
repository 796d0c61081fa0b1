"""Packing documents into sequences: best fit, then a swap-based local search.

Documents are tokenised (byte-level BPE, one end token each); longer ones than a sequence are cut
from the end into whole sequences, so that only the first piece may be shorter.  Pieces are dealt by
a hash into blocks of about BLOCK_ROWS, each packed on its own in one task: at 2048 tokens a block
loses less than a sequence against packing all at once.  A piece as long as a sequence has its own.

Within a block, pieces are placed by best fit in decreasing order.  While there are more bins than
a lower bound, the local search takes the emptiest underfull bin and moves length from it to other
bins: it moves a piece, exchanges one for one or two for one, until the bin is empty or nothing helps.
The best exchange is looked up by size and room, so its cost doesn't follow the number of pieces.

The ids are those of ``tokenizers`` with the given file; they are computed by ``tiktoken`` over the
same vocabulary, read from that file, which takes a sixth of the time.

Edge cases: a null or empty text is the end token alone; repeated rows are packed as often as they
occur; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH = 2048
END = 0
BLOCK_ROWS = 20_000
END_OF_TEXT = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def encoding(path: str):
    """The byte-level BPE of a ``tokenizers`` file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the printable stand-ins of bytes in such files: printable Latin-1 stand for themselves, others follow from 256
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), frozenset(special)


def token_ids(text: str | None, path: str) -> np.ndarray:
    bpe, special = encoding(path)
    if not text:
        return np.zeros(0, "<u4")
    found = {s for s in special if s in text}
    return np.asarray(bpe.encode_to_numpy(text, allowed_special=found, disallowed_special=()), "<u4")


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids = np.append(token_ids(text.as_py(), path), np.uint32(END)).astype("<u4")
            first = len(ids) % length or length
            cuts = [0, *range(first, len(ids) + 1, length)]
            rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers by best fit in decreasing order; a bit set finds the tightest bin."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fitting = present >> size
        if fitting:
            slack = (fitting & -fitting).bit_length() - 1 + size
            at = open_bins[slack].pop()
            if not open_bins[slack]:
                present ^= 1 << slack
            bins[at].append(item)
        else:
            slack, at = capacity, len(bins)
            bins.append([item])
        left = slack - size
        if left:
            if not open_bins[left]:
                present |= 1 << left
            open_bins[left].append(at)
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound of the number of bins (Martello and Toth 1990): pieces over half a bin never share one."""
    size, count = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    total = np.concatenate([[0], np.cumsum(size * count)])
    number = np.concatenate([[0], np.cumsum(count)])
    half = int(np.searchsorted(size, capacity // 2, "right"))  # the first size over half
    best = -(-int(total[-1]) // capacity)
    for k, least in enumerate([0, *size[:half].tolist()]):
        low = max(k - 1, 0)
        alone = int(np.searchsorted(size, capacity - least, "right"))  # sizes that nothing of at least ``least`` fits beside
        alone = max(alone, half)
        large, middle = int(number[-1] - number[alone]), int(number[alone] - number[half])
        room = middle * capacity - int(total[alone] - total[half])
        rest = int(total[half] - total[low]) - room
        best = max(best, large + middle + max(0, -(-rest // capacity)))
    return best


class Bins:
    """Bins by their contents: for each size, the underfull bins that hold it, by the room they have.

    A size and a room are at most the capacity, so the best exchange is found among sizes, however many
    pieces and bins there are.  Size 0 stands for any bin: nothing comes back.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.capacity = capacity
        self.items: list[dict[int, list[int]]] = [{} for _ in bins]
        for held, items in zip(self.items, bins, strict=True):
            for i in items:
                held.setdefault(sizes[i], []).append(i)
        self.fill = [sum(sizes[i] for i in items) for items in bins]
        self.holders: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]  # by size and room
        self.rooms = [0] * (capacity + 1)  # by size: a bit set of the rooms
        self.most = np.full(capacity + 1, -1, np.int64)  # by size: the largest room
        for b in range(len(bins)):
            self.list(b)

    def list(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.fill[b]:
            for y in (0, *self.items[b]):
                self.holders[y].setdefault(room, {})[b] = None
                self.rooms[y] |= 1 << room
                self.most[y] = max(self.most[y], room)

    def unlist(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.fill[b]:
            for y in (0, *self.items[b]):
                held = self.holders[y][room]
                del held[b]
                if not held:
                    del self.holders[y][room]
                    self.rooms[y] ^= 1 << room
                    self.most[y] = self.rooms[y].bit_length() - 1

    def _take(self, b: int, size: int) -> int:
        held = self.items[b][size]
        item = held.pop()
        if not held:
            del self.items[b][size]
        self.fill[b] -= size
        return item

    def _put(self, b: int, size: int, item: int) -> None:
        self.items[b].setdefault(size, []).append(item)
        self.fill[b] += size

    def empty(self, source: int) -> bool:
        """Moves pieces, one for one and two for one, from a bin that isn't listed until it is empty or nothing helps.

        Each exchange takes the most length from the bin, into the fullest bin that has the room, and makes
        the sum of squared fills grow.
        """
        while self.items[source]:
            kinds = sorted(self.items[source])
            gives = {x: (x,) for x in kinds}
            for n, x in enumerate(kinds):
                for z in kinds[n + (len(self.items[source][x]) < 2) :]:
                    gives.setdefault(x + z, (x, z))
            out = np.array(sorted(gives), np.int64)
            back = np.flatnonzero(self.most >= 0)
            at = np.searchsorted(out, back + self.most[back], "right") - 1
            gain = np.where(at >= 0, out[np.maximum(at, 0)] - back, 0)
            for best in np.argsort(-gain, kind="stable").tolist():
                moved = int(gain[best])
                if moved <= 0:
                    return False
                fitting = self.rooms[back[best]] >> moved
                room = (fitting & -fitting).bit_length() - 1 + moved
                if room - moved < self.capacity - self.fill[source]:  # the sum of squared fills grows
                    break
            else:
                return False
            y, given = int(back[best]), gives[int(out[at[best]])]
            target = next(iter(self.holders[y][room]))
            self.unlist(target)
            if y:
                taken = self._take(target, y)
            for x in given:
                self._put(target, x, self._take(source, x))
            if y:
                self._put(source, y, taken)
            self.list(target)
        return True


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by exchanges, the emptiest first, until a lower bound is met or a round over all bins empties none."""
    state, alive, least = Bins(bins, sizes, capacity), {i for i, b in enumerate(bins) if b}, least_bins(sizes, capacity)
    emptied = True
    while emptied and len(alive) > least:
        emptied = False
        waiting = [(state.fill[i], i) for i in alive if state.fill[i] < capacity]
        heapq.heapify(waiting)
        while waiting and len(alive) > least:
            fill, source = heapq.heappop(waiting)
            if fill != state.fill[source]:  # it took length since
                if state.fill[source] < capacity:
                    heapq.heappush(waiting, (state.fill[source], source))
                continue
            state.unlist(source)
            if state.empty(source):
                alive.remove(source)
                emptied = True
            else:
                state.list(source)
    return [[i for held in state.items[b].values() for i in held] for b in sorted(alive)]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers for sizes from 1 to ``capacity``."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _pack_block(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
    sizes = frame["length"].tolist()
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for number, items in enumerate(pack(sizes, capacity)):
        at = 0
        for i in items:
            sequence[i], offset[i] = number, at
            at += sizes[i]
    frame["sequence_id"], frame["offset"] = frame["block"].to_numpy() * (1 << 32) + sequence, offset
    return frame.drop(columns="block")


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(PACKED) one row for each piece of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stored(rows.mapInArrow(partial(_pieces, path=path or default_path(), length=length), PIECES), "pieces")
    whole = pieces.where(F.col("length") == length)
    part = pieces.where(F.col("length") < length)
    blocks = max(1, -(-part.count() // block_rows))
    dealt = part.withColumn("block", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.rand(7)), F.lit(blocks)))
    short = dealt.groupBy("block").applyInPandas(partial(_pack_block, capacity=length), PACKED)
    # a whole piece has a negative number that no block uses
    alone = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(alone)
