"""N-gram Jaccard self-join by a token-group matrix.

Documents are compared as sets of distinct word shingles; two of them link when
``100 * |A & B| >= percent * |A | B|``.  The result is exact (up to collisions of 64-bit
hashes) and is given as components of linked documents, never as all pairs of a group.

1. *Classes.*  Equal sets share a 128-bit digest; one representative (least id) stands for them.
2. *Groups.*  Representatives meet under a few min-hash keys.  Keys with many of them are salted.
   A streaming pass over the sorted rows verifies each against at most LEADERS leading sets and
   keeps all exact links found; their components are the groups, in blocks of BLOCK members.
3. *Matrix.*  A global order puts frequent shingles last: tasks count those that several of their rows
   have, and the FREQUENT most frequent make the order.  Each representative gives its probing prefix;
   those rows, dealt by shingle, are the matrix of shingle against group.  Rows of one shingle that all
   belong to one group need no work.  Others yield (query, group) where sizes and positions still allow
   a link: of two groups the one with fewer members asks the other, so a large group doesn't ask for
   each stray copy.  A shingle that so many rows may have in their prefix that one task would be long at
   it is a square of cells of about CELL_ROWS rows by as many, and each cell a row of tasks' work alone.  The list
   tells such shingles beforehand.  The rows of a cell that has more than twice as many are handed on as they come; an
   unlisted shingle found so joins the list by its exact number and, as any order gives the same links, the prefixes are
   made again.  What is crowded after ROUNDS rounds is split by exact numbers, so no task compares or holds more.
4. *Bound and open.*  For such a pair the overlap of the query with the block's shingle union
   is an upper bound for every member.  Only blocks whose bound reaches the need are opened
   and their members verified; a block of one member is verified at once.
5. Components of all verified links.

A link between two different groups survives step 3, because the first common shingle of a
linked pair lies in the probing prefix of the longer and the indexing prefix of the shorter
set; a link within a group changes nothing.  So leaving the latter unverified loses nothing.

Edge cases: null or blank texts have the empty set and link with nothing; texts with fewer
than ``n`` words are one shingle; repeated rows get the same values; a row without an id
joins the component of an equal set that has one, else its component is null; rows that share an id but
differ in text get the component of their own text, and where that id is the least of both texts' classes
the links of both count for it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, flat_sets, mix, shingle_sets, signed, stored  # noqa: F401
from .components import components

LEADERS = 16  # sets held per key while grouping; what matches none of them is left to the matrix
CENTRES = 6  # of these, the first ones are held even where they match others
SALT_ROWS = 512  # representatives under one key and salt
BLOCK = 64  # members of a block of the matrix
LINKS = "u long, v long"
FEW = 4  # blocks that a query meets all at once
QUERY_ROWS = 2048  # queries that meet one copy of a block
FREQUENT = 1 << 20  # shingles at most in the list of frequent ones (12 MB), fixed at every scale
REPEATS = 4  # rows of a task that must have a shingle for it to be counted
COUNTED = 4_000_000  # shingles a task counts before it forgets those met once
ROUNDS = 2  # times at most that the list is mended
CELL_ROWS = 4096  # rows of a shingle that are compared with as many in one cell
PAIRS = 1 << 17  # pairs of rows compared at once, or those of one asker

_HEAD = np.uint64(42)  # bits of a hash below those that tell whether it may be in the list
_C, _D = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_KEYS = tuple(np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x71D67FFFEDA60000, 0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D))


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return common * (100 + percent) >= percent * (a + b) and common > 0


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct arrays link."""
    return min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and linked(overlap(a, b), len(a), len(b), percent)


def _mixed(flat: np.ndarray, bounds: np.ndarray, key: np.uint64, fold: np.ufunc) -> np.ndarray:
    """``fold`` of the mixed hashes of each row's set, 0 for an empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = fold.reduceat(mix(flat ^ key), bounds[:-1][some])
    return signed(out)


def _summaries(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(np.diff(bounds), *(_mixed(flat, bounds, k, np.add) for k in (_C, _D)), *(_mixed(flat, bounds, k, np.minimum) for k in _KEYS)) for _, flat, bounds in flat_sets(batch["text"], n)]
        size, d1, d2, *keys = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * (3 + len(_KEYS))
        some = size > 0
        ends = np.concatenate([[0], np.cumsum(some) * len(_KEYS)]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(keys, axis=1)[some].ravel()))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size), pa.array(d1), pa.array(d2), keys], ["doc_id", "n", "d1", "d2", "keys"])


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """Each row's set; empty where the row only has the id of a representative, whose digest is ``d1``."""
    d1 = batch["d1"].to_numpy(zero_copy_only=False)
    for first, flat, bounds in flat_sets(batch["text"], n):
        own = _mixed(flat, bounds, _C, np.add) == d1[first : first + len(bounds) - 1]
        for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), own.tolist(), strict=True):
            yield flat[a:b] if ok else flat[:0]


def _counted(parts: list[np.ndarray], token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, of ``parts`` and ``token``, and how often: ``count`` times for those of ``token``."""
    fresh = np.sort(np.concatenate(parts)) if parts else token[:0]
    edge = np.flatnonzero(np.concatenate([[True], fresh[1:] != fresh[:-1]])[: len(fresh)])
    fresh, times = fresh[edge], np.diff(np.concatenate([edge, [len(fresh)]]))
    if not len(token):
        return fresh, times
    at = np.searchsorted(token, fresh)
    old = token[np.minimum(at, len(token) - 1)] == fresh
    count = count.copy()
    count[at[old]] += times[old]
    return np.insert(token, at[~old], fresh[~old]), np.insert(count, at[~old], times[~old])


def _frequent(batches: Iterator[pa.RecordBatch], n: int, repeats: int, most: int) -> Iterator[pa.RecordBatch]:
    """Shingles that ``repeats`` or more rows of a task have, and how many."""
    token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts, held = [], 0
    for batch in batches:
        for _, flat, _ in flat_sets(batch["text"], n):
            parts.append(flat)
            held += len(flat)
            if held > most:
                token, count = _counted(parts, token, count)
                parts, held = [], 0
                if len(token) > most:
                    token, count = token[count > 1], count[count > 1]
    token, count = _counted(parts, token, count)
    often = count >= repeats
    yield pa.RecordBatch.from_arrays([pa.array(signed(token[often])), pa.array(count[often])], ["token", "count"])


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, about FREQUENT at most, sorted, and their counts.  The list only orders shingles; any list gives the same links."""
    counted = stored(docs.select("text").mapInArrow(partial(_frequent, n=n, repeats=REPEATS, most=COUNTED), "token long, count long").groupBy("token").agg(F.sum("count").alias("count")), "frequent")
    size = F.ceil(F.log2("count") * 8).cast("int")
    least, room, of = 0, FREQUENT, 1  # of the least size class the share room / of is taken, by hash
    for row in counted.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # a few hundred rows
        if row.n > room:
            least, of = row.size, row.n
            break
        room -= row.n
    table = counted.where((size > least) | (size == least) & (F.pmod(F.xxhash64("token"), F.lit(of)) < room)).toArrow()
    drop_stored(counted)
    token = table["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], table["count"].to_numpy()[order]


def _relisted(asked: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """The list with the crowded shingles it lacks, by their exact numbers, about FREQUENT at most; None if it lacks none."""
    crowded = asked.where("token is not null and cell = 0").groupBy("token").agg(F.count("*").alias("count"))
    rows = crowded.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()  # of shingles with over 2 * CELL_ROWS rows each
    token, count = rows["token"].to_numpy().astype(np.int64).view(np.uint64), rows["count"].to_numpy()
    new = ~np.isin(token, order[0])
    if not new.any():
        return None
    token, count = np.concatenate([order[0], token[new]]), np.concatenate([order[1], count[new]])
    kept = np.argsort(-count, kind="stable")[: max(FREQUENT, len(order[0]))]
    kept = kept[np.argsort(token[kept])]
    return None if np.array_equal(token[kept], order[0]) else (token[kept], count[kept])


def _often(s: np.ndarray, order: tuple[np.ndarray, np.ndarray], heads: np.ndarray) -> np.ndarray:
    """How often each shingle was counted, 0 where it isn't in the list; ``heads`` tells which leading bits any in the list has."""
    token, count = order
    often = np.zeros(len(s), np.int64)
    maybe = np.flatnonzero(heads[s >> _HEAD])
    if len(maybe):
        at = np.minimum(np.searchsorted(token, s[maybe]), len(token) - 1)
        often[maybe] = np.where(token[at] == s[maybe], count[at], 0)
    return often


def _rarest(often: np.ndarray, row: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, places): the ``keep`` shingles of each row that were counted least, of equal ones the least hashes, and their places in this order."""
    listed = np.flatnonzero(often)
    unlisted = np.concatenate([[0], np.cumsum(often == 0)])
    rare = unlisted[bounds[1:]] - unlisted[bounds[:-1]]
    at = np.flatnonzero(often == 0)
    place = unlisted[at] - unlisted[bounds[:-1]][row[at]]
    ok = place < keep[row[at]]
    listed = listed[(rare < keep)[row[listed]]]
    if not len(listed):
        return at[ok], place[ok]
    listed = listed[np.lexsort((often[listed], row[listed]))]  # stable: rows hold their hashes sorted
    of = row[listed]
    after = np.arange(len(of)) - np.searchsorted(of, of) + rare[of]
    fits = after < keep[of]
    return np.concatenate([at[ok], listed[fits]]), np.concatenate([place[ok], after[fits]])


def _grouping(batches: Iterator[pa.RecordBatch], n: int, percent: int, most: int, centres: int) -> Iterator[pa.RecordBatch]:
    """Verified links (u, v) between rows and the leading sets of their key; rows come sorted by key."""
    key, leaders = None, []
    for batch in batches:
        links: list[tuple[int, int]] = []
        for k, salt, doc, s in zip(batch["k"].to_pylist(), batch["salt"].to_pylist(), batch["doc_id"].to_pylist(), _sets(batch, n), strict=True):
            if key != (k, salt):
                key, leaders = (k, salt), []
            if not len(s):
                continue
            alone = True
            for lead, held in leaders:
                if alike(s, held, percent):
                    links.append((doc, lead))
                    alone = False
            if len(leaders) < most and (alone or len(leaders) < centres):
                leaders.append((doc, s))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])


def probing(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def indexing(n: np.ndarray | int, percent: int):
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, order, cell_rows: int) -> Iterator[pa.RecordBatch]:
    """The probing prefix of each set in the global order: rare shingles first.

    Cell 0 is a whole shingle.  A row of a shingle with cells is in band ``doc_id`` modulo their number; it is
    held in the cells of its column and asks in those of its row (``role`` 1 and 2; 3 is both).
    """
    names = ["token", "cell", "doc_id", "grp", "members", "np", "role"]
    heads = np.zeros(1 << (64 - int(_HEAD)), bool)
    heads[order.value[0] >> _HEAD] = True
    for batch in batches:
        parts = []
        d1 = batch["d1"].to_numpy(zero_copy_only=False)
        for first, flat, bounds in flat_sets(batch["text"], n):
            sizes = np.diff(bounds)
            own = (sizes > 0) & (_mixed(flat, bounds, _C, np.add) == d1[first : first + len(sizes)])
            row = np.repeat(np.arange(len(sizes)), sizes)
            often = _often(flat, order.value, heads)
            at, place = _rarest(often, row, bounds, np.where(own, probing(sizes, percent), 0))
            parts.append((flat[at], first + row[at], place, sizes[row[at]], often[at]))
        if not parts:
            continue
        token, row, place, size, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = batch["doc_id"].to_numpy(zero_copy_only=False)[row]
        bands = -(-count // cell_rows)
        one = np.flatnonzero(bands <= 1)
        cell, source, role = [np.zeros(len(one), np.int64)], [one], [np.full(len(one), 3, np.int8)]
        for i in np.flatnonzero(bands > 1).tolist():
            k = int(bands[i])
            band, each = int(mix(doc[i : i + 1].astype(np.uint64))[0] % np.uint64(k)), np.arange(k)
            cell += [1 + band * k + each, 1 + each * k + band]  # asks along its row, is held down its column
            source.append(np.full(2 * k, i))
            role.append(np.repeat(np.array([2, 1], np.int8), k))
        at, cell, role = np.concatenate(source), np.concatenate(cell), np.concatenate(role)
        taken = pa.array(row[at])
        cols = [pa.array(signed(token[at])), pa.array(cell), pa.array(doc[at]), batch["grp"].take(taken), batch["members"].take(taken), pa.array(((size << 32) | place)[at]), pa.array(role)]
        yield pa.RecordBatch.from_arrays(cols, names)


def _celled(rows: DataFrame) -> DataFrame:
    """Rows of crowded cells, dealt to cells of about CELL_ROWS rows by as many by their exact number.

    A row is in one of the cell's bands; it asks along its row of new cells if it asked before, and is held down its column
    if it was held.
    """
    at = F.xxhash64("token", "cell")
    crowded = rows.groupBy(at.alias("token")).agg(F.ceil(F.count("*") / CELL_ROWS).alias("bands"))
    band, bands = F.pmod(F.xxhash64("doc_id"), F.col("bands")), F.col("bands")
    along = F.sequence(F.lit(0).cast("long"), bands - 1)
    cells = lambda role, number: F.when(F.col("role").bitwiseAND(role) > 0, F.transform(along, lambda e: F.struct(number(e).alias("cell"), F.lit(role).cast("byte").alias("role")))).otherwise(F.array().cast("array<struct<cell:bigint,role:tinyint>>"))
    new = F.concat(cells(2, lambda e: 1 + band * bands + e), cells(1, lambda e: 1 + e * bands + band))
    split = rows.withColumn("token", at).join(crowded, "token").withColumn("at", F.explode(new))
    return split.select("token", "at.cell", "doc_id", "grp", "members", "np", "at.role")


def _distinct(doc: np.ndarray, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grp, doc))
    doc, grp = doc[order], grp[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (grp[1:] != grp[:-1])])[: len(doc)]
    return doc[new], grp[new]


def _pairs(first: np.ndarray, last: np.ndarray, grp: np.ndarray, members: np.ndarray, doc: np.ndarray, np_: np.ndarray, role: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, group) pairs that the rows of each cell ``first`` to ``last`` still allow, about PAIRS compared at once."""
    length = last - first
    asks = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
    cell = np.repeat(np.arange(len(first)), length)
    asking = (role[asks] & 2) > 0
    asks, cell = asks[asking], cell[asking]
    before = np.concatenate([[0], np.cumsum(length[cell])])  # pairs of the askers so far
    a = 0
    while a < len(asks):
        b = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, "right")) - 1)
        each = length[cell[a:b]]
        q = np.repeat(asks[a:b], each)
        held = np.repeat(first[cell[a:b]] - before[a:b] + before[a], each) + np.arange(len(q))
        less = (members[q] < members[held]) | ((members[q] == members[held]) & (grp[q] > grp[held]))
        ok = np.flatnonzero(less & ((role[held] & 1) > 0))
        q, held = q[ok], held[ok]
        size, other = np_[q] >> 32, np_[held] >> 32
        place, there = np_[q] & 0xFFFFFFFF, np_[held] & 0xFFFFFFFF
        small, large = np.minimum(size, other), np.maximum(size, other)
        most = np.minimum(size - place, other - there)
        ok = ((place < indexing(size, percent)) & (size == small)) | ((there < indexing(other, percent)) & (other == small))
        ok &= (small * 100 >= percent * large) & (most * (100 + percent) >= percent * (small + large))
        if ok.any():
            yield _distinct(doc[q[ok]], grp[held[ok]])
        a = b


_ROWS = ("token", "cell", "grp", "members", "doc_id", "np", "role")
_CANDIDATES = "token long, cell long, grp long, members long, doc_id long, np long, role byte"


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, grp), a query and another group that a cell's rows still allow; rows come sorted by shingle, cell and group.

    A cell of more than ``most`` rows is handed on as it is, row by row, so that it can be split: only such rows have a token.
    """
    left: list[np.ndarray] = []
    crowded = None  # the cell that is being handed on

    def handed(cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [*_ROWS])

    def result(cols):
        token, cell, grp, members, doc, np_, role = cols
        edge = np.flatnonzero((token[1:] != token[:-1]) | (cell[1:] != cell[:-1])) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(token)]])
        mixed = grp[first] != grp[last - 1]  # sorted by group within a cell
        large = np.zeros(len(first), bool) if most is None else last - first > most
        for a, b in zip(first[mixed & large].tolist(), last[mixed & large].tolist(), strict=True):
            yield handed([x[a:b] for x in cols])
        found = list(_pairs(first[mixed & ~large], last[mixed & ~large], grp, members, doc, np_, role, percent))
        if found:
            docs, groups = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
            none = pa.nulls(len(docs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(groups), none, pa.array(docs), none, pa.nulls(len(docs), pa.int8())], [*_ROWS])

    for batch in batches:
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in _ROWS]
        if crowded and len(cols[0]):
            own = (cols[0] == crowded[0]) & (cols[1] == crowded[1])
            if own.any():
                yield handed([x[own] for x in cols])
                cols = [x[~own] for x in cols]
            if len(cols[0]):
                crowded = None
        if left:
            cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
        if not len(cols[0]):
            continue
        whole = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])
        cut = int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0  # the last cell may go on in the next batch
        left = [x[cut:].copy() for x in cols]
        if cut:
            yield from result([x[:cut] for x in cols])
        if most is not None and len(left[0]) > most:
            crowded = (left[0][0], left[1][0])
            yield handed(left)
            left = []
    if left:
        yield from result(left)


def _met(rows: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Candidates of rows dealt by shingle and cell, and the rows of cells with more than ``most``."""
    return rows.repartition("token", "cell").sortWithinPartitions("token", "cell", "grp").select(*_ROWS).mapInArrow(partial(_candidates, percent=percent, most=most), _CANDIDATES)


def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Members of a block come first, then its queries: bound each query by the union, then open."""
    key, members, union = None, [], None
    for batch in batches:
        links: list[tuple[int, int]] = []
        for *now, is_query, doc, s in zip(*(batch[c].to_pylist() for c in ("grp", "part", "salt", "is_query", "doc_id")), _sets(batch, n), strict=True):
            if key != now:
                key, members, union = now, [], None
            if not len(s):
                continue
            if not is_query:
                members.append((doc, s))
                continue
            if union is None and len(members) > 1:
                union = _counted([x for _, x in members], s[:0], s[:0])[0]
            if union is not None and overlap(s, union) * 100 < percent * len(s):
                continue
            links += [(doc, other) for other, held in members if other != doc and alike(s, held, percent)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])


def _far(docs: DataFrame, placed: DataFrame, sizes: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (u, v) between the queries of ``wanted`` (doc_id, grp, part) and the members of those blocks."""
    salts = wanted.groupBy("grp", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("salts"))
    bins = placed.join(sizes, "grp").select("doc_id", "grp", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))
    members = bins.join(salts, ["grp", "part"]).select("doc_id", "grp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_query"))
    asks = wanted.join(salts, ["grp", "part"]).select("doc_id", "grp", "part", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"), F.lit(True).alias("is_query"))
    rows = stored(members.unionByName(asks).join(placed.select("doc_id", "d1"), "doc_id"), "rows")
    links = stored(
        docs.join(rows.hint("merge"), "doc_id").repartition("grp", "part", "salt").sortWithinPartitions("grp", "part", "salt", "is_query", "doc_id").mapInArrow(partial(_verify, n=n, percent=percent), LINKS), "far")
    drop_stored(rows, wanted)
    return links


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    summary = stored(docs.mapInArrow(partial(_summaries, n=n), "doc_id long, n long, d1 long, d2 long, keys array<long>"), "summaries")
    classes = stored(
        summary.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")).where("doc_id is not null"), "classes")

    keyed = classes.select("doc_id", "d1", F.posexplode("keys").alias("w", "k"))
    heavy = keyed.groupBy("w", "k").agg(F.count("*").alias("c")).where("c > 1")
    active = stored(keyed.join(heavy, ["w", "k"]).select("doc_id", "d1", F.xxhash64("w", "k").alias("k"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / SALT_ROWS)).alias("salt")), "active")
    near = stored(
        docs.join(active.hint("merge"), "doc_id").repartition("k", "salt").sortWithinPartitions("k", "salt", "doc_id").mapInArrow(partial(_grouping, n=n, percent=percent, most=LEADERS, centres=CENTRES), LINKS), "near")
    drop_stored(active)
    groups = stored(components(near), "groups")

    order = spark.sparkContext.broadcast(frequent(docs, n))
    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("members")), "component").withColumnRenamed("node", "doc_id")
    placed = stored(
        classes.select("doc_id", "d1").join(sized, "doc_id", "left").select("doc_id", "d1", F.coalesce("component", "doc_id").alias("grp"), F.coalesce("members", F.lit(1).cast("long")).alias("members")), "placed")
    for again in range(ROUNDS, -1, -1):
        prefixes = docs.join(placed.hint("merge"), "doc_id").mapInArrow(partial(_prefixes, n=n, percent=percent, order=order, cell_rows=CELL_ROWS), "token long, cell long, doc_id long, grp long, members long, np long, role byte")
        asked = stored(_met(prefixes, percent, 2 * CELL_ROWS), "asked")
        more = _relisted(asked, order.value) if again else None
        if more is None:
            break
        drop_stored(asked)
        order.unpersist()
        order = spark.sparkContext.broadcast(more)
    rest = stored(_met(_celled(asked.where("token is not null")), percent, None), "asked")
    found = stored(asked.where("token is null").unionByName(rest).select("doc_id", "grp").distinct(), "candidates")
    drop_stored(asked, rest)

    # A group folds to blocks of about BLOCK members.  A query whose groups have FEW blocks in all meets these.  Any
    # other first meets one block of its largest group; what still lies in another component meets all of its groups.
    sizes = stored(placed.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.count("*").alias("members")), "sizes")
    asked_of = found.join(sizes, "grp")
    queries = stored(asked_of.groupBy("doc_id").agg(F.max_by("grp", F.struct("members", -F.col("grp"))).alias("best"), F.sum("parts").alias("blocks")), "queries")
    parts = F.when(F.col("blocks") <= FEW, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), "parts")))
    first = asked_of.join(queries, "doc_id").where((F.col("blocks") <= FEW) | (F.col("grp") == F.col("best"))).select("doc_id", "grp", F.explode(parts).alias("part"))
    links = [near, _far(docs, placed, sizes, stored(first, "wanted"), n, percent)]
    label = stored(components(links[0].unionByName(links[1])), "labels")
    of_query = found.join(queries.where(F.col("blocks") > FEW).select("doc_id"), "doc_id").join(label.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left")
    open_ = of_query.join(label.select(F.col("node").alias("grp"), F.col("component").alias("g")), "grp", "left").where(F.coalesce("c", "doc_id") != F.coalesce("g", "grp"))
    rest = open_.select("doc_id", "grp").join(sizes, "grp").select("doc_id", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    wanted = stored(rest, "wanted")
    if wanted.isEmpty():
        drop_stored(wanted)
    else:
        links.append(_far(docs, placed, sizes, wanted, n, percent))
    drop_stored(found, sizes, queries, groups, placed, label)
    whole = components(reduce(DataFrame.unionByName, links))

    labels = classes.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("n", "d1", "d2", F.coalesce("component", "doc_id").alias("component_id"))
    out = stored(summary.join(labels, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    drop_stored(summary, classes, whole, *links)
    return out


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, one for each component: that with the least id.

    Of several rows with this id that with the least text digest stays.  Rows without an id can't be told apart and stay.
    """
    joined = ngram_components(docs, n, percent)
    first = joined.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    first = first.withColumnRenamed("doc_id", "_least").hint("merge")
    kept = docs.select(F.struct("*").alias("_doc")).join(first, F.col("_doc.doc_id").cast("long") == F.col("_least"))  # no name of docs can clash
    single = kept.where("_rows = 1").select("_doc.*")
    several = kept.where("_rows > 1").groupBy("_least").agg(F.min_by("_doc", F.coalesce(F.md5(F.col("_doc.text").cast("binary")), F.lit(""))).alias("_doc")).select("_doc.*")
    return single.unionByName(several).unionByName(docs.where("doc_id is null"))
