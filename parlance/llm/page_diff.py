"""Main text of web pages by nearest-URL page differencing.

Pages that share host and path (``place_of``) are views of one page.  The paths of a host are put in order, so that of the paths before
and after a path one has the longest start in common with it; its page is the nearest page.  The text lines of a page and of
its nearest page are aligned by a longest common subsequence, and shared lines are deleted: they are the site's.

Two things that differencing can't tell alone are settled from the markup and from all pages:

* Menus, adverts and footers hold other text on every page.  Lines in elements that say what they are (``html_lines.lines``) are
  aligned by these elements instead of by text, a run of them as one; those that the nearest page lacks are no text either.
* A copied article or a much-quoted passage is shared, but it isn't the site's.  A shared line is deleted only if half or more of the host's
  paths have it and more than half of all paths that have it are this host's.  In an article or main element three paths must have it, elsewhere two.
  Where over half of a page's text is shared, the two pages are taken for copies and such lines go only if ten paths have them.

Paths are ordered by a range partitioning whose edges are carried over, lines are counted by host after each task has added up its
own, and the counts of a line reach only the host that has most of them, so neither a crowded host nor a frequent line is gathered in one
task.  Pages are read and parsed twice, so that their texts are never stored and dealt out once, packed.  A host's list of site lines holds at most twice the mean number of lines of its pages.

Edge cases: a null or blank html gives an empty text; a null url is an unnamed host's; pages without a second path on their host are
judged by markup alone.  Pages cut off inside a tag lose that tag.  Repeated rows give a row each, no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .html_lines import Line, article, lines, place_of, shared

#: Paths of a host that must have a shared line outside and inside an article, and those from which copies don't matter.
LEAST_OUTSIDE, LEAST_INSIDE, SURE = 2, 3, 10
#: Share of a page's text from which it counts as a copy of the page beside it.
COPIED = 0.5

_KEYS = "page_id long, url string, host string, path string, all_lines array<long>"
_WHOLE = _KEYS + ", texts binary, size int, places array<int>, furniture array<int>, marked boolean"
_NEAR = "host string, path string, near array<long>, known array<long>, counts array<long>"
_TEXT = "page_id long, url string, text string, n_chars long, n_shared long, n_marked long"


def _key(text: str) -> int:
    """A 64-bit digest.  Two lines that share one matter only if their pages are beside each other or their hosts have both."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entries(found: list[Line], places: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(what is aligned, where the lines at ``places`` are in it, where page furniture is in it)."""
    keys, at, furniture, chosen, last = [], [], [], {*places}, None
    for i, x in enumerate(found):
        if x.chrome and x.slot == last:
            continue
        last = x.slot if x.chrome else None
        if i in chosen:
            at.append(len(keys))
        if x.chrome:
            furniture.append(len(keys))
        keys.append(_key(f"<{x.slot}" if x.chrome else x.text))
    return keys, at, furniture


def _parsed(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """What is aligned of each page; ``whole``: also its lines, as one packed text, as they are dealt once more."""
    zstd = pa.Codec("zstd")
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, rows = batch.slice(at, 64), []
            for page, url, html in zip(part["page_id"].to_pylist(), part["url"].to_pylist(), part["html"].to_pylist(), strict=True):
                found = lines(html)
                places, marked = article(found)
                keys, at_keys, furniture = entries(found, places)
                row = [page, url, *place_of(url), keys]
                if whole:
                    text = "\n".join(found[i].text for i in places).encode("utf-8", "replace")
                    row += [zstd.compress(text, asbytes=True), len(text), at_keys, furniture, marked]
                rows.append(row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())] + [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()] * whole
            names = ["page_id", "url", "host", "path", "all_lines"] + ["texts", "size", "places", "furniture", "marked"] * whole
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pages before and after on the host the one whose path has the longer start in common, and its site lines."""
    for batch in batches:
        near, known, counts = [], [], []
        for row in batch.to_pylist():
            beside = [x for x in (row["before"], row["after"]) if x is not None]
            best = max(beside, key=lambda x: len(commonprefix([x["path"], row["path"]])))["all_lines"] if beside else None
            here = {*best} if best else ()
            own = [x for x in row["site"] or () if x["line"] in here]
            near.append(best)
            known.append([x["line"] for x in own])
            counts.append([x["paths"] for x in own])
        yield pa.RecordBatch.from_arrays(
            [batch["host"], batch["path"], pa.array(near, pa.list_(pa.int64())), pa.array(known, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["host", "path", "near", "known", "counts"])


def stays(texts: list[str], places: list[int], marked: bool, both: list[bool], keys: list[int], paths: dict[int, int]) -> list[bool]:
    """Which lines of a page are kept; ``both``: what its nearest page shares, ``paths``: how many paths of the host have each of its site lines."""
    copied = sum(len(t) for t, i in zip(texts, places, strict=True) if both[i]) > COPIED * sum(map(len, texts))
    least = max(LEAST_INSIDE if marked else LEAST_OUTSIDE, SURE if copied else 0)
    return [not (both[i] and paths.get(keys[i], 0) >= least) for i in places]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = pa.Codec("zstd")
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, rows = batch.slice(at, 64), []
            for r in part.to_pylist():
                both = shared(r["all_lines"], r["near"] or [])
                texts = zstd.decompress(r["texts"], r["size"], asbytes=True).decode().split("\n") if r["places"] else []
                keep = stays(texts, r["places"], r["marked"], both, r["all_lines"], dict(zip(r["known"] or (), r["counts"] or (), strict=True)))
                text = "\n".join(t for t, k in zip(texts, keep, strict=True) if k)
                with_near = sum(both[i] for i in r["furniture"])
                rows.append((text, len(text), keep.count(False) + with_near, len(r["furniture"]) - with_near))
            text, chars, common, alone = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in (chars, common, alone))], ["page_id", "url", "text", "n_chars", "n_shared", "n_marked"])


def _beside(ranged: DataFrame) -> DataFrame:
    """Each (host, path, all_lines, part) with the rows before and after on its host, in the order of paths.

    The order is cut into ranges, the parts; each also gets the last row before it and the first after it.
    """
    row = F.struct("host", "path", "all_lines")
    edges = ranged.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    order = Window.orderBy("part")  # one row for each range
    outer = edges.select("part", F.lag("last").over(order).alias("b"), F.lead("first").over(order).alias("a"))
    ghosts = outer.select("part", F.explode(F.array("b", "a")).alias("row")).where("row is not null")
    own = Window.partitionBy("part").orderBy("host", "path")
    with_ghosts = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("row.host", "row.path", "row.all_lines", "part", F.lit(True).alias("ghost")))
    other = F.struct("host", "path", "all_lines")
    return with_ghosts.select("host", "path", "ghost", F.lag(other).over(own).alias("b"), F.lead(other).over(own).alias("a")).where("not ghost").select(
        "host", "path", *(F.when(F.col(x)["host"] == F.col("host"), F.struct(F.col(x)["path"].alias("path"), F.col(x)["all_lines"].alias("all_lines"))).alias(name) for x, name in (("b", "before"), ("a", "after"))))


def _site_lines(paths: DataFrame) -> DataFrame:
    """(host, site): the lines that half or more of a host's paths have and that are mostly this host's, with their paths."""
    sizes = paths.groupBy("host").agg(F.count("*").alias("paths"))
    each = paths.select("host", F.explode(F.array_distinct("all_lines")).alias("line")).groupBy("line", "host").agg(F.count("*").alias("n"))
    most = each.groupBy("line").agg(F.sum("n").alias("total"), F.max(F.struct("n", "host")).alias("top")).where("top.n >= 2 and 2 * top.n > total")
    lines_of = most.select("top.host", "line", F.col("top.n").alias("n")).join(sizes, "host").where("2 * n >= paths")
    return lines_of.groupBy("host").agg(F.collect_list(F.struct("line", F.col("n").alias("paths"))).alias("site"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_marked) of each row (page_id, url, html).

    n_shared counts what was deleted as shared with the nearest page (runs of page furniture as one), n_marked furniture that it lacks.
    """
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = stored(given.mapInArrow(partial(_parsed, whole=False), _KEYS), "page-lines")
    first = parsed.groupBy("host", "path").agg(F.min(F.struct("page_id", "url", "all_lines")).alias("first")).select("host", "path", "first.all_lines")
    paths = stored(first.repartitionByRange("host", "path").withColumn("part", F.spark_partition_id()), "page-paths")
    site = stored(_site_lines(paths), "page-site")  # a table of its own, so that the join can split a host of many paths
    near = stored(_beside(paths).join(site, "host", "left").mapInArrow(_nearest, _NEAR), "page-near")
    drop_stored(paths, parsed, site)
    return given.mapInArrow(partial(_parsed, whole=True), _WHOLE).join(near, ["host", "path"], "left").mapInArrow(_texts, _TEXT)
