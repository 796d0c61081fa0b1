"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives counts (``COUNTS``) and a vector of transformed statistics (``FEATURES``).  For each
language and source the location and scatter of the vectors are estimated from the HALF that lies
closest together (Rousseeuw and Van Driessen 1999).  Concentration steps, each of which keeps the HALF
nearest rows by Mahalanobis distance, run from three starts that no random choice enters: medians and
quartile ranges, mean and covariance, and spatial signs around the medians (Hubert and others 2012).
The result with the least determinant is kept, and a reweighted estimate follows.  Rows beyond the
cut-off distance are rejected.

Every step is one aggregation over all rows: rows fall into distance bins, each bin has its count,
sums and cross products, and the nearest HALF is a prefix of the bins.  So a step moves at most BINS
rows a group, start and task, the estimate covers all rows, and no group is gathered.  Quartiles come
from counts on a fixed grid, so they don't depend on how rows are dealt to tasks.

Estimates are made for all rows, for each language, and for each language and source.  A language's is
drawn towards that of all rows, and a source's towards its language's, as if PRIOR further rows had been
seen there: the fewer rows a group has, the more it borrows.  The rule is the same at every size.

Edge cases: null and blank texts have no words and fail the base rule; null language or source is
a value of its own; constant statistics get the least spread in FEATURES, so a group of equal texts
rejects nothing but what differs from them; a group all of whose rows fail the base rule has no estimate
and rejects nothing more; repeated rows count as often as they occur; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, gram_hashes, mix, seeded, slices, stored, word_spans

HALF = 0.75
STEPS = 5
PRIOR = 200.0  # rows that the wider group's estimate counts as
BINS = 512
GRID = 256  # steps of the quartiles' grid in a unit of a statistic
SALTS = 64
QUANTILE = 0.99999  # of the chi-squared distribution, for the cut-off
MAX_MODELS = 100_000  # models are broadcast up to this many, joined by a shuffle beyond
#: Statistic and its least standard deviation, which keeps near-constant ones from rejecting small changes.
FEATURES = (("log_words", 0.5), ("word_length", 0.35), ("symbols", 0.05), ("upper", 0.08), ("repeats", 0.10), ("dup_lines", 0.15))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8  # words of a repeated window

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BYTE = seeded(31, 256)


def _exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Case-sensitive hashes of byte ranges."""
    from .common import _power

    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _between(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _repeated(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it occurs again in its row, and whether it occurred before."""
    if not len(values):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((np.arange(len(values)), values, row))
    same = (values[order][1:] == values[order][:-1]) & (row[order][1:] == row[order][:-1])
    before, twice = np.zeros(len(values), bool), np.zeros(len(values), bool)
    before[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, before


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and the number of upper-case A-Z and of letters' bytes, for each row."""
    parts: dict[str, list[np.ndarray]] = {}
    for _, _, data, offs in slices(column):
        starts, ends, bounds = word_spans(data, offs)
        rows = np.arange(len(offs) - 1)
        word_row = np.repeat(rows, np.diff(bounds))
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        chars = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
        out = {"n_words": np.diff(bounds), "word_chars": _between(chars, offs), "n_symbols": _between(_SYMBOL[data], offs)}
        out["n_upper"] = _between((data >= 65) & (data <= 90), offs)
        # lines: after each row start and each \n
        breaks = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offs[:-1][offs[:-1] < offs[1:]], breaks + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_row = np.searchsorted(offs, line_starts, "right") - 1
        nxt = np.append(line_starts[1:], len(data))
        line_ends = nxt - ((data[nxt - 1] == 10) & (nxt > line_starts)) if len(data) else nxt
        worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        s, e, r = line_starts[worded], line_ends[worded], line_row[worded]
        _, before = _repeated(_exact_hashes(data, s, e), r)
        out["n_dup_lines"] = np.bincount(r[before], minlength=len(rows))
        hashes = _exact_hashes(data, starts, ends)
        grams = gram_hashes(hashes, WINDOW)
        whole = word_row[: len(grams)] == word_row[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        twice, _ = _repeated(grams[at], word_row[at])
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        out["n_repeat_words"] = _between(np.cumsum(cover[:-1]) > 0, bounds)
        for k, v in out.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(parts[k]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in (*COUNTS, "n_upper")}


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """The transformed statistics, in the order of FEATURES."""
    words = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.stack([
        np.log(words), np.minimum(chars / words, 40), np.sqrt(c["n_symbols"] / chars), np.arcsin(np.sqrt(np.minimum(c["n_upper"] / chars, 1))),
        np.sqrt(c["n_repeat_words"] / words), np.sqrt(c["n_dup_lines"] / (1 + words / 10)),
    ], axis=1)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = text_counts(batch["text"])
        x = vectors(counts)
        cols = [batch["doc_id"], batch["lang"], batch["source"], *(pa.array(counts[k]) for k in COUNTS), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(FEATURES)))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", *COUNTS, *(f"x{i}" for i in range(len(FEATURES)))])


STATS = "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTS) + "".join(f", x{i} double" for i in range(len(FEATURES)))


def statistics(docs: DataFrame) -> DataFrame:
    """(STATS) the counts and the statistic vector of each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(_stats, STATS)


# ---------------------------------------------------------------- chi-squared, by series and bisection


def chi2_cdf(x: float, k: int) -> float:
    a, h = k / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


# ---------------------------------------------------------------- estimates

_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_LEAST = np.diag([s**2 for _, s in FEATURES])
MODEL = "g string, start int, rows long, mean array<double>, scatter array<double>, inverse array<double>"


def _packed(m: np.ndarray) -> list[float]:
    return [float(m[i, j]) for i, j in _PAIRS]


def _square(packed) -> np.ndarray:
    m = np.zeros((_P, _P))
    for x, (i, j) in zip(packed, _PAIRS, strict=True):
        m[i, j] = m[j, i] = x
    return m


def _inverse(scatter: np.ndarray) -> list[float]:
    """The packed inverse of the scatter, whose diagonal has the least spreads added; off the diagonal twice."""
    inverse = np.linalg.inv(scatter + _LEAST)
    return [float(inverse[i, j]) * (1 if i == j else 2) for i, j in _PAIRS]


def _frame(g: str, models: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(MODEL) rows of (start, rows, mean, scatter)."""
    return pd.DataFrame({
        "g": g, "start": [m[0] for m in models], "rows": [m[1] for m in models], "mean": [m[2].tolist() for m in models],
        "scatter": [_packed(m[3]) for m in models], "inverse": [_inverse(m[3]) for m in models]})


_SUMS = ["n", *(f"s{i}" for i in range(_P)), *(f"p{i}_{j}" for i, j in _PAIRS)]


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from rows of _SUMS."""
    total = sums.sum(axis=0)
    mean = total[1 : 1 + _P] / total[0]
    return mean, _square(total[1 + _P :] / total[0]) - np.outer(mean, mean)


def _concentrated(frame: pd.DataFrame, half: float, scale: float) -> pd.DataFrame:
    """The next model of each start of a group from its bins (at most BINS rows each): that of the nearest share."""
    frame = frame.sort_values(["start", "bin"])
    starts, sums, models = frame["start"].to_numpy(), frame[_SUMS].to_numpy(float), []
    for start in np.unique(starts).tolist():
        bins = sums[starts == start]
        n = bins[:, 0]
        mean, scatter = _moments(bins[np.concatenate([[0], np.cumsum(n)[:-1]]) < half * n.sum()])
        models.append((start, int(n.sum()), mean, scatter * scale))
    return _frame(frame["g"].iloc[0], models)


def _least(frame: pd.DataFrame) -> pd.DataFrame:
    """The start whose scatter has the least determinant; the first of equal ones."""
    frame = frame.sort_values("start").reset_index(drop=True)
    size = [np.linalg.slogdet(_square(x) + _LEAST)[1] for x in frame["scatter"]]
    return frame.iloc[[int(np.argmin(np.round(size, 9)))]]


def _reweighted(frame: pd.DataFrame, upto: int, scale: float) -> pd.DataFrame:
    """The model of a group from its rows in bins up to ``upto``, or in its first bin."""
    bins, sums = frame["bin"].to_numpy(), frame[_SUMS].to_numpy(float)
    mean, scatter = _moments(sums[bins <= max(upto, bins.min())])
    return _frame(frame["g"].iloc[0], [(int(frame["start"].iloc[0]), int(sums[:, 0].sum()), mean, scatter * scale)])


def _quartiles(frame: pd.DataFrame) -> pd.DataFrame:
    """Medians and quartile ranges of a group from its counts on the grid."""
    middle, spread = np.zeros(_P), np.zeros(_P)
    rows = frame.sort_values(["f", "at"])[["f", "at", "n"]].to_numpy(float)
    for f in range(_P):
        _, at, n = rows[rows[:, 0] == f].T
        upto = np.cumsum(n)
        at = at[np.minimum(np.searchsorted(upto, np.array([0.25, 0.5, 0.75]) * upto[-1]), len(upto) - 1)] / GRID
        middle[f], spread[f] = at[1], (at[2] - at[0]) / 1.349
    return _frame(frame["g"].iloc[0], [(0, 0, middle, np.diag(spread**2))])


def _signs(frame: pd.DataFrame) -> pd.DataFrame:
    """Three starts of a group from the sums of all its rows and of its rows' spatial signs; ``mean`` and ``scatter`` are the quartile start's."""
    row = frame.iloc[0]
    middle, spread = np.array(row["mean"]), np.sqrt(np.diag(_square(row["scatter"]) + _LEAST))
    mean, whole = _moments(frame[_SUMS].to_numpy(float))
    sign = _square([row[f"q{i}_{j}"] / row["n"] for i, j in _PAIRS]) * _P  # the trace of a sign matrix is one
    return _frame(row["g"], [(0, int(row["n"]), middle, _square(row["scatter"])), (1, int(row["n"]), mean, whole), (2, int(row["n"]), middle, sign * np.outer(spread, spread))])


def distance() -> Column:
    """Squared Mahalanobis distance of (x0, ...) under the joined model (mean, inverse)."""
    d = [F.col(f"x{i}") - F.col("mean")[i] for i in range(_P)]
    out = F.lit(0.0)
    for n, (i, j) in enumerate(_PAIRS):
        out = out + F.col("inverse")[n] * d[i] * d[j]
    return out


def distance_bin(d2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(16 * F.log2(d2 + 1e-4) + 220))).cast("int")


def bin_of(d2: float) -> int:
    return max(0, min(BINS - 1, math.floor(16 * math.log2(d2 + 1e-4) + 220)))


def _joined(rows: DataFrame, models: DataFrame, how: str, *columns: str) -> DataFrame:
    """``rows`` with the models of their group ``g``.  Many models are dealt under salts, as one group may hold a third of all rows."""
    models = models.select("g", *columns)
    if models.count() <= MAX_MODELS:
        return rows.join(F.broadcast(models), "g", how)
    salted = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("x0", "x1", "x4"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"], how).drop("salt")


def group_names(lang: Column, source: Column) -> list[Column]:
    """The groups of a row, from the widest: all rows, its language, its language and source."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return [F.lit(""), name(lang), F.concat_ws("\x1f", name(lang), name(source))]


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(_P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in _PAIRS)]


def _binned(rows: DataFrame, models: DataFrame) -> DataFrame:
    """The sums of each distance bin under each model of a row's group."""
    return _joined(rows, models, "inner", "start", "mean", "inverse").withColumn("bin", distance_bin(distance())).groupBy("g", "start", "bin").agg(*_sums())


def _starts(rows: DataFrame) -> DataFrame:
    grid = rows.select("g", F.posexplode(F.array(*(F.round(F.col(f"x{i}") * GRID).cast("int") for i in range(_P)))).alias("f", "at")).groupBy("g", "f", "at").agg(F.count("*").alias("n"))
    middle = stored(grid.groupBy("g").applyInPandas(_quartiles, MODEL), "models")
    at = _joined(rows, middle, "inner", "mean", "scatter")
    spread = [F.sqrt(F.col("scatter")[_PAIRS.index((i, i))] + F.lit(float(_LEAST[i, i]))) for i in range(_P)]
    at = at.select("*", *(((F.col(f"x{i}") - F.col("mean")[i]) / spread[i]).alias(f"z{i}") for i in range(_P)))
    norm = F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(_P)), F.lit(0.0)), F.lit(1e-12))
    signs = [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / norm).alias(f"q{i}_{j}") for i, j in _PAIRS]
    sums = at.groupBy("g").agg(*_sums(), *signs, F.first("mean").alias("mean"), F.first("scatter").alias("scatter"))
    models = stored(sums.groupBy("g").applyInPandas(_signs, MODEL), "models")
    drop_stored(middle)
    return models


def concentrated(rows: DataFrame, half: float = HALF, steps: int = STEPS) -> DataFrame:
    """(MODEL) for each group of ``rows`` (g, x0, ...) the mean and scatter of the HALF with the least determinant that the starts lead to."""
    scale = half / chi2_cdf(chi2_quantile(half, _P), _P + 2)  # makes the nearest part's scatter that of all
    models = _starts(rows)
    for step in range(steps):
        after = _binned(rows, models).groupBy("g").applyInPandas(partial(_concentrated, half=half, scale=scale), MODEL)
        after = stored(after.groupBy("g").applyInPandas(_least, MODEL) if step == steps - 1 else after, "models")
        drop_stored(models)
        models = after
    return models


def fit(rows: DataFrame, half: float = HALF, steps: int = STEPS) -> DataFrame:
    """(MODEL) the reweighted estimate of each group of ``rows`` (g, x0, ...)."""
    rest = 0.975
    scale = rest / chi2_cdf(chi2_quantile(rest, _P), _P + 2)
    models = concentrated(rows, half, steps)
    final = stored(_binned(rows, models).groupBy("g").applyInPandas(partial(_reweighted, upto=bin_of(chi2_quantile(rest, _P)), scale=scale), MODEL), "models")
    drop_stored(models)
    return final


def _drawn(rows: int, mean: np.ndarray, scatter: np.ndarray, wide_mean: np.ndarray, wide_scatter: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """A group's mean and scatter as if ``prior`` rows of the wider group had been seen in it."""
    a = rows / (rows + prior)
    gap = wide_mean - mean
    return a * mean + (1 - a) * wide_mean, a * scatter + (1 - a) * wide_scatter + a * (1 - a) * np.outer(gap, gap)


def _drawn_frames(frames: Iterator[pd.DataFrame], prior: float) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples():
            models = [(n, np.array(m), _square(s)) for n, m, s in ((r.rows0, r.mean0, r.scatter0), (r.rows1, r.mean1, r.scatter1), (r.rows2, r.mean2, r.scatter2))]
            mean, scatter = models[0][1:]
            for n, m, s in models[1:]:
                mean, scatter = _drawn(n, m, s, mean, scatter, prior)
            out.append(_frame(r.g, [(0, models[2][0], mean, scatter)]))
        yield pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in MODEL.split(", ")})


def drawn(models: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(MODEL) the estimate of each language and source, drawn towards its language's and that towards all rows'."""
    sep = "\x1f"
    narrow = models.where(F.contains("g", F.lit(sep))).select("g", F.substring_index("g", sep, 1).alias("k"), *(F.col(c).alias(f"{c}2") for c in ("rows", "mean", "scatter")))
    of_lang = models.where((F.col("g") != "") & ~F.contains("g", F.lit(sep))).select(F.col("g").alias("k"), *(F.col(c).alias(f"{c}1") for c in ("rows", "mean", "scatter")))
    of_all = models.where("g = ''").select(*(F.col(c).alias(f"{c}0") for c in ("rows", "mean", "scatter")))
    return narrow.join(of_lang, "k").crossJoin(F.broadcast(of_all)).mapInPandas(partial(_drawn_frames, prior=prior), MODEL)  # one row


def assessed(docs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, distance) of each row of ``docs``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stored(statistics(docs).withColumn("base_failed", base), "stats")
    names = group_names(F.col("lang"), F.col("source"))
    every = stats.where("not base_failed").select(F.explode(F.array(*names)).alias("g"), *(f"x{i}" for i in range(_P)))
    wide = fit(every)
    models = stored(drawn(wide), "models")
    drop_stored(wide)
    out = _joined(stats.withColumn("g", names[-1]), models, "left", "mean", "inverse").withColumn("distance", distance())
    fine = F.coalesce(F.col("distance") <= chi2_quantile(quantile, _P), F.lit(True))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & fine).alias("kept"), "distance")
