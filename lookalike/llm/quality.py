"""Quality classifier: random Fourier features, ridge regression by partition-summed normal equations, isotonic
calibration.

Statistics of a whole text (lengths, shares of kinds of bytes, repeated words and word sequences, and the like) are
standardised and mapped to cosines whose inner products approximate a Gaussian kernel. Each partition of the labelled rows
sums its part of the normal equations; the sums are added in a tree of fixed fan-in, so the driver gets a few matrices at
any size. Two halves of the labelled rows are fitted apart, each scores the other, and the pool-adjacent-violators fit on
a histogram of these scores calibrates the model of both halves. Within a flat part of that fit the raw score still orders.

Defined cases: a null or empty text has the statistics of an empty one and a score; null labels and ids are not learnt
from, repeated labels of an id count as their mean; with no label, or one class only, the score is the share of label 1
(0.5 without labels).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, stash, tune
from .words import split, window_hashes, word_hashes

FEATURES = 384
RIDGE = 1e-3
BINS = 4096
FAN_IN = 16
BATCH_BYTES = 1 << 20

STATISTICS = ("bytes", "words", "word_length", "upper", "symbols", "exclaims", "bars", "digits", "beyond_ascii", "lines", "stops", "doubled_symbols", "distinct_words", "stutters", "repeated_shingles", "long_words", "symbol_words", "upper_words")

_byte = np.arange(256)
_is_upper = (_byte >= 65) & (_byte <= 90)
_is_lower = (_byte >= 97) & (_byte <= 122)
_is_digit = (_byte >= 48) & (_byte <= 57)
_is_symbol = (_byte > 32) & (_byte < 127) & ~_is_upper & ~_is_lower & ~_is_digit & ~np.isin(_byte, [ord(c) for c in ".,;:'\"-()?!"])


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of mask between offsets, 0 where two offsets are equal."""
    out = np.zeros(len(offsets) - 1, np.float64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(mask, offsets[some], dtype=np.int64)
    return out


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each owner has."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    w = split(texts)
    n = len(texts)
    data, off = w.data, w.offsets
    size, count = np.diff(off).astype(np.float64), w.counts.astype(np.float64)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    lut = lambda kind: kind[data]
    upper, symbol = lut(_is_upper), lut(_is_symbol)
    twice = np.zeros(len(data), bool)
    twice[1:] = (symbol[1:] | (data[1:] == 33)) & (data[1:] == data[:-1])
    length = w.end - w.start
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    within = np.concatenate([[0], np.cumsum(symbol)])
    lows = np.concatenate([[0], np.cumsum(lut(_is_lower | (_byte >= 128)))])
    caps = np.concatenate([[0], np.cumsum(upper)])
    has_symbol = within[w.end] > within[w.start]
    all_caps = (caps[w.end] > caps[w.start]) & (lows[w.end] == lows[w.start])
    hashes = word_hashes(w, lower=True)
    owner = np.repeat(np.arange(n), w.counts)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    windows = window_hashes(hashes, 4)
    inside = owner[: len(windows)] == owner[3:] if len(windows) else np.zeros(0, bool)
    shingles = np.bincount(owner[: len(windows)][inside], minlength=n)
    different = _distinct(windows[inside], owner[: len(windows)][inside], n)
    first = w.first
    share = lambda mask, per: np.sqrt(_sums(mask, off if len(mask) == len(data) and per is per_byte else first) * per)
    rows = [
        np.log1p(size),
        np.log1p(count),
        np.minimum(_sums(length, first) * per_word, 40),
        share(upper, per_byte),
        share(symbol, per_byte),
        share(data == 33, per_byte),
        share(data == 124, per_byte),
        share(lut(_is_digit), per_byte),
        share(data >= 128, per_byte),
        share(data == 10, per_byte),
        share(np.isin(last, [46, 33, 63]), per_word),
        share(twice, per_byte),
        np.log1p(_distinct(hashes, owner, n)) / np.maximum(np.log1p(count), 1),
        share(same, per_word),
        np.sqrt(1 - different / np.maximum(shingles, 1)) * (shingles > 0),
        share(length > 20, per_word),
        share(has_symbol, per_word),
        share(all_caps, per_word),
    ]
    return np.stack(rows, axis=1)


@dataclass
class Model:
    """prior alone where nothing could be fitted."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    seed: int = 7
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def phi(self, x: np.ndarray) -> np.ndarray:
        """The random features and a constant."""
        rng = np.random.default_rng(self.seed)
        d = x.shape[1]
        w = rng.standard_normal((d, FEATURES)) / np.sqrt(d)
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        raw = np.nan_to_num(self.phi(x) @ self.weights)
        calibrated = np.interp(raw, self.knots, self.levels)
        return np.clip(0.998 * calibrated + 0.002 / (1 + np.exp(-4 * np.clip(raw - 0.5, -50, 50))), 0, 1)


def featurize(df: DataFrame, text: str = "text", out: str = "_statistics") -> DataFrame:
    """df without its text, with the statistics as an array of doubles."""
    tune(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c != out])
    names = [c for c in kept.columns if c != text]
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != text), T.StructField(out, T.ArrayType(T.DoubleType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, text, BATCH_BYTES):
            x = statistics(rows.column(text))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), flat], [*names, out])

    return kept.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _packed(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as x:
        return [x[k] for k in sorted(x.files)]


def _tree_sum(parts: DataFrame) -> list[np.ndarray] | None:
    """Sum of the packed arrays of all rows of the column `part`, FAN_IN at a time; the driver gets FAN_IN at most."""
    parts = stash(parts, "equations")  # a row per task that read labelled rows

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in batches:
            for data in rows.column(0):
                got = _unpacked(data.as_py())
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["part"])

    left = parts.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(add, "part binary")
    total = None
    for row in parts.collect():
        got = _unpacked(bytes(row[0]))
        total = got if total is None else [a + b for a, b in zip(total, got)]
    return total


def _ridge(a: np.ndarray, b: np.ndarray, n: float) -> np.ndarray:
    penalty = np.full(len(b), RIDGE * max(n, 1) / FEATURES)
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def _isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the level of each bin."""
    stack: list[list[float]] = []
    for i in range(len(total)):
        stack.append([positive[i], total[i], 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            p, t, k = stack.pop()
            stack[-1] = [stack[-1][0] + p, stack[-1][1] + t, stack[-1][2] + k]
    return np.concatenate([np.full(int(k), p / t) for p, t, k in stack])


def fit(rows: DataFrame, label: str = "label", half: str = "half", statistics: str = "_statistics") -> Model:
    """rows: statistics, a label from 0 to 1, and half (boolean), which says what half a row belongs to."""
    rows = rows.filter(F.col(label).isNotNull()).select(F.col(statistics).alias("x"), F.col(label).cast("double").alias("y"), F.coalesce(F.col(half), F.lit(False)).alias("h"))
    rows = stash(rows, "labelled", few=True)  # read three times; statistics alone
    n = len(STATISTICS)
    sums = rows.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y"), *[f(F.col("x")[i]) for i in range(n) for f in (F.avg, F.stddev_pop)]).first()
    if not sums[0]:
        return Model(0.5)
    if sums[2] == sums[3]:
        return Model(float(sums[1]))
    mean, scale = np.array(sums[4::2], float), np.maximum(np.array(sums[5::2], float), 1e-3)
    base = Model(float(sums[1]), mean, scale)
    d = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, d, d)), np.zeros((2, d)), np.zeros(2)]
        for batch in batches:
            if not batch.num_rows:
                continue
            phi, y = base.phi(_matrix(batch.column("x"))), batch.column("y").to_numpy()
            second = batch.column("h").to_numpy(zero_copy_only=False)
            for k, mine in enumerate((~second, second)):
                total[0][k] += phi[mine].T @ phi[mine]
                total[1][k] += phi[mine].T @ y[mine]
                total[2][k] += mine.sum()
        if total[2].any():
            yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["part"])

    a, b, count = _tree_sum(rows.mapInArrow(equations, "part binary"))
    weights = _ridge(a.sum(0), b.sum(0), count.sum())
    halves = [_ridge(a[k], b[k], count[k]) if count[k] else weights for k in (0, 1)]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, positive = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            if not batch.num_rows:
                continue
            phi, y = base.phi(_matrix(batch.column("x"))), batch.column("y").to_numpy()
            second = batch.column("h").to_numpy(zero_copy_only=False)
            raw = np.where(second, phi @ halves[0], phi @ halves[1])
            at = np.clip((np.nan_to_num(raw) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            total += np.bincount(at, minlength=BINS)
            positive += np.bincount(at, y, minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(positive[some])], ["bin", "n", "p"])

    found = rows.mapInArrow(bins, "bin long, n long, p double").groupBy("bin").agg(F.sum("n"), F.sum("p")).collect()
    found = np.array(sorted((r[0], r[1], r[2]) for r in found), float)
    knots = (found[:, 0] + 0.5) / BINS * 2 - 0.5
    base.weights, base.knots, base.levels = weights, knots, _isotonic(found[:, 2], found[:, 1])
    return base


def score_statistics(df: DataFrame, model: Model, statistics: str = "_statistics", out: str = "score") -> DataFrame:
    """df with the score instead of its statistics."""
    names = [c for c in df.columns if c not in (statistics, out)]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            got = pa.array(model.score(_matrix(rows.column(statistics))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), got], [*names, out])

    return df.select(*names, statistics).mapInArrow(run, schema)


def score_texts(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df, its text kept, with the score."""
    tune(df.sparkSession)
    names = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, text, BATCH_BYTES):
            got = pa.array(model.score(statistics(rows.column(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), got], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 3: rows of 1 are held out, 0 and 2 are the halves that are learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def learn_from(known: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", statistics: str = "_statistics") -> Model:
    """The model from the labelled rows that are not held out. known: key and statistics, written down."""
    truth = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_of")).agg(F.avg(F.col(label)).alias("_label"))
    rows = known.filter(fold(key) != 1).join(truth, F.col(key).cast("long") == F.col("_of"))
    return fit(rows.select(F.col(statistics).alias("_statistics"), "_label", (fold(key) == 2).alias("_half")), "_label", "_half")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Model, DataFrame]:
    """The model from the labelled rows that are not held out, and key and statistics of all rows, written once."""
    known = stash(featurize(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text")), "_text"), "statistics")
    return learn_from(known, labels, key, label), known
