"""Document fingerprints by consistent weighted sampling.

A document's terms are its words with A-Z lower-cased, their weights how often they occur. For every sample k a term has
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), drawn from its hash; with weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r. The sample is the term and t of the least a; two documents share it with a probability of
their generalised Jaccard similarity, sum of least weights over sum of greatest. As a tells term and t, the fingerprint
keeps 16 mixed bits of ln a itself: two different samples are taken for equal once in 65,536.

The 64 bits of one hash of term and sample are four places in tables: two exponential values that add up to r, a quantile
of ln c, and b. The tables hold multiples of 2**-20, and from there on values are added, multiplied and divided alone, which
gives the same bits on every machine; no logarithm is taken of a draw.

A batch's texts, a document and its edited text among them, share the draws of their terms. These are made for TERMS
distinct terms at a time, and each text's least values so far are combined with them, so a text of any number of words
takes bounded memory beyond its distinct words. Words are counted in slices of a text, cut between words.

Neighbours (each document and the next by ascending id, the first after the last) are found without a global sort task:
rows are cut into blocks at approximate quantiles of their ids, and, within an id (or none) that many rows share, of the
first bytes of their texts; the first document of a block is sent to the block before it too.

Defined cases: a null text is as an empty one, without terms; its samples are those of infinity, so two such are alike
(1.0) and no other is like them (0.0, but for chance). A null id comes before all others; rows of one id are in the order
of their texts, equal rows follow one another. A text without a break is one word, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, raw_strings, stash, tune
from .words import is_separator, mix, split, word_hashes

SAMPLES = 128
#: Text bytes whose words share draws.
BATCH_BYTES = 4 << 20
#: Bytes of a text whose words are counted at once.
SLICE_BYTES = 12 << 20
#: Distinct terms whose draws are held at once.
TERMS = 1 << 15
#: Rows of a block of neighbours, about, and bytes of a text that tell rows of one id apart.
BLOCK_ROWS, PREFIX = 512, 7
_LEAST = -(1 << 63)

_GRAIN = float(1 << 20)


def _grains(x: np.ndarray) -> np.ndarray:
    return (np.round(x * _GRAIN) / _GRAIN).astype(np.float32)


def _gamma_quantiles(u: np.ndarray) -> np.ndarray:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros_like(u), np.full_like(u, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = -np.expm1(-x) - x * np.exp(-x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


_u = (np.arange(1 << 16) + 0.5) / (1 << 16)
_exponential = _grains(-np.log(_u))
_log_gamma = _grains(np.log(_gamma_quantiles(_u)))
_one_less_b = (1 - _u).astype(np.float32)


class Draws:
    """ln a of terms (hashes) at their weights, sample by sample."""

    def __init__(self, term: np.ndarray, weight: np.ndarray):
        self.term, self.often = term, np.flatnonzero(weight > 1)
        self.log_weight = _grains(np.log(weight[self.often].astype(np.float64)))

    def sample(self, k: int) -> np.ndarray:
        places = mix(self.term + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        r = _exponential[places & 0xFFFF]
        r += _exponential[places >> 16 & 0xFFFF]
        rest = _one_less_b[places >> 32 & 0xFFFF]
        value = _log_gamma[places >> 48 & 0xFFFF]
        value -= r * rest  # t is 0 at weight 1
        if len(self.often):
            rate, b = r[self.often], 1 - rest[self.often]
            value[self.often] -= rate * np.floor(self.log_weight / rate + b)
        return value


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts of SLICE_BYTES together at most, or parts of one, cut before a separator; and the number of the first."""
    data, off = raw_strings(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        if off[to] - off[at] <= SLICE_BYTES:
            yield at, texts.slice(at, to - at)
        else:
            whole, begin = data[off[at] : off[to]], 0
            while begin < len(whole):
                end = begin + SLICE_BYTES
                while end < len(whole):  # to the next separator
                    found = np.flatnonzero(is_separator(whole[end : end + 4096]))
                    if len(found):
                        end += int(found[0])
                        break
                    end += 4096
                yield at, pa.array([whole[begin:end].tobytes()], pa.large_binary())
                begin = end
        at = to


def _counted(owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of owner and term as one with the sum of their counts."""
    order = np.lexsort((owner, term))
    owner, term = owner[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], term[first], np.add.reduceat(count[order], first) if len(first) else count


def weights(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term's hash and weight, in the order of hashes and weights."""
    parts = []
    for first, part in _slices(texts):
        words = split(part)
        owner = np.repeat(np.arange(first, first + len(part), dtype=np.int32), words.counts)
        parts.append(_counted(owner, word_hashes(words, lower=True), np.ones(len(owner), np.int64)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, term, count = parts[0] if len(parts) == 1 else _counted(*(np.concatenate(c) for c in zip(*parts)))
    order = np.lexsort((count, term))
    return owner[order], term[order], count[order]


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each text."""
    out = np.full((samples, len(texts)), np.inf, np.float32)
    owner, term, weight = weights(texts)
    new = np.concatenate([[True], (term[1:] != term[:-1]) | (weight[1:] != weight[:-1])]) if len(term) else np.zeros(0, bool)
    first = np.append(np.flatnonzero(new), len(term))
    which = np.cumsum(new) - 1
    for a in range(0, len(first) - 1, TERMS):
        z = min(a + TERMS, len(first) - 1)
        begin, end = first[a], first[z]
        drawn = Draws(term[first[a:z]], weight[first[a:z]])
        order = np.argsort(owner[begin:end], kind="stable") + begin
        mine, of = which[order] - a, owner[order]
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        of = of[cuts]
        for k in range(samples):
            least = np.minimum.reduceat(drawn.sample(k)[mine], cuts)
            out[k, of] = np.minimum(out[k, of], least)
    return _samples(np.ascontiguousarray(out.T))


def _samples(least: np.ndarray) -> np.ndarray:
    return (mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def text_form(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1, dtype=np.float64)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """df with the fingerprint of its texts in hexadecimal, four digits a sample."""
    tune(df.sparkSession)
    kept = df.select(*[c for c in df.columns if c.lower() != out.lower()])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, text, BATCH_BYTES):
            got = [text_form(s) for s in signatures(rows.column(text), samples)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.string())], [*rows.schema.names, out])

    return kept.mapInArrow(run, schema)


class Edges:
    """Where blocks of rows begin: pairs of id and prefix, ascending."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.ids, self.prefixes = np.array(pairs, np.int64).reshape(-1, 2).T.copy()

    def block(self, order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, order, "left"), np.searchsorted(self.ids, order, "right")
        for a in np.unique(low[low < high]).tolist():
            mine = (low == a) & (high > a)
            low[mine] += np.searchsorted(self.prefixes[a : high[mine][0]], prefix[mine], "right")
        return low.astype(np.int32)


def _edges(rows: DataFrame, blocks: int) -> Edges:
    """For some so many blocks. rows: _order, _prefix. An id that several quantiles fall on is cut by its rows' prefixes."""
    cuts = rows.stat.approxQuantile("_order", [i / blocks for i in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    ids, counts = np.unique(np.array(cuts, np.float64).astype(np.int64), return_counts=True)
    pairs = {(i, _LEAST) for i in ids.tolist()}
    for parts in sorted({1 << int(n).bit_length() for n in counts if n > 1}):
        hot = ids[[n > 1 and 1 << int(n).bit_length() == parts for n in counts.tolist()]].tolist()
        quantiles = F.percentile_approx("_prefix", [k / parts for k in range(1, parts)], 100 * parts)
        for r in rows.filter(F.col("_order").isin(hot)).groupBy("_order").agg(quantiles).collect():
            pairs |= {(r[0], p) for p in r[1]}
    return Edges(sorted(pairs))


def with_next(df: DataFrame, key: str, text: str, most_blocks: int = 10_000) -> DataFrame:
    """Rows key, text, _block, _guest, dealt by _block and sorted so that a row's next one in its block is the next by key.
    The last rows of a block are guests (_guest = 1): the first row of the next block; after the last block, of the first.
    The driver holds some most_blocks ids."""
    spark = df.sparkSession
    prefix = F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(text), "UTF-8"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("long")
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("_order"), F.coalesce(prefix, F.lit(-1)).alias("_prefix"), F.col(text).alias(text))
    # written, as ids are looked at several times, and short next to their texts
    slim = stash(rows.select("_order", "_prefix"), "order")
    edges = _edges(slim, max(1, min(most_blocks, slim.count() // BLOCK_ROWS)))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, prefix = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(edges.block(order, prefix))], ["_order", "_prefix", "_block"])

    ids = slim.mapInArrow(numbered, "_order long, _prefix long, _block int")
    firsts = sorted((r[0], r[1]) for r in ids.groupBy("_block").agg(F.min("_order")).collect())
    cut_ids = [int(i) for i, n in zip(*np.unique(edges.ids, return_counts=True)) if n > 1]
    within = {(r[0], r[1]): r[2] for r in ids.filter(F.col("_order").isin(cut_ids)).groupBy("_block", "_order").agg(F.min("_prefix")).collect()} if cut_ids else {}
    hosts: dict[tuple[int, int | None], int] = {}  # first id of a block, and its first prefix if the id is cut: the block before
    for k, (block, order) in enumerate(firsts):
        hosts[order, within.get((block, order))] = firsts[k - 1][0]
    head_ids, cut = np.unique(np.array([order for order, _ in hosts], np.int64)), set(cut_ids)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, prefix = b.column(0).to_numpy(), b.column(1).to_numpy()
            block = edges.block(order, prefix)
            own = [b.column(0), b.column(2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(block), pa.array(np.zeros(len(order), np.int32))], names)
            best: dict[int, tuple[bool, bytes, int]] = {}  # of the rows that may be a block's first, the batch's first
            for i in np.flatnonzero(np.isin(order, head_ids)).tolist():
                host = hosts.get((int(order[i]), int(prefix[i]) if order[i] in cut else None))
                if host is not None:
                    t = b.column(2)[i].as_py()
                    row = (t is not None, (t or "").encode(), i)
                    best[host] = min(best.get(host, row), row)
            if best:
                at = [x[2] for x in best.values()]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in own), pa.array(list(best), pa.int32()), pa.array(np.ones(len(at), np.int32))], names)

    names = ["_order", text, "_block", "_guest"]
    both = rows.mapInArrow(dealt, f"_order long, `{text}` string, _block int, _guest int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "_block").sortWithinPartitions("_block", "_guest", "_order", text)


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """For each row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The edited
    text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document."""
    tune(df.sparkSession)
    ordered = with_next(df, key, text)
    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def made(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        """All but the last, which is the next of the one before."""
        own, n = texts[:-1], [len(t) for t in texts[:-1]]
        edited = [t[: k - k // 2] + after[: k // 2] for t, k, after in zip(own, n, texts[1:])]
        both = signatures(pa.array([*texts, *edited], pa.large_string()), samples)
        sig, sig2 = both[: len(texts)], both[len(texts) :]
        yield from pa.table(
            {
                key: pa.array([None if i == _LEAST else i for i in ids[:-1]], pa.int64()),
                "n_chars": pa.array(n, pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [text_form(s) for s in sig[:-1]],
                "edited_fingerprint": [text_form(s) for s in sig2],
                "near_edited": likeness(sig[:-1], sig2),
                "near_next": likeness(sig[:-1], sig[1:]),
            }
        ).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[int], list[str]] = ([], [])
        block, over, size = None, False, 0
        for rows in batches:
            for i, t, k, guest in zip(*(rows.column(c).to_pylist() for c in ("_order", text, "_block", "_guest"))):
                if k != block:
                    held, block, over, size = ([], []), k, False, 0
                if over:
                    continue  # a guest after the first
                held[0].append(i)
                held[1].append(t or "")
                size += len(held[1][-1])
                if guest:
                    over = True
                if over or size > BATCH_BYTES and len(held[0]) > 1:
                    yield from made(*held)
                    held, size = (held[0][-1:], held[1][-1:]), len(held[1][-1])

    return ordered.mapInArrow(run, schema)
