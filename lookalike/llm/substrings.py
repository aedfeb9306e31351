"""Substring dedup: word windows that also start in a document with a smaller id.

Levels double a length, from SHORTEST words or a little more up to that of the window: 25 and 50 for 50 words; 25, 50, 100
and 200 for 200. At a level only those stretches are compared that are the least (by hash) of all of that length within some
full window: equal full windows choose alike, so none is lost, and of 25 words within 50 one in 14 is left. Windows repeated
at one length alone are extended to twice it: a full window stays a candidate if the stretch it has chosen occurs in two
documents. The loop ends when no candidates survive, or at the full length, where the candidates themselves are compared.

Of each hash the least and the greatest id are combined before they are shuffled, and rows are joined with the hashes of
several ids as plain scans, which adaptive execution can split: no rows of a hash are gathered. Among the texts that a task
reads together, a hash of several ids is decided at once, and one row without words stands for it. Exact copies of a
text are decided by its digest and have no windows. Texts are shuffled once a level to meet their candidates, and those with
candidates once more to meet the decisions.

A hash is 64 bits of the words, at full length 31 more, so that unequal windows do not meet. Rows are told apart by id and
64 bits of their text: rows of one id, or of none, with different texts have nothing in common.

Defined cases: null and empty texts have no words; a null id counts as the greatest; rows of one id, or of none, don't
remove each other's words; equal rows fare alike; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, gathered, stash, tune
from .words import Words, mix, split, window_hashes, word_hashes

LENGTH = 50
#: Words of the first level are at least so many, if the window has twice as many.
SHORTEST = 25
#: Text bytes whose rows are combined before they are shuffled.
BATCH_BYTES = 4 << 20
_LAST = (1 << 63) - 1


def _argmin(values: np.ndarray, k: int) -> np.ndarray:
    """Place of the first least of each k values that follow one another."""
    n = len(values) - k + 1
    out = np.empty(max(0, n), np.int64)
    for at in range(0, len(out), 1 << 15):
        part = sliding_window_view(values[at : at + (1 << 15) + k - 1], k)
        out[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    return out


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths of the levels, each some twice the one before; the last is that of the window."""
    out = [length]
    while out[0] >= 2 * shortest or len(out) == 1:
        out.insert(0, -(-out[0] // 2))
    return out


def choices(words: Words, hashes: np.ndarray, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All full windows of a batch: first word, document, first word of the chosen stretch of `part` words; and the hashes
    of these stretches by first word."""
    parts = window_hashes(hashes, part)
    count = words.counts
    per = np.maximum(count - length + 1, 0)
    owner = np.repeat(np.arange(len(per)), per)
    begin = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(words.first[:-1], per)
    least = _argmin(parts, length - part + 1)
    return begin, owner, least[begin] if len(begin) else begin, parts


def _seen_words(words: Words, seen: pa.Array, some: np.ndarray) -> np.ndarray:
    """Which words of a batch a list of places has; lists of texts that are not in `some` are left out."""
    has = np.zeros(len(words.start) + 1, bool)
    doc = np.repeat(np.arange(len(seen)), np.asarray(seen.value_lengths().fill_null(0)))
    at = np.asarray(seen.flatten())
    mine = some[doc] & (at < words.counts[doc])
    has[at[mine] + words.first[doc[mine]]] = True
    return has


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _text, and _tk, which tells texts of one id apart."""
    tk = F.xxhash64(F.col(text))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_id"), tk.alias("_tk"), F.col(text).alias("_text"))


def _anchors(rows: DataFrame, length: int, part: int, before: int | None) -> DataFrame:
    """Chosen stretches of `part` words: _h, _id, _tk, _at (words at which they begin), _done; of all full windows, or (rows
    have _seen, of the level of `before` words) of those that are candidates still. Where several ids of a batch have one,
    its rows are done and one more without words stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, "_text", BATCH_BYTES):
            rows = rows.combine_chunks()
            words = split(rows.column("_text"))
            ids, tks = rows.column("_id").to_numpy(), rows.column("_tk").to_numpy()
            hashes = word_hashes(words)
            begin, owner, chosen, parts = choices(words, hashes, length, part)
            if before is not None:
                has = _seen_words(words, rows.column("_seen").combine_chunks(), np.ones(len(ids), bool))
                mine = has[choices(words, hashes, length, before)[2]]
                owner, chosen = owner[mine], chosen[mine]
            if not len(chosen):
                continue
            new = np.ones(len(chosen), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
            owner, chosen = owner[new], chosen[new]
            h, of, tk, at = parts[chosen], ids[owner], tks[owner], (chosen - words.first[owner]).astype(np.int32)
            order = np.lexsort((tk, of, h))
            h, of, tk, at = h[order], of[order], tk[order], at[order]
            begin_row = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]) | (tk[1:] != tk[:-1])]))
            offsets = np.append(begin_row, len(at))
            h, of, tk = h[begin_row], of[begin_row], tk[begin_row]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            last = np.append(first[1:], len(h)) - 1
            several = of[first] != of[last]
            done = np.repeat(several, last - first + 1)
            least, most = first[several], last[several]
            alone = np.full(2 * len(least), len(at))
            out = [
                pa.array(_signed(np.concatenate([h, h[least], h[least]]))),
                pa.array(np.concatenate([of, of[least], of[most]])),
                pa.array(np.concatenate([tk, tk[least], tk[most]])),
                pa.ListArray.from_arrays(pa.array(np.concatenate([offsets, alone]), pa.int32()), pa.array(at)),
                pa.array(np.concatenate([done, np.zeros(len(alone), bool)])),
            ]
            yield pa.RecordBatch.from_arrays(out, ["_h", "_id", "_tk", "_at", "_done"])

    columns = ["_id", "_tk", "_text"] + (["_seen"] if before is not None else [])
    return rows.select(*columns).mapInArrow(run, "_h long, _id long, _tk long, _at array<int>, _done boolean")


def _joined(data: bytes, words: Words, doc: int, keep: np.ndarray) -> bytes:
    """Kept words of a document with one space between them."""
    a, b = words.first[doc], words.first[doc + 1]
    return b" ".join([data[s:e] for s, e in zip(words.start[a:b][keep].tolist(), words.end[a:b][keep].tolist())])


def _cut(data: bytes, words: Words, doc: int, keep: np.ndarray) -> bytes:
    """The text without its removed words and the space that follows them."""
    if keep.all():
        return data[words.offsets[doc] : words.offsets[doc + 1]]
    a, b = words.first[doc], words.first[doc + 1]
    start = words.start[a:b]
    stop = np.append(start[1:], words.offsets[doc + 1])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    return b"".join(data[start[i] : stop[j - 1]] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist())).rstrip(b" \t\n\v\f\r")


_OPEN = "_id long, _tk long, _n long, _removed long, _kept binary, _text string, _covered array<int>, _h array<long>, _g array<int>, _at array<array<int>>"


def _candidates(rows: DataFrame, length: int, before: int, finish) -> DataFrame:
    """rows: _id, _tk, _text, _copy, _seen (words at which a chosen stretch of `before` words that others have begins). A document
    without candidates is finished; of others the windows that need a look at other tasks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, "_text", BATCH_BYTES):
            part = part.combine_chunks()
            words = split(part.column("_text"))
            data = words.data.tobytes()
            ids = part.column("_id").to_numpy()
            n = words.counts
            copy = part.column("_copy").to_numpy(zero_copy_only=False)
            has = _seen_words(words, part.column("_seen").combine_chunks(), ~copy)
            hashes = word_hashes(words)
            begin, owner, chosen, _ = choices(words, hashes, length, before)
            mine = has[chosen] if len(chosen) else np.zeros(0, bool)
            begin, owner = begin[mine], owner[mine]
            full = window_hashes(hashes, length)
            h = full[begin] if len(begin) else np.zeros(0, np.uint64)
            g = (window_hashes(hashes, length, second=True)[begin] >> np.uint64(33)).astype(np.int32) if len(begin) else np.zeros(0, np.int32)
            of = ids[owner]
            order = np.lexsort((of, g, h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            least = of[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else of
            covered = np.zeros(len(order), bool)
            covered[order] = of[order] > least
            within = (begin - words.first[owner]).astype(np.int32)
            bounds = np.searchsorted(owner, np.arange(len(n) + 1))
            rest = np.flatnonzero(~covered)  # a row per window and document
            rest = rest[np.lexsort((within[rest], g[rest], h[rest], owner[rest]))]
            new = np.ones(len(rest), bool)
            new[1:] = (owner[rest][1:] != owner[rest][:-1]) | (h[rest][1:] != h[rest][:-1]) | (g[rest][1:] != g[rest][:-1])
            row = rest[new]
            per_doc = pa.array(np.searchsorted(owner[row], np.arange(len(n) + 1)), pa.int32())
            places = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(rest)), pa.int32()), pa.array(within[rest]))
            texts, kept, removed = [], [], []
            for d in range(len(n)):
                a, b = bounds[d], bounds[d + 1]
                if a < b:
                    kept.append(None)
                    removed.append(None)
                    texts.append(part.column("_text")[d].as_py())
                else:
                    gone = bool(copy[d]) and n[d] >= length
                    kept.append(finish(data, words, d, np.full(n[d], not gone)))
                    removed.append(int(n[d]) if gone else 0)
                    texts.append(None)
            offsets = np.concatenate([[0], np.cumsum(covered)])[bounds]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(within[covered]))]
            lists += [pa.ListArray.from_arrays(per_doc, values) for values in (pa.array(_signed(h[row])), pa.array(g[row]), places)]
            out = [part.column("_id"), part.column("_tk"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), *lists]
            yield from pa.table(out, names=["_id", "_tk", "_n", "_removed", "_kept", "_text", "_covered", "_h", "_g", "_at"]).to_batches(max_chunksize=1024)

    return rows.select("_id", "_tk", "_text", "_copy", "_seen").mapInArrow(run, _OPEN)


def _finished(rows: DataFrame, length: int, finish) -> DataFrame:
    """rows: _id, _tk, _n, _text, _covered and _more (first words of covered windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            words = split(part.column("_text"))
            data = words.data.tobytes()
            removed, kept = [], []
            for d, (a, b) in enumerate(zip(part.column("_covered").to_pylist(), part.column("_more").to_pylist())):
                n = int(words.counts[d])
                edge = np.zeros(n + 1, np.int64)
                at = np.array((a or []) + (b or []), np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                keep = np.cumsum(edge)[:n] == 0
                removed.append(n - int(keep.sum()))
                kept.append(finish(data, words, d, keep))
            out = [part.column("_id"), part.column("_tk"), part.column("_n"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["_id", "_tk", "_n", "_removed", "_kept"])

    return rows.select("_id", "_tk", "_n", "_text", "_covered", "_more").mapInArrow(run, "_id long, _tk long, _n long, _removed long, _kept binary")


def _places(rows: DataFrame, out: str) -> DataFrame:
    """_id, _tk and their places, once each: equal rows have equal ones. rows: _id, _tk, _at."""
    return rows.select("_id", "_tk", F.explode("_at").alias("_at")).groupBy("_id", "_tk").agg(F.collect_set("_at").alias(out))


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and the least id (_least) of those that several ids have."""
    return rows.groupBy(*keys).agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most").drop("_most")


def _dedup(docs: DataFrame, key: str, text: str, length: int, finish, shortest: int = SHORTEST) -> DataFrame:
    """A row for each of docs: _id, _tk, _n, _removed and _kept, what finish makes of the kept words."""
    tune(docs.sparkSession)
    rows = _keyed(docs, key, text)

    marks = stash(rows.select("_id", "_tk", F.md5(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("_md5")), "text-digests")
    firsts = stash(_shared(marks, "_md5"), "text-firsts", few=True)
    copies = marks.join(by_key(firsts), "_md5").filter("_id > _least").select("_id", "_tk").distinct()

    seen, before = None, None
    for part in levels(length, shortest)[:-1]:
        state = rows if seen is None else rows.join(by_key(seen), ["_id", "_tk"])
        anchors = stash(_anchors(state, length, part, before), f"stretches-{part}")
        several = stash(_shared(anchors.filter("not _done"), "_h").select("_h"), f"shared-{part}", few=True)
        repeated = anchors.filter("_done").unionByName(anchors.filter("not _done and size(_at) > 0").join(by_key(several), "_h"))
        seen, before = stash(_places(repeated, "_seen"), f"seen-{part}"), part
        if not seen.limit(1).count():
            break
    told = stash(copies.withColumn("_copy", F.lit(True)).join(seen, ["_id", "_tk"], "full"), "told")
    state = rows.join(by_key(told), ["_id", "_tk"], "left").withColumn("_copy", F.coalesce("_copy", F.lit(False)))
    open_rows = stash(_candidates(state, length, before, finish), "windows")

    windows = open_rows.filter(F.size("_h") > 0).select("_id", "_tk", F.explode(F.arrays_zip("_h", "_g", "_at")).alias("w")).select("_id", "_tk", "w._h", "w._g", "w._at")
    least = stash(_shared(windows, "_h", "_g"), "shared-windows", few=True)
    more = stash(_places(windows.join(by_key(least), ["_h", "_g"]).filter("_id > _least"), "_more"), "covered")
    left = open_rows.filter("_kept is null").select("_id", "_tk", "_n", "_text", "_covered").join(by_key(more), ["_id", "_tk"], "left")
    ready = open_rows.filter("_kept is not null").select("_id", "_tk", "_n", "_removed", "_kept")
    return ready.unionByName(_finished(left, length, finish))


def _digest(data: bytes, words: Words, doc: int, keep: np.ndarray) -> bytes:
    return hashlib.sha256(_joined(data, words, doc, keep)).hexdigest().encode()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shortest: int = SHORTEST) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 (of the kept words with one space between them) of each document."""
    out = _dedup(docs, key, text, length, _digest, shortest)
    own = F.when(F.col("_id") != _LAST, F.col("_id"))
    return out.select(own.alias(key), F.col("_n").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_kept").cast("string").alias("kept_sha256"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, n_chars: str = "n_chars", shortest: int = SHORTEST) -> DataFrame:
    """docs with their texts without the repeated words (white space between kept words stays), and n_chars, if there is
    such a column, of the new texts. Documents of which nothing is left go."""
    found = _dedup(docs, key, text, length, _cut, shortest).filter("_removed > 0").select("_id", "_tk", "_n", "_removed", F.col("_kept").cast("string").alias("_new")).dropDuplicates(["_id", "_tk"])
    tk = F.xxhash64(F.col(text))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("_id"), tk.alias("_tk"))
    joined = packed.join(by_key(found), ["_id", "_tk"], "left")
    kept = joined.filter(F.col("_removed").isNull() | (F.col("_removed") < F.col("_n")))
    changed = F.col("_removed").isNotNull()
    new = {text: F.when(changed, F.col("_new")).otherwise(F.col("_row")[text])}
    if n_chars in docs.columns:
        new[n_chars] = F.when(changed, F.length("_new").cast(docs.schema[n_chars].dataType)).otherwise(F.col("_row")[n_chars])
    return kept.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
