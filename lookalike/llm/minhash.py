"""MinHash near-dedup with tensored banding.

Documents are the sets of their distinct word shingles. Two collections of PARTS minhash groups (ROWS minhashes each) give
PARTS * PARTS tables: the key of table (i, j) is the pair of the i-th key of one collection and the j-th of the other. So
2 * PARTS * ROWS minhashes do the work of PARTS**2 * 2 * ROWS. At similarity s a pair shares a table with probability
(1 - (1 - s**ROWS)**PARTS)**2: 0.9999992 at 0.85, 0.99995 at 0.8.

A table's bucket has two documents only if the first collection's key has, so keys that one document alone has are dropped
before the tables are formed. Equal sets are one node from the start; its name is the number of a row, as ids may be null
or repeat.

The buckets' documents are linked to the least of each bucket and give clusters, within which the true links lie. A cluster
is cut into blocks of some BLOCK documents by a hash of the node, and some HUBS of its documents are sent to every block. A
block's task finds a spanning forest of the links among its documents and the hubs: it compares short sketches of all pairs,
then the full sets of those that may reach the similarity and aren't joined by others already. Near copies of one text are
joined through the hubs by now. What is not part of a cluster's largest component, the rest, then meets all documents in
larger blocks, so that each pair that is not joined yet is compared: a cluster of n documents with a rest of r ships
some n + 2 n r / REST_BLOCK sets. Nothing is left out: the work grows with the square of a cluster only if most of it is not alike.
No list of pairs is ever made, and the hot group of near copies is many tasks.

Defined cases: null and empty texts are empty sets, linked with nothing; fewer words than a shingle has are one shingle;
a null id counts as the greatest and stays null; rows of one id, or of none, are judged by their texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import by_key, chunks, runs, stash, tune
from .words import mix, shingles, split

SHINGLE = 5
PARTS = 20
ROWS = 4
BLOCK = 64
#: Documents of a block of those that are compared with all others, and of a block of the others.
REST_BLOCK = 256
#: Documents that meet all blocks of their cluster, about.
HUBS = 12
BATCH_BYTES = 2 << 20
_LAST = (1 << 63) - 1

_hashes = 2 * PARTS * ROWS
_random = np.random.default_rng(85)
_times = (_random.integers(0, 1 << 32, _hashes, dtype=np.uint32) | np.uint32(1))[None, :]
_turn = _random.integers(0, 1 << 32, _hashes, dtype=np.uint32)[None, :]


def minhashes(items: np.ndarray) -> np.ndarray:
    """Of a set of 64-bit hashes that is not empty."""
    low = (items >> np.uint64(16)).astype(np.uint32)[:, None]
    out = np.full(_hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(out, ((low[at : at + 256] ^ _turn) * _times).min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """2 * PARTS keys of each row, all different between the groups."""
    groups = signatures.reshape(len(signatures), 2 * PARTS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, 2 * PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), groups.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ groups[:, :, r])
    return key.view(np.int64)


def _order(key: str | Column):
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("long"), F.lit(_LAST)).alias("_id")


def _digest(text: str | Column):
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).alias("_key")


def _signed(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """_id, _key (digest of the text), _n (size of the set), _set (its digest), and the two collections' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, "_text", BATCH_BYTES):
            n, digest, sig = [], [], np.zeros((rows.num_rows, _hashes), np.uint32)
            for i, s in enumerate(shingles(split(rows.column("_text")), size)):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                if len(s):
                    sig[i] = minhashes(s)
            keys = band_keys(sig)
            offsets = pa.array(np.arange(rows.num_rows + 1) * PARTS, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(k).ravel())) for k in (keys[:, :PARTS], keys[:, PARTS:])]
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_key"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), *lists], ["_id", "_key", "_n", "_set", "_a", "_b"])

    return docs.select(_order(key), _digest(text), F.col(text).alias("_text")).mapInArrow(run, "_id long, _key string, _n long, _set string, _a array<long>, _b array<long>")


def clusters(reps: DataFrame) -> DataFrame:
    """node and component of the sets (_id, _a, _b) that share a table's bucket with another."""
    keys = reps.select("_id", F.explode("_a").alias("_a"))
    shared = stash(keys.groupBy("_a").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).filter("lo < hi").select("_a"), "band-keys", few=True)
    few = keys.join(by_key(shared), "_a").groupBy("_id").agg(F.collect_set("_a").alias("_a"))
    few = stash(few.join(reps.select("_id", "_b"), "_id"), "band-rows", few=True)
    tables = few.select("_id", F.explode("_a").alias("_a"), "_b").select("_id", "_a", F.explode("_b").alias("_b")).select("_id", F.xxhash64("_a", "_b").alias("_table"))
    hubs = stash(tables.groupBy("_table").agg(F.min("_id").alias("a"), F.max("_id").alias("hi")).filter("a < hi").select("_table", "a"), "tables", few=True)
    return connected_components(tables.join(by_key(hubs), "_table").filter("_id > a").select("a", F.col("_id").alias("b")).distinct(), "a", "b")


def _block_of(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """rows: _id, _text, _cluster, _blocks. Adds the sorted set, the minhashes' low bytes, the block, and _hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text", BATCH_BYTES):
            items, sketch = [], []
            for s in shingles(split(part.column("_text")), size):
                items.append(s.tobytes())
                sketch.append(minhashes(s).astype(np.uint8).tobytes() if len(s) else bytes(_hashes))
            ids = part.column("_id").to_numpy()
            block = _block_of(ids, part.column("_blocks").to_numpy())
            hub = (block == 0) & (mix(~ids.view(np.uint64)) % np.uint64(BLOCK) < np.uint64(HUBS))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_cluster"), part.column("_blocks"), pa.array(block), pa.array(hub), pa.array(items, pa.binary()), pa.array(sketch, pa.binary())],
                ["_id", "_cluster", "_blocks", "_block", "_hub", "_items", "_sketch"],
            )

    return rows.select("_id", "_text", "_cluster", "_blocks").mapInArrow(run, "_id long, _cluster long, _blocks int, _block int, _hub boolean, _items binary, _sketch binary")


def forest(ids: np.ndarray, visits: np.ndarray, items: list[bytes], sketches: list[bytes], percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links between documents whose sets reach the similarity: between those that visit and those that don't, or
    among all if none does. With groups, of what is joined already, the links are between groups."""
    order = np.argsort(visits, kind="stable")
    ids, visits = ids[order], visits[order]
    names = ids if groups is None else groups[order]
    sets = [np.frombuffer(items[i], np.uint64) for i in order.tolist()]
    size = np.array([len(s) for s in sets])
    sketch = np.frombuffer(b"".join(sketches[i] for i in order.tolist()), np.uint8).reshape(len(sets), _hashes)
    own = int(np.searchsorted(visits, True))
    alone = own == len(ids)
    least = int(_hashes * (percent / 100 - 0.15))
    root = np.unique(names, return_index=True, return_inverse=True)
    root = root[1][root[2]].tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i in range(own):
        start = i + 1 if alone else own
        near = np.flatnonzero(((sketch[start:] == sketch[i]).sum(axis=1) >= least) & (100 * np.minimum(size[start:], size[i]) >= percent * np.maximum(size[start:], size[i]))) + start
        for j in near.tolist():
            x, y = find(i), find(j)
            if x == y or not size[i] or not size[j]:
                continue
            both = len(sets[i]) + len(sets[j])
            union = len(np.union1d(sets[i], sets[j])) if both < 64 else both - _common(sets[i], sets[j])
            if 100 * (both - union) >= percent * union:
                root[max(x, y)] = min(x, y)
                found.append((int(names[i]), int(names[j])))
    return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(dealt: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """a and b: forests of the groups by keys, each of them a few blocks at most. dealt: _id, _visits, _items, _sketch, and
    _group, if links are between groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, keys):
            visits = group.column("_visits").to_numpy()
            names = group.column("_group").to_numpy() if "_group" in group.column_names else None
            if len(visits) < 2 or names is not None and visits.all() == visits.any():
                continue
            found = forest(group.column("_id").to_numpy(), visits, group.column("_items").to_pylist(), group.column("_sketch").to_pylist(), percent, names)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def joined(docs: DataFrame, members: DataFrame, reps: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is connected within each cluster (members: node, component; reps: _node, and the _id and _key of a row that has
    its text): node and component of what blocks and hubs join, and of these components that the rest joins."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    sized = members.join(stash(sizes, "cluster-sizes", narrow=True), "component").join(reps.select("_node", "_id", "_key"), F.col("node") == F.col("_node"))
    sized = stash(sized.select("_id", "_key", "_node", F.col("component").alias("_cluster"), "_blocks"), "members", narrow=True)
    rows = docs.select(_order(key), _digest(text), F.col(text).alias("_text")).join(by_key(sized), ["_id", "_key"])
    rows = rows.groupBy(F.col("_node").alias("_id"), "_cluster", "_blocks").agg(F.first("_text").alias("_text"))  # a row may be there twice
    sets = stash(_sets(rows, size), "shingle-sets")
    slim = [F.col(c) for c in ("_id", "_cluster", "_items", "_sketch")]

    to = F.when(F.col("_hub"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("_block"))
    dealt = sets.select(*slim, F.lit(False).alias("_visits"), F.explode(to).alias("_i"))
    near = connected_components(_linked(dealt, ["_cluster", "_i"], percent), "a", "b")

    many = sized.filter("_blocks > 1").select(F.col("_node").alias("_id"), "_cluster", "_blocks")
    many = many.join(near, F.col("_id") == F.col("node"), "left").select("_id", "_cluster", "_blocks", F.coalesce("component", "_id").alias("_group"))
    many = stash(many, "joined", narrow=True)
    counts = many.groupBy("_cluster", "_blocks", "_group").agg(F.count("*").alias("_n"))
    counts = counts.groupBy("_cluster", "_blocks").agg(F.max(F.struct("_n", "_group"))["_group"].alias("_largest"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    counts = counts.filter("_all > _most").select("_cluster", "_largest", F.ceil(F.col("_all") / REST_BLOCK).cast("int").alias("_wide"), F.ceil((F.col("_all") - F.col("_most")) / REST_BLOCK).cast("int").alias("_parts"))
    counts = stash(counts, "rests", narrow=True)
    if not counts.limit(1).count():
        return near, near.limit(0)
    rest = stash(many.join(counts, "_cluster").select("_id", "_cluster", "_group", (F.col("_group") != F.col("_largest")).alias("_rest"), "_wide", "_parts"), "rest", narrow=True)
    both = sets.filter("_blocks > 1").join(rest, ["_id", "_cluster"])
    wide = F.pmod(F.xxhash64("_id"), F.col("_wide")).cast("int").alias("_i")
    here = both.select(*slim, "_group", F.lit(False).alias("_visits"), wide, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_j"))
    part = F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_parts")).cast("int")
    there = both.filter("_rest").select(*slim, "_group", F.lit(True).alias("_visits"), F.explode(F.sequence(F.lit(0), F.col("_wide") - 1)).alias("_i"), part.alias("_j"))
    return near, connected_components(_linked(here.unionByName(there), ["_cluster", "_i", "_j"], percent), "a", "b")


def _judged(docs: DataFrame, key: str, text: str, percent: int, size: int) -> DataFrame:
    """A row per document: _id, _key, _n, and _best, the least _id and _key of its group (null: an empty set)."""
    tune(docs.sparkSession)
    signed = stash(_signed(docs, key, text, size).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    nodes = stash(signed.filter("_n > 0").groupBy("_set").agg(F.min("_row").alias("_node")), "sets", few=True)
    reps = stash(signed.join(by_key(nodes), "_set").filter("_row = _node").select("_node", "_id", "_key", "_a", "_b"), "representatives")
    members = clusters(reps.select(F.col("_node").alias("_id"), "_a", "_b"))
    near, further = joined(docs, members, reps, key, text, size, percent)
    groups = nodes.join(near, nodes["_node"] == near["node"], "left").select("_set", F.coalesce("component", "_node").alias("_near"))
    groups = groups.join(further, F.col("_near") == F.col("node"), "left").select("_set", F.coalesce("component", "_near").alias("_group"))
    rows = stash(signed.select("_id", "_key", "_n", "_set").join(groups, "_set", "left").drop("_set"), "grouped", few=True)
    best = rows.filter("_group is not null").groupBy("_group").agg(F.min(F.struct("_id", "_key")).alias("_best"))
    return rows.join(stash(best, "best", few=True), "_group", "left").drop("_group")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """A row per document: key, n_shingles, component_id (least id that links lead to) and kept (that is its own; of texts
    without an id, one in each group of them). percent: similarity of linked sets, 80 or more."""
    rows = _judged(docs, key, text, percent, size).withColumn("_component", F.coalesce("_best._id", "_id"))
    null = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    one = (F.col("_id") != _LAST) | F.coalesce(F.col("_key") == F.col("_best._key"), F.lit(True))
    return rows.select(null("_id").alias(key), F.col("_n").alias("n_shingles"), null("_component").alias("component_id"), ((F.col("_id") == F.col("_component")) & one).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near duplicates, one with the least id; rows without words all stay. Ids may be
    null or repeat: they choose the row that stays, and nothing else."""
    rows = _judged(docs, key, text, percent, size).filter("_best is not null")
    found = rows.groupBy(F.col("_id").alias("_at"), F.col("_key").alias("_of")).agg(F.count("*").alias("_rows"), F.min(F.col("_best._id")).alias("_least"), F.min(F.col("_best._key")).alias("_least_key"))
    found = found.withColumn("_stays", (F.col("_at") == F.col("_least")) & (F.col("_of") == F.col("_least_key")))
    found = stash(found.filter("not _stays or _rows > 1").select("_at", "_of", "_stays"), "not-kept", few=True)
    same = (_order(docs[key]) == F.col("_at")) & (_digest(docs[text]) == F.col("_of"))
    once = docs.join(by_key(found), same, "left_anti")
    several = docs.select("*").join(by_key(found.filter("_stays")), same).groupBy("_at", "_of").agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("_doc"))
    return once.unionByName(several.select(*[F.col("_doc")[c].alias(c) for c in docs.columns]))
