"""Duplicate groups: equal content, and near signatures joined by single linkage.

Groups are rows (group_id, match_type, path) with the assets' columns; the nested form is made at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signatures import distance, packed
from ..schema import DEFAULT_THRESHOLD, HASH_BITS
from ..storage import written
from .components import connected_components
from .index import exact_links, near_pairs, representatives
from .numbering import numbered


def valid_assets(assets: DataFrame) -> DataFrame:
    """Without rows that have an error; an empty text is none."""
    return assets.filter(F.coalesce(F.col("error"), F.lit("")) == "")


def failed_assets(assets: DataFrame) -> DataFrame:
    return assets.filter(F.coalesce(F.col("error"), F.lit("")) != "")


def _has(column: str):
    return F.coalesce(F.col(column), F.lit("")) != ""


def exact_groups(assets: DataFrame, start_id: int = 1) -> DataFrame:
    """group_id, match_type and path for each asset whose content another has. Ids follow the groups' least paths. Hashes
    are counted before they are joined, and the join is between plain scans, so one content with most of the files is
    no burden."""
    hashed = assets.filter(_has("file_hash")).select("path", "file_hash")
    several = hashed.groupBy("file_hash").agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1")
    ids = numbered(several.select("file_hash", "first"), "first", start=start_id, out="group_id")
    ids = written(ids, "exact-groups")
    return hashed.join(ids, "file_hash").select("group_id", F.lit("exact").alias("match_type"), "path")


def duplicated_hashes(assets: DataFrame) -> DataFrame:
    return assets.filter(_has("file_hash")).groupBy("file_hash").agg(F.count("*").alias("n")).filter("n > 1").select("file_hash")


def perceptual_candidates(assets: DataFrame, link_exact: bool = False) -> DataFrame:
    """Assets with a signature that are in no exact group; with link_exact the best of each exact group too (the least
    path), so that near copies of it are found. Hashes are as large as the rows: the join shuffles both sides at any size."""
    signed = assets.filter(_has("perceptual_hash"))
    copies = duplicated_hashes(assets).hint("merge")
    if link_exact:
        first = assets.filter(_has("file_hash")).groupBy("file_hash").agg(F.min("path").alias("path"))
        return signed.join(copies, "file_hash", "left_anti").unionByName(signed.join(first, ["file_hash", "path"], "left_semi"))
    return signed.join(copies, "file_hash", "left_anti")


def perceptual_links(candidates: DataFrame, threshold: int = DEFAULT_THRESHOLD, hash_bits: int = HASH_BITS, use_index: bool | None = None, target_recall: float | None = None) -> DataFrame:
    """id1, id2: paths that equal signatures link to the least one, and near signatures' representatives; without an index,
    of these as many as connect what all of them do."""
    signatures = candidates.select(F.col("path").alias("id"), F.col("perceptual_hash").alias("signature"))
    reps, members = representatives(signatures, hash_bits)
    members = written(members, "members")
    if use_index is None or use_index:
        pairs = near_pairs(reps, threshold, hash_bits, use_index, target_recall).select("id1", "id2")
    else:
        pairs = exact_links(reps, threshold, hash_bits)
    return pairs.unionByName(members.filter("id <> rep").select(F.col("rep").alias("id1"), F.col("id").alias("id2")))


def perceptual_groups(assets: DataFrame, threshold: int = DEFAULT_THRESHOLD, hash_bits: int = HASH_BITS, start_id: int = 1, use_index: bool | None = None, link_exact: bool = False, target_recall: float | None = None) -> DataFrame:
    """group_id, match_type and path of the connected components of links, numbered by their least paths."""
    candidates = perceptual_candidates(assets, link_exact)
    found = connected_components(perceptual_links(candidates, threshold, hash_bits, use_index, target_recall))
    ids = numbered(found.select("component").distinct(), "component", start=start_id, out="group_id")
    ids = written(ids, "perceptual-groups")
    return found.join(ids, "component").select("group_id", F.lit("perceptual").alias("match_type"), F.col("node").alias("path"))


def all_groups(assets: DataFrame, threshold: int = DEFAULT_THRESHOLD, hash_bits: int = HASH_BITS, **options) -> DataFrame:
    """Exact groups, then perceptual ones with ids that go on."""
    exact = written(exact_groups(assets), "exact")
    last = exact.agg(F.coalesce(F.max("group_id"), F.lit(0))).first()[0]
    return exact.unionByName(perceptual_groups(assets, threshold, hash_bits, start_id=last + 1, **options))


def spread(groups: DataFrame, assets: DataFrame, hash_bits: int = HASH_BITS) -> DataFrame:
    """group_id and the greatest distance of a member to the group's first: single linkage bounds only neighbours'."""
    signed = groups.join(assets.select("path", packed("perceptual_hash", hash_bits).alias("w")), "path")
    centre = signed.groupBy("group_id").agg(F.min(F.struct("path", "w")).alias("c"))
    d = distance(F.col("w"), F.col("c.w"), hash_bits)
    return signed.join(centre, "group_id").groupBy("group_id").agg(F.max(d).alias("radius"))


def first_of_groups(members: DataFrame, *order: Column) -> DataFrame:
    """group_id and the path that comes first. Combined before it is shuffled: no group is sorted, however large."""
    return members.groupBy("group_id").agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], "path"))["path"].alias("first_path"))


def descending(column: str) -> list[Column]:
    """Greatest first, nulls last, as keys in ascending order."""
    return [F.col(column).isNull(), -F.col(column)]


def ranked(groups: DataFrame, assets: DataFrame) -> DataFrame:
    """Members with their assets and rn: 1 for the best by score, of equal ones the least path, and 2 for the others."""
    members = written(groups.join(assets, "path"), "members")
    best = written(first_of_groups(members, *descending("quality_score")), "best", narrow=True)
    return members.join(best, "group_id").withColumn("rn", F.when(F.col("path") == F.col("first_path"), 1).otherwise(2)).drop("first_path")


def best_members(members: DataFrame) -> DataFrame:
    return members.filter("rn = 1")


def duplicates(members: DataFrame) -> DataFrame:
    return members.filter("rn > 1")


def group_summary(members: DataFrame) -> DataFrame:
    """Per group its size, its best path and the bytes that deleting the others saves. members: of ranked()."""
    best = F.min(F.struct("rn", "path"))
    return members.groupBy("group_id", "match_type").agg(
        F.count("*").alias("image_count"),
        best["path"].alias("best_path"),
        F.coalesce(F.sum(F.when(F.col("rn") > 1, F.col("file_size"))), F.lit(0)).cast("bigint").alias("potential_savings"),
    )


def nested(members: DataFrame) -> DataFrame:
    """One row per group with its members as an array, the best first."""
    columns = [c for c in members.columns if c not in ("group_id", "match_type")]
    images = F.array_sort(F.collect_list(F.struct("rn", (-F.col("quality_score")).alias("_worse"), "path", *[c for c in columns if c not in ("rn", "path")])))
    rows = members.groupBy("group_id", "match_type").agg(F.transform(images, lambda x: x.dropFields("_worse")).alias("images"))
    return rows.withColumns({"best_path": F.col("images")[0]["path"], "selected_keep": F.col("images")[0]["path"]})


def without_deleted(groups: DataFrame, deleted: DataFrame) -> DataFrame:
    """Groups without deleted paths, and without groups of which fewer than two members are left."""
    left = written(groups.join(deleted.select("path").distinct(), "path", "left_anti"), "left")
    live = left.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    return left.join(live, "group_id", "left_semi")
