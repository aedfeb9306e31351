"""Which member of each group to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .groups import descending, first_of_groups

STRATEGIES = ("quality", "largest", "smallest", "newest", "oldest")


def strategy_order(strategy: str) -> list[Column]:
    """Keys in ascending order; the first is kept, of equal ones the least path. An unknown strategy is quality. A missing
    time is the earliest for newest, and the latest for oldest."""
    ascending = lambda c: [F.col(c).isNull(), F.col(c)]
    orders = {"largest": descending("file_size"), "smallest": ascending("file_size"), "newest": [-F.coalesce(F.col("mtime"), F.lit(0.0))], "oldest": ascending("mtime")}
    return orders.get(strategy) or descending("quality_score")


def select(members: DataFrame, strategy: str = "quality") -> DataFrame:
    """path and decision (keep or delete). members: group_id, path and what the strategy orders by. The decision of a path
    in several groups is that of the group with the greatest id."""
    kept = written(first_of_groups(members, *strategy_order(strategy)), "kept", narrow=True)
    decided = members.join(kept, "group_id").withColumn("decision", F.when(F.col("path") == F.col("first_path"), "keep").otherwise("delete"))
    return decided.groupBy("path").agg(F.max(F.struct("group_id", "decision"))["decision"].alias("decision"))


def selected_size(selections: DataFrame, members: DataFrame) -> DataFrame:
    """How many files are to be deleted, and their bytes, each path once."""
    sizes = members.groupBy("path").agg(F.min("file_size").alias("file_size"))
    chosen = selections.filter("decision = 'delete'").select("path")
    return chosen.join(sizes, "path").agg(F.count("*").alias("selected"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("selected_bytes"))
