"""Destinations that don't collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import directory, filename, numbered
from ..operators.numbering import numbered as in_order
from ..storage import written


def _named(path: str, n: str):
    folder = directory(path)
    return F.concat(F.when(folder == "/", F.lit("")).otherwise(folder), F.lit("/"), numbered(filename(path), F.col(n)))


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """_rank: 1, 2 and so on among the rows of a dest. Rows of repeated names are numbered all together, by counted ranges, and
    the least number of each dest is taken off, so that a name with most of the rows is many tasks."""
    rows = written(rows, "wanted")
    repeated = written(rows.groupBy("dest").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("dest"), "repeated", narrow=True)
    alone = rows.join(repeated, "dest", "left_anti").withColumn("_rank", F.lit(1).cast("long"))
    if not repeated.limit(1).count():
        return alone
    placed = written(in_order(rows.join(repeated, "dest"), "dest", *order, out="_all"), "numbered")
    least = placed.groupBy("dest").agg(F.min("_all").alias("_least"))
    return alone.unionByName(placed.join(least, "dest").withColumn("_rank", F.col("_all") - F.col("_least") + 1).drop("_all", "_least"))


def reserved(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """plan (src, dest) with destinations of which each is free (taken: path) and no other's: name_1, name_2 and so on in
    the order of src. Rows whose numbered name is taken in turn get the next one, in rounds, until every row has its name."""
    names = [c for c in plan.columns if c != "dest"]
    left = written(_ranked(plan, "src").withColumn("_n", F.col("_rank") - 1).drop("_rank"), "names")
    used = taken.select("path").distinct()
    done = None
    while True:
        tried = left.withColumn("_final", _named("dest", "_n"))
        rank = F.row_number().over(W.partitionBy("_final").orderBy("_n", "dest", "src"))
        tried = tried.withColumn("_rank", rank).join(used.withColumn("_used", F.lit(True)), F.col("_final") == F.col("path"), "left").drop("path")
        free = F.col("_used").isNull() & (F.col("_rank") == 1)
        tried = written(tried.withColumn("_free", free), "names")
        settled = tried.filter("_free").select(*names, F.col("_final").alias("dest"))
        done = settled if done is None else done.unionByName(settled)
        again = tried.filter("not _free")
        if not again.limit(1).count():
            return done
        used = written(used.unionByName(settled.select(F.col("dest").alias("path"))), "taken")
        # behind the highest number that the name has been tried with, so that rounds don't grow with the rows of a name
        most = tried.groupBy("dest").agg(F.max("_n").alias("_most"))
        ranked = _ranked(again.select(*names, "dest", "_n"), "_n", "src")
        left = written(ranked.join(most, "dest").withColumn("_n", F.col("_most") + F.col("_rank")).select(*names, "dest", "_n"), "names")
