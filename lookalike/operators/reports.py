"""Statistics, views and exports of duplicate groups. members: rows of groups.ranked()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import directory, filename, human_size, megapixels, resolution
from ..schema import HISTORY_LENGTH, PAGE_GROUPS
from .numbering import numbered


def statistics(members: DataFrame) -> DataFrame:
    """total_duplicates, total_groups and total_waste (bytes of all but the best)."""
    extra = F.col("rn") > 1
    return members.agg(
        F.count(F.when(extra, 1)).alias("total_duplicates"),
        F.count(F.when(~extra, 1)).alias("total_groups"),
        F.coalesce(F.sum(F.when(extra, F.col("file_size"))), F.lit(0)).cast("bigint").alias("total_waste"),
    )


def scan_summary(members: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: images, errors, groups and duplicates of each type."""
    of = lambda kind, first: F.count(F.when((F.col("match_type") == kind) & ((F.col("rn") == 1) if first else (F.col("rn") > 1)), 1))
    counts = members.agg(
        of("exact", True).alias("exact_groups"), of("exact", False).alias("exact_duplicates"), of("perceptual", True).alias("perceptual_groups"), of("perceptual", False).alias("perceptual_duplicates")
    )
    images = assets.agg(F.count("*").alias("images"), F.count(F.when(F.coalesce(F.col("error"), F.lit("")) != "", 1)).alias("errors"))
    return images.join(counts, F.lit(True))  # a row each


def action_statistics(outcomes: DataFrame) -> DataFrame:
    """outcomes: status, file_size and error of executed rows."""
    done = F.col("status") == "done"
    return outcomes.agg(
        F.count(F.when(done, 1)).alias("processed"),
        F.count(F.when(F.col("status") == "error", 1)).alias("errors"),
        F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped"),
        F.coalesce(F.sum(F.when(done, F.col("file_size"))), F.lit(0)).cast("bigint").alias("space_saved"),
    )


def error_details(outcomes: DataFrame, path: str = "src") -> DataFrame:
    """path and error of each row that failed, by path."""
    return outcomes.filter("status = 'error'").select(F.col(path).alias("path"), F.coalesce("error", F.lit("")).alias("error")).orderBy("path")


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def image_view(members: DataFrame) -> DataFrame:
    """What a client sees of an image; hashes and depth stay inside."""
    return members.select(
        "path", filename("path").alias("filename"), directory("path").alias("directory"), "file_size", human_size("file_size").alias("file_size_formatted"), "width", "height",
        resolution("width", "height").alias("resolution"), "pixel_count", megapixels("pixel_count").alias("megapixels"), "format", F.bround("quality_score", 1).alias("quality_score"), "error",
    )


def filtered(members: DataFrame, match_type: str = "all", text: str = "") -> DataFrame:
    """Whole groups of a type of which a member's name or directory holds the text, in any case."""
    rows = members if match_type == "all" else members.filter(F.col("match_type") == match_type)
    if not text:
        return rows
    hit = F.lower(filename("path")).contains(text.lower()) | F.lower(directory("path")).contains(text.lower())
    return rows.join(rows.filter(hit).select("group_id").distinct(), "group_id", "left_semi")


def group_order(by: str = "savings") -> list[Column]:
    return {"savings": [F.col("potential_savings").desc()], "count": [F.col("image_count").desc()]}.get(by, []) + [F.col("group_id")]


def page(groups: DataFrame, number: int = 1, by: str = "savings", size: int = PAGE_GROUPS) -> DataFrame:
    """Groups of a page in order; groups: of groups.group_summary()."""
    return groups.orderBy(*group_order(by)).offset((number - 1) * size).limit(size)


def keyset_page(rows: DataFrame, key: str, after, size: int = 500) -> DataFrame:
    """The next rows by key."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def recent(visits: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """visits: directory, at. Each directory once, the last used first."""
    last = visits.groupBy("directory").agg(F.max("at").alias("last_used"))
    return last.orderBy(F.col("last_used").desc(), "directory").limit(n)


def to_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON document in the column value."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def from_json(rows: DataFrame, schema) -> DataFrame:
    """Rows of a schema from JSON documents in the column value; what is absent is null."""
    return rows.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def export_rows(members: DataFrame) -> DataFrame:
    """Rows of the CSV report: exact groups from 1 on, perceptual ones after them."""
    first = members.filter("rn = 1").select("group_id", "match_type")
    order = first.select("group_id", F.when(F.col("match_type") == "exact", 0).otherwise(1).alias("kind"))
    ids = numbered(order, "kind", "group_id", out="number").select("group_id", "number")
    status = F.when(F.col("rn") == 1, "keep").otherwise("duplicate")
    return members.join(ids, "group_id").select(F.col("number").alias("group_id"), "match_type", status.alias("status"), "path", "width", "height", "file_size", "quality_score", "rn")


def export_csv(members: DataFrame, path: str) -> None:
    """A folder of CSV files in the order of their names, one for a report of usual size; quoted by the usual rules (quotes
    within a field are doubled)."""
    rows = export_rows(members).withColumn("score", F.col("quality_score")).withColumn("quality_score", F.format_string("%.1f", F.bround("quality_score", 1)))
    order = ["group_id", "rn", F.col("score").desc_nulls_last(), "path"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("rn", "score").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def text_lines(members: DataFrame) -> DataFrame:
    """Lines of the text report with their order (part, group, line)."""
    rule = "-" * 70
    number = export_rows(members)
    marker = F.when(F.col("rn") == 1, "  [KEEP] ").otherwise("  [DUPE] ")
    part = F.when(F.col("match_type") == "exact", 1).otherwise(2)
    own = number.groupBy("match_type").agg(F.min("group_id").alias("least"))
    rows = number.join(F.broadcast(own), "match_type").withColumn("g", F.col("group_id") - F.col("least") + 1)  # a row per match type
    heads = rows.filter("rn = 1").select(part.alias("part"), "g", F.lit(0).alias("line"), F.concat(F.lit("\nGroup "), F.col("g").cast("string"), F.lit(":")).alias("value"))
    lines = rows.select(part.alias("part"), "g", F.col("rn").cast("int").alias("line"), F.concat(marker, F.col("path")).alias("value"))
    fixed = [(0, 0, 0, f"DUPLICATE IMAGE REPORT\n{'=' * 70}\n"), (1, 0, 0, f"EXACT DUPLICATES\n{rule}"), (2, 0, 0, f"\n\nPERCEPTUAL DUPLICATES\n{rule}")]
    titles = members.sparkSession.createDataFrame(fixed, "part int, g long, line int, value string")
    return titles.unionByName(heads).unionByName(lines)


def export_txt(members: DataFrame, path: str, failed: DataFrame | None = None) -> None:
    """A folder of text files in the order of their names, one for a report of usual size, with the files that could not be
    read at its end if they are given."""
    lines = text_lines(members)
    if failed is not None:
        title = members.sparkSession.createDataFrame([(3, 0, 0, f"\n\nFAILED FILES\n{'-' * 70}")], "part int, g long, line int, value string")
        broken = failed.select(F.lit(3).alias("part"), F.lit(1).cast("long").alias("g"), F.lit(0).alias("line"), F.concat(F.lit("  "), "path", F.lit(": "), "error").alias("value"))
        lines = lines.unionByName(title).unionByName(broken)
    lines.repartitionByRange("part", "g", "line", "value").sortWithinPartitions("part", "g", "line", "value").select("value").write.mode("overwrite").text(path)


def export_json(members: DataFrame, path: str) -> None:
    members.write.mode("overwrite").json(path)


EXPORTS = {"txt": export_txt, "csv": export_csv, "json": export_json}


def export(members: DataFrame, path: str, fmt: str = "txt") -> None:
    if fmt not in EXPORTS:
        raise ValueError(f"no export as {fmt}; there are {', '.join(EXPORTS)}")
    EXPORTS[fmt](members, path)


def console(members: DataFrame, most_groups: int = 1000, most_lines: int = 10_000) -> str:
    """The report for a terminal: totals and the groups, the best member first. It shows most_groups groups and most_lines
    members at most and says how many there are; an export has them all."""
    total = statistics(members).first()
    shown = members.filter(F.col("group_id") <= members.agg(F.min("group_id")).first()[0] + most_groups - 1 if total["total_groups"] else F.lit(False))
    view = shown.select("match_type", "group_id", "rn", "path", "width", "height", human_size("file_size").alias("size"), F.bround("quality_score", 1).alias("score"))
    out, last = [], None
    for r in view.orderBy("match_type", "group_id", "rn", F.col("score").desc_nulls_last(), "path").limit(most_lines).collect():
        if r["group_id"] != last:
            out.append(f"\nGroup {r['group_id']} ({r['match_type']}):")
            last = r["group_id"]
        out.append(f"  [{'KEEP' if r['rn'] == 1 else 'DUPE'}] {r['path']}\n         {r['width']}x{r['height']} | {r['size']} | Score: {r['score']:.1f}")
    out.append(f"\n{total['total_groups']} groups, {total['total_duplicates']} duplicates, {total['total_waste']} bytes recoverable")
    return "\n".join(out)
