"""Plans to move, rename, sort and clean up. files: path and what a plan needs of it; nothing here touches a disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import (
    alphabet_folder, color_name, directory, extension, extension_fits, filename, orientation, parent_name, preferred_extension, random_name, relative_directory, resolution_class,
    sanitized, shortened, stem, suffix, under,
)
from ..schema import CONVERTIBLE_EXTENSIONS, SORTABLE_EXTENSIONS
from ..storage import written
from .names import reserved


def planned(op: str, src: Column, dest: Column, reason: Column | None = None, status: Column | None = None) -> list[Column]:
    return [
        F.lit(op).alias("op"),
        src.alias("src"),
        dest.cast("string").alias("dest"),
        (F.lit(None).cast("string") if reason is None else reason.cast("string")).alias("reason"),
        (F.lit("planned") if status is None else status.cast("string")).alias("status"),
    ]


def _joined(folder: Column, name: Column) -> Column:
    return F.concat(F.when(folder == "/", F.lit("")).otherwise(folder), F.lit("/"), name)


def in_extensions(files: DataFrame, extensions: list[str] | None) -> DataFrame:
    return files if extensions is None else files.filter(extension("path").isin(extensions))


def visible(files: DataFrame) -> DataFrame:
    return files.filter(~filename("path").startswith("."))


def move_to_parent(files: DataFrame, parent: str, extensions: list[str] | None = None) -> DataFrame:
    """Everything below parent into parent itself; files already there stay and their names are taken."""
    root = parent.rstrip("/") or "/"
    inside = files.filter(under("path", root))
    there = directory("path") == root
    moving = in_extensions(inside.filter(~there), extensions).select(F.col("path").alias("src"), _joined(F.lit(root), filename("path")).alias("dest"))
    moved = reserved(moving, inside.filter(there)).select(*planned("move", F.col("src"), F.col("dest")))
    stays = in_extensions(inside.filter(there), extensions).select(*planned("move", F.col("path"), F.col("path"), F.lit("already in the folder"), F.lit("skipped")))
    return moved.unionByName(stays)


def move_with_structure(files: DataFrame, source: str, destination: str, present: DataFrame, overwrite: bool = False) -> DataFrame:
    """The tree of source below destination; present: path, what is there."""
    below = relative_directory("path", source)
    target = F.concat_ws("/", F.lit(destination.rstrip("/")), F.when(below != "", below), filename("path"))
    rows = files.filter(under("path", source)).select(F.col("path").alias("src"), target.alias("dest"))
    there = present.select(F.col("path").alias("dest")).distinct().withColumn("_there", F.lit(True))
    rows = rows.join(there, "dest", "left")
    if overwrite:
        return rows.select(*planned("move", F.col("src"), F.col("dest"), F.when(F.col("_there"), "overwrites")))
    return rows.select(*planned("move", F.col("src"), F.col("dest"), F.when(F.col("_there"), "exists"), F.when(F.col("_there"), "skipped").otherwise("planned")))


def rename_random(files: DataFrame, length: int = 12, seed: int = 0, extensions: list[str] | None = None) -> DataFrame:
    """Random names in the same folder, the extension kept."""
    rows = in_extensions(files, extensions)
    new = F.concat(random_name(F.col("path"), length, seed), suffix(filename("path")))
    wanted = rows.select(F.col("path").alias("src"), _joined(directory("path"), new).alias("dest"))
    return reserved(wanted, files).select(*planned("rename", F.col("src"), F.col("dest")))


def rename_by_parent(files: DataFrame, root: str) -> DataFrame:
    """root/A/B/x.jpg becomes A_B_1.jpg, root/A/x.jpg of an A without folders A_1.jpg; numbers follow the names. A file
    that has its name is skipped and still counts, a path that can't be short enough is an error."""
    base = root.rstrip("/")
    rows = files.filter(under("path", base)).withColumn("_below", relative_directory("path", base)).filter("_below <> ''")
    rows = rows.withColumn("_parts", F.split("_below", "/"))
    top = F.col("_parts")[0]
    nested = rows.groupBy(top.alias("_top")).agg(F.max(F.size("_parts")).alias("_deep"))
    rows = rows.withColumn("_top", top).join(nested, "_top").filter((F.size("_parts") == 2) | ((F.size("_parts") == 1) & (F.col("_deep") == 1)))
    index = F.row_number().over(W.partitionBy("_below").orderBy(filename("path")))
    # a column for each step, as an expression that is used in another several times grows with the power of the steps
    rows = rows.withColumns({"_index": index, "_name": filename("path"), "_sub": F.when(F.size("_parts") == 2, F.element_at("_parts", -1)).otherwise("")})
    rows = rows.withColumns({"_safe": sanitized("_top"), "_safe_sub": sanitized("_sub"), "_suffix": suffix("_name")})
    nested_name = parent_name(F.col("_safe"), F.col("_safe_sub"), F.col("_index"), F.col("_suffix"))
    name = F.when(F.col("_sub") == "", parent_name(F.lit(""), F.col("_safe"), F.col("_index"), F.col("_suffix"))).otherwise(nested_name)
    rows = rows.withColumn("_dest", _joined(directory("path"), name))
    rows = written(rows.select(F.col("path").alias("src"), "_dest"), "renames").select("src", shortened("_dest").alias("dest"))
    bad = rows.filter("dest is null").select(*planned("rename", F.col("src"), F.lit(None), F.lit("path too long"), F.lit("error")))
    same = rows.filter("dest = src").select(*planned("rename", F.col("src"), F.col("dest"), F.lit("already named so"), F.lit("skipped")))
    moving = rows.filter("dest <> src")
    free = reserved(moving, files).select(*planned("rename", F.col("src"), F.col("dest")))
    return free.unionByName(same).unionByName(bad)


def _top_level(files: DataFrame, root: str) -> DataFrame:
    return files.filter(directory("path") == (root.rstrip("/") or "/"))


def _into(files: DataFrame, root: str, folder: Column, op: str, reason: Column) -> DataFrame:
    """Files into folders below root, null folders skipped."""
    base = F.lit(root.rstrip("/"))
    rows = files.withColumn("_folder", folder).withColumn("_reason", reason.cast("string"))
    skipped = rows.filter("_folder is null").select(*planned(op, F.col("path"), F.lit(None), F.lit("no folder"), F.lit("skipped")))
    moving = rows.filter("_folder is not null").select(F.col("path").alias("src"), F.concat_ws("/", base, "_folder", filename("path")).alias("dest"), "_reason")
    return reserved(moving, files).select(*planned(op, F.col("src"), F.col("dest"), F.col("_reason"))).unionByName(skipped)


def sort_alphabetical(files: DataFrame, root: str) -> DataFrame:
    """All files at the top of root by their first character; others than letters and digits are skipped."""
    return _into(_top_level(files, root), root, alphabet_folder(filename("path")), "move", F.lit(None))


def sort_by_resolution(files: DataFrame, root: str, copy: bool = False) -> DataFrame:
    """files: path, width, height. Into class/orientation; files without a size are errors."""
    rows = _top_level(files, root)
    folder = F.concat_ws("/", resolution_class("width", "height"), orientation("width", "height"))
    bad = rows.filter("width is null or height is null").select(*planned("copy" if copy else "move", F.col("path"), F.lit(None), F.lit("no size"), F.lit("error")))
    return _into(rows.filter("width is not null and height is not null"), root, folder, "copy" if copy else "move", folder).unionByName(bad)


def sort_by_color(files: DataFrame, root: str, method: str = "dominant", copy: bool = False) -> DataFrame:
    """files: path and r, g, b (dominant), is_gray (bw) or colors (palette: array of structs r, g, b)."""
    rows = _top_level(in_extensions(files, SORTABLE_EXTENSIONS), root)
    if method == "bw":
        folder = F.when(F.col("is_gray"), "bw").otherwise("color")
    elif method == "dominant":
        folder = color_name("r", "g", "b")
    elif method == "palette":
        folder = palette_key("colors")
    else:
        raise ValueError(f"no colour sort by {method}")
    return _into(rows, root, folder, "copy" if copy else "move", folder)


def palette_key(colors: str) -> Column:
    """Distinct colour names of a palette in alphabetical order, joined by underscores."""
    return F.concat_ws("_", F.array_sort(F.array_distinct(F.transform(F.col(colors), lambda c: color_name(c["r"], c["g"], c["b"])))))


def color_counts(files: DataFrame) -> DataFrame:
    """How many files have each dominant colour name."""
    return files.groupBy(color_name("r", "g", "b").alias("color")).agg(F.count("*").alias("n"))


def palette_groups(files: DataFrame) -> DataFrame:
    return files.groupBy(palette_key("colors").alias("palette")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "palette")


def resolution_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(resolution_class("width", "height").alias("category"), orientation("width", "height").alias("orientation")).agg(F.count("*").alias("n"))


def fix_extensions(files: DataFrame) -> DataFrame:
    """files: path, format (as the bytes say). A file whose extension isn't one of its format's gets the preferred one."""
    fits = extension_fits("format", "path")
    rows = files.withColumn("_fits", fits)
    known = rows.filter("_fits is not null")
    good = known.filter("_fits").select(*planned("rename", F.col("path"), F.col("path"), F.lit("fits"), F.lit("skipped")))
    unknown = rows.filter("_fits is null").select(*planned("rename", F.col("path"), F.lit(None), F.lit("unknown format"), F.lit("skipped")))
    named = _joined(directory("path"), F.concat(stem(filename("path")), preferred_extension("format")))
    wrong = known.filter("not _fits").select(F.col("path").alias("src"), named.alias("dest"))
    return reserved(wrong, files).select(*planned("rename", F.col("src"), F.col("dest"))).unionByName(good).unionByName(unknown)


def convert_to_jpg(files: DataFrame, delete_originals: bool = False) -> DataFrame:
    """PNG, BMP and WEBP files next to themselves as JPG; an existing JPG of that name is kept."""
    rows = in_extensions(files, CONVERTIBLE_EXTENSIONS).select(F.col("path").alias("src"), _joined(directory("path"), F.concat(stem(filename("path")), F.lit(".jpg"))).alias("dest"))
    reason = F.lit("deletes the original") if delete_originals else None
    return reserved(rows, files).select(*planned("convert", F.col("src"), F.col("dest"), reason))


def empty_folders(folders: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Folders below root without a file anywhere below them, the deepest first; root itself stays. folders: path."""
    ancestors = files.select(F.split(directory("path"), "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("path"))
    live = ancestors.distinct()
    dead = folders.filter(under("path", root) & (F.col("path") != root.rstrip("/"))).select("path").distinct().join(live, "path", "left_anti")
    return dead.select(*planned("rmdir", F.col("path"), F.lit(None)), F.size(F.split("path", "/")).alias("depth")).orderBy(F.col("depth").desc(), "src")


def by_selections(members: DataFrame, selections: DataFrame) -> DataFrame:
    """members with rn by decisions: 2 for what is to be deleted, 1 for all else, also what nothing is said of. In a group of
    which all were to go, the best by score stays as it is: an action never empties a group. selections: path, decision."""
    marked = members.join(selections.select("path", (F.col("decision") == "delete").alias("_goes")), "path", "left").withColumn("_goes", F.coalesce("_goes", F.lit(False)))
    stays = marked.filter("not _goes").select("group_id").distinct().withColumn("_some", F.lit(True))
    chosen = F.when(F.col("_some"), F.when(F.col("_goes"), 2).otherwise(1)).otherwise(F.col("rn"))
    return marked.join(stays, "group_id", "left").withColumn("rn", chosen).drop("_goes", "_some")


def act_on_duplicates(members: DataFrame, action: str, trash: str | None = None, selections: DataFrame | None = None) -> DataFrame:
    """members: of groups.ranked(). Deletes, moves to trash, or links every member but the best to the best; with selections,
    every member that is to be deleted, links to the least kept path."""
    if action not in ("delete", "move", "hardlink", "symlink"):
        raise ValueError(f"no action {action}")
    if selections is not None:
        members = written(by_selections(members, selections), "selected")
    best = members.filter("rn = 1").groupBy("group_id").agg(F.min("path").alias("best"))
    extra = members.filter("rn > 1").join(best, "group_id")
    if action == "move":
        if not trash:
            raise ValueError("move needs a trash folder")
        rows = extra.select(F.col("path").alias("src"), F.concat(F.lit(trash.rstrip("/") + "/"), filename("path")).alias("dest"))
        return reserved(rows, members.sparkSession.createDataFrame([], "path string")).select(*planned("move", F.col("src"), F.col("dest")))
    return extra.select(*planned(action, F.col("path"), F.lit(None) if action == "delete" else F.col("best")))


def trash_selected(selections: DataFrame, root: str, trash: str, taken: DataFrame) -> DataFrame:
    """Paths that are to be deleted into the trash folder; paths outside root are refused."""
    chosen = selections.filter("decision = 'delete'").select("path").distinct()
    outside = chosen.filter(~under("path", root)).select(*planned("move", F.col("path"), F.lit(None), F.lit("outside the scanned folder"), F.lit("error")))
    inside = chosen.filter(under("path", root)).select(F.col("path").alias("src"), F.concat(F.lit(trash.rstrip("/") + "/"), filename("path")).alias("dest"))
    return reserved(inside, taken).select(*planned("move", F.col("src"), F.col("dest"))).unionByName(outside)


def plan_statistics(plan: DataFrame) -> DataFrame:
    return plan.groupBy("op", "status").agg(F.count("*").alias("n"))
