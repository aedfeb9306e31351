"""The engine as one object: scan, groups, selections, reports, actions, the cache, and the pipeline of operations.

Scans return lazy DataFrames. One scan runs at a time; cancelling ends its Spark jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checks
from .config import Config
from .operators import cache as c
from .operators import groups, reports, selection
from .plans import dates, execute, moves, repair
from .schema import DEFAULT_THRESHOLD
from .sources import analyze, files
from .state import History, Session
from .storage import shared_folder, written


class Cancelled(RuntimeError):
    """The scan was cancelled."""


@dataclass
class Scan:
    """assets: all rows; failed: those with an error; groups and members: of duplicates."""

    assets: DataFrame
    failed: DataFrame
    members: DataFrame
    selections: DataFrame

    def summary(self) -> DataFrame:
        return reports.scan_summary(self.members, self.assets)


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, cache: str | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.cache = c.Cache(spark, cache or f"{shared_folder(spark)}/analysis-cache")
        self.session = Session()
        self._one = threading.Lock()
        self._group = ""

    # Scans

    def scan(self, root: str, threshold: int = DEFAULT_THRESHOLD, exact_only: bool = False, perceptual_only: bool = False, recursive: bool = True, use_cache: bool = True, use_index: bool | None = None, strategy: str = "quality", link_exact: bool = False, target_recall: float | None = None, resolve: bool = False) -> Scan:
        wrong = checks.scan(root, threshold, exact_only, perceptual_only)
        if wrong:
            raise ValueError("; ".join(wrong))
        if not self._one.acquire(blocking=False):
            raise RuntimeError("a scan is running")
        self._group = f"scan-{uuid.uuid4().hex}"
        self.session.reset()
        self.session.directory = root
        self.session.settings |= {"threshold": threshold, "exact_only": exact_only, "perceptual_only": perceptual_only, "recursive": recursive, "strategy": strategy}
        self.spark.sparkContext.setJobGroup(self._group, f"scan of {root}", interruptOnCancel=True)
        try:
            return self._scan(root, threshold, exact_only, perceptual_only, recursive, use_cache, use_index, strategy, link_exact, target_recall, resolve)
        except PySparkException as e:
            if not self.session.cancel_requested:
                self.session.status, self.session.message = "error", str(e)[:500]
                raise
            self.session.status = "cancelled"
            raise Cancelled from e
        except Cancelled:
            self.session.status = "cancelled"
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self._one.release()

    def _at(self, status: str, progress: int) -> None:
        while self.session.paused and not self.session.cancel_requested:
            time.sleep(0.2)
        if self.session.cancel_requested:
            raise Cancelled
        self.session.status, self.session.progress = status, progress

    def _scan(self, root, threshold, exact_only, perceptual_only, recursive, use_cache, use_index, strategy, link_exact, target_recall, resolve) -> Scan:
        began = time.time()
        self._at("scanning", 0)
        found = files.images(self.spark, root, recursive)
        listing = written(files.resolved(written(found, "found")) if resolve else found, "listing")
        self._at("analyzing", 20)
        rows = self.analyzed(root, listing, recursive, use_cache, not exact_only, resolve)
        self._at("comparing", 60)
        good = written(groups.valid_assets(rows), "valid")
        parts = []
        if not perceptual_only:
            parts.append(written(groups.exact_groups(good), "exact"))
        if not exact_only:
            last = parts[0].agg(F.coalesce(F.max("group_id"), F.lit(0))).first()[0] if parts else 0
            near = good if parts else good.withColumn("file_hash", F.lit(None).cast("string"))
            parts.append(groups.perceptual_groups(near, threshold, start_id=last + 1, use_index=use_index, link_exact=link_exact, target_recall=target_recall))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        members = written(groups.ranked(written(found, "groups"), good), "ranked")
        self.cache.record_scan(root, rows.count(), time.time() - began)
        self._at("complete", 100)
        return Scan(rows, groups.failed_assets(rows), members, selection.select(members, strategy))

    def analyzed(self, root: str, listing: DataFrame, recursive: bool = True, use_cache: bool = True, perceptual: bool = True, some: bool = False) -> DataFrame:
        """Rows of all files: the cache's for those that haven't changed, new ones for the others. some: there are other images
        than those of the listing."""
        of = files.images(self.spark, root, recursive).count() if some else listing.count()
        if not use_cache:
            return written(analyze.analyze(files.contents_of(self.spark, root, listing.select("path"), of, recursive), perceptual).drop("corruption_type"), "analyzed")
        looked = c.lookup(listing, self.cache.read())
        known = looked.filter("hit" if not perceptual else "hit and (perceptual_hash is not null or error is not null or format not in ('PNG', 'BMP', 'PPM'))")
        known = written(known.select(*[x for x in looked.columns if x != "hit"]), "known")
        missing = written(listing.select("path").join(known.select("path"), "path", "left_anti"), "missing", narrow=True)
        new = files.contents_of(self.spark, root, missing, of, recursive)
        fresh = written(analyze.analyze(new, perceptual).drop("corruption_type"), "analyzed")
        if fresh.limit(1).count():
            self.cache.put(fresh)
        return written(known.select(*fresh.columns).unionByName(fresh), "assets")

    def cancel(self) -> None:
        self.session.cancel()
        if self._group:
            self.spark.sparkContext.cancelJobGroup(self._group)

    def pause(self) -> None:
        self.session.pause()

    def resume(self) -> None:
        self.session.pause(False)

    def progress(self, every: float = 0.5) -> Iterator[dict]:
        """The session's status again and again until it has ended."""
        while True:
            yield self.session.status_view()
            if self.session.status in ("complete", "cancelled", "error"):
                return
            time.sleep(every)

    # Views

    def select(self, scan: Scan, strategy: str) -> DataFrame:
        return selection.select(scan.members, strategy)

    def groups(self, scan: Scan, match_type: str = "all", text: str = "", by: str = "savings", page: int = 1) -> DataFrame:
        return reports.page(groups.group_summary(reports.filtered(scan.members, match_type, text)), page, by)

    def export(self, scan: Scan, path: str, fmt: str = "txt") -> None:
        if fmt == "txt":
            reports.export_txt(scan.members, path, scan.failed)
        else:
            reports.export(scan.members, path, fmt)

    def history(self) -> History:
        return History(self.config.path("history"), int(self.config.get("history_length")))

    # Actions

    def selections(self, scan: Scan) -> DataFrame:
        """path and decision: those of the scan's strategy, and of the session where the user has chosen otherwise."""
        own = self.spark.createDataFrame(list(self.session.selections.items()), "path string, _own string")
        return scan.selections.join(own, "path", "left").select("path", F.coalesce("_own", "decision").alias("decision"))

    def act(self, scan: Scan, action: str, trash: str | None = None, dry_run: bool = True) -> DataFrame:
        """Acts on what the selections say is to be deleted."""
        return execute.execute(moves.act_on_duplicates(scan.members, action, trash, self.selections(scan)), dry_run)

    def listing(self, root: str, recursive: bool = True) -> DataFrame:
        return written(files.files(self.spark, root, None, recursive), "listing")

    def run(self, plan: DataFrame, dry_run: bool = True, quality: int = 95) -> DataFrame:
        return execute.execute(plan, dry_run, checks.clamped(quality, 1, 100))

    def clean_folders(self, root: str, dry_run: bool = True) -> DataFrame:
        """Empty folders below root; a tree without a file is one too."""
        listing = self.listing(root) if _has_files(root) else self.spark.createDataFrame([], "path string, mtime double, file_size long")
        return execute.remove_folders(moves.empty_folders(files.folders(self.spark, root), listing, root), dry_run)

    def repair(self, root: str, trash: str, attempt: bool = True, quarantine: bool = True, dry_run: bool = True) -> DataFrame:
        """A decision for each image; what can be is repaired and the rest moved, unless it is a dry run, which changes
        nothing."""
        found = repair.outside_trash(files.images(self.spark, root), trash)
        decided = written(repair.decide(execute.inspect(found, repair=attempt and not dry_run), attempt, quarantine), "decided")
        execute.quarantine(decided, trash, dry_run)
        return decided

    def pipeline(self, root: str, steps: list[str], start: datetime | None = None, end: datetime | None = None, name_length: int = 12, jpg_quality: int = 95, delete_originals: bool = False, trash: str | None = None, dry_run: bool = True, seed: int = 0) -> dict[str, DataFrame]:
        """The outcome of each step, in order. Nothing is done if a step or the dates are wrong."""
        wrong = checks.pipeline(steps, start, end)
        if wrong:
            raise ValueError("; ".join(wrong))
        run = {
            "random_rename": lambda: self.run(moves.rename_random(files.images(self.spark, root), name_length, seed), dry_run),
            "convert_jpg": lambda: self.run(moves.convert_to_jpg(self.listing(root), delete_originals), dry_run, jpg_quality),
            "randomize_exif": lambda: execute.set_exif_dates(dates.randomize_exif_dates(self.listing(root), start, end, seed), dry_run),
            "randomize_dates": lambda: execute.set_times(dates.randomize_dates(self.listing(root), start, end, seed), dry_run),
            "cleanup_empty": lambda: self.clean_folders(root, dry_run),
            "repair_corrupt": lambda: self.repair(root, trash or str(self.config.path("trash")), dry_run=dry_run),
        }
        return {s: run[s]() for s in steps}


def _has_files(root: str) -> bool:
    import os

    return any(names for _, _, names in os.walk(root))
