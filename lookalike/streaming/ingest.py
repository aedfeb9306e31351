"""A stream of files into the cache: each micro-batch looks up what is known, analyses the rest, and writes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache as c
from ..sources.analyze import analyze
from ..storage import written


class Totals:
    """Running counts of a stream."""

    def __init__(self) -> None:
        self.discovered = self.hits = self.analyzed = self.errors = 0


def ingest(files: DataFrame, store: c.Cache, checkpoint: str, perceptual: bool = True, hashes: bool = True, on_batch: Callable[[Totals], None] | None = None, once: bool = True) -> tuple[StreamingQuery, Totals]:
    """files: a stream with path, mtime, file_size and content. A replayed batch finds its own rows in the cache, so it
    writes them once. once: ends when the files that are there have been taken."""
    totals = Totals()

    def step(batch: DataFrame, _: int) -> None:
        known = written(c.lookup(batch.drop("content"), store.read()).select("path", "cache_key", "hit"), "looked-up")
        new = batch.join(known.filter("not hit").select("path"), "path", "left_semi")
        rows = written(analyze(new, perceptual, hashes), "analyzed")
        counted = known.groupBy("hit").count().collect()
        hits = sum(r["count"] for r in counted if r["hit"])
        totals.discovered += sum(r["count"] for r in counted)
        totals.hits += hits
        totals.analyzed += rows.count()
        totals.errors += rows.filter("error is not null").count()
        if hits:
            store.touch(known.filter("hit"))
        store.put(rows.drop("corruption_type"))
        if on_batch:
            on_batch(totals)

    writer = files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(), totals
