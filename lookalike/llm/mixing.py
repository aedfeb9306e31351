"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each source gets a share of all words by its weight, at most so many times its own size; what that leaves is shared again
by weight among the others. A source whose target exceeds its size goes in whole as often as it fits (complete epochs); the
rest is a sample without replacement: documents have exponential keys -ln(u) / quality, u drawn from a digest of the id,
and are taken in ascending order while the prefix sum of their sizes stays nearest to the rest.

The order within a source is never sorted as a whole. A histogram of key ranges finds the range in which the sum crosses
the budget, a second one refines that range, and only the rows of the last range are sorted; both histograms are combined
before they are shuffled, so that a source with most of the rows is no burden. What remains per source is one threshold.

Defined cases: null texts have size 0; a null source is a source of its own, the last one; sources of size 0 have target 0;
rows of equal key and id are in the order of their texts' digests. Reruns agree as nothing but the rows counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

#: Key ranges of each of the two histograms.
RANGES = 1024
WEIGHTS = (5, 2, 1)
MOST = 3
#: Characters whose share makes a document count less, and how much.
SYMBOLS = "!#$%&*|"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """1 without SYMBOLS, 1/11 of symbols alone."""
    whole = F.length(F.col(text))
    kept = F.length(F.translate(F.col(text), SYMBOLS, ""))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * (whole - kept) / F.greatest(whole, F.lit(1))), F.lit(1.0))


def sample_key(key: str, quality: Column, seed: str = "mix") -> Column:
    """Exponential with the quality as its rate."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"-{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def text_digest(text: str) -> Column:
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("_digest")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds target. The windows run over the sources, not over their documents."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    everything = W.partitionBy()
    rows = sizes.withColumn("_weight", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    order = W.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) if share == 1.0 else F.floor(F.sum("source_size").over(everything) * share)
    rows = rows.withColumns(
        {
            "_rank": F.row_number().over(order),
            "_left": budget - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_heft": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)),
        }
    )
    free = F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_heft")
    chosen = F.min(F.when(free, F.struct("_rank", "_left", "_heft"))).over(everything)
    rows = rows.withColumn("_first", chosen)
    target = F.when(F.col("_first").isNull() | (F.col("_rank") < F.col("_first._rank")), F.col("_cap").cast("double")).otherwise((F.col("_first._left") * F.col("_weight")).cast("double") / F.col("_first._heft"))
    return rows.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """For each row of docs: key, source, size, source_size, target, copies (how often the mix takes it) and _digest (of
    its text, to tell rows of one id apart)."""
    quality = quality_weight(text) if quality is None else quality
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).alias("source"), n_words(text).alias("size"), sample_key(key, quality).alias("at"), text_digest(text).alias("_digest"))
    return plan_rows(stash(rows, "mix-rows"), key, weights, share, most)


def plan_rows(rows: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """The plan of rows that are written down: id, source, size, at (a sample_key) and _digest."""
    place = F.col("at") / (1 + F.col("at"))  # from 0 to 1, in the order of the keys
    fine = F.least(F.floor(place * RANGES * RANGES).cast("long"), F.lit(RANGES * RANGES - 1))
    rows = rows.withColumn("_fine", fine).withColumn("_range", F.floor(F.col("_fine") / RANGES).cast("long"))

    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") >= most, F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
    sources = stash(sources, "mix-sources", narrow=True)

    def crossing(part: DataFrame, budgets: DataFrame, column: str, left: str) -> DataFrame:
        """The range in which each source's sum crosses its budget, and what is left of the budget there."""
        histogram = part.groupBy("source", column).agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(W.partitionBy("source").orderBy(column))
        sums = histogram.withColumn("upto", upto).alias("h").join(budgets.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source")))
        over = F.when(F.col("upto") >= F.col(f"b.{left}"), F.struct(F.col(f"h.{column}").alias("range"), (F.col(f"b.{left}") - (F.col("upto") - F.col("s"))).alias("left")))
        found = sums.groupBy(F.col("b.source").alias("source")).agg(F.min(over).alias("c"))
        return found.select("source", F.col("c.range").alias(f"{column}_cut"), F.col("c.left").alias(f"{column}_left"))

    wanted = sources.filter(F.col("rest") > 0)
    first = stash(crossing(rows, wanted, "_range", "rest"), "mix-cut", narrow=True).filter("_range_cut is not null")
    inner = rows.alias("r").join(first.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r._range") == F.col("f._range_cut"))).select("r.*")
    second = stash(crossing(inner, first, "_fine", "_range_left"), "mix-cut", narrow=True).filter("_fine_cut is not null")
    last = rows.alias("r").join(second.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r._fine") == F.col("f._fine_cut"))).select("r.*", "f._fine_left")
    order = W.partitionBy("source").orderBy("at", F.col("id").asc_nulls_first(), "_digest")
    upto = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    last = last.withColumn("_upto", upto)
    near = F.col("_fine_left") - (F.col("_upto") - F.col("size")) > F.col("size") / 2
    ends = last.filter(near).groupBy("source").agg(F.max(F.struct("at", F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "_digest")).alias("end"))
    cuts = second.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select("s.source", "_fine_cut", "end")
    whole = sources.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "c._fine_cut", "c.end")
    whole = stash(whole, "mix-plan", narrow=True)

    mine = F.struct("at", F.coalesce(F.col("r.id"), F.lit(-(1 << 63))).alias("id"), "_digest")
    inside = F.coalesce((F.col("_fine") < F.col("_fine_cut")) | ((F.col("_fine") == F.col("_fine_cut")) & F.coalesce(mine <= F.col("end"), F.lit(False))), F.lit(False))
    joined = rows.alias("r").join(whole.alias("w"), F.col("r.source").eqNullSafe(F.col("w.source")))
    return joined.select(F.col("r.id").alias(key), F.col("r.source").alias("source"), "size", "source_size", "target", (F.col("epochs") + inside.cast("long")).alias("copies"), "_digest")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", planned: DataFrame | None = None, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. planned: the rows of a plan that is made already."""
    planned = plan(docs, key, text, source, **options) if planned is None else planned
    rows = planned.filter("copies > 0").groupBy(F.col(key).alias("_id"), "_digest").agg(F.max("copies").alias("_copies"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).cast("long").alias("_own"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("_text"))
    taken = packed.join(rows, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_digest")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select("_row.*")
