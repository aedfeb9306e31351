"""The queries of the engine's own operators over the driver's tables, each with the SQL that returns the same rows.

The tables hold no images: documents stand for files (their text's SHA-256 is the content hash, SimHash-256 of their tokens
the signature, sizes and dates follow from their ids), embeddings for signatures of 64 bits, events for cache accesses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.signatures import sign_bits, simhash
from .operators import cache, groups, index, reports, selection
from .plans import moves, repair
from .sources import analyze, files
from .schema import ALPHABET_FOLDERS, INDEX_TIERS, RESERVED_NAMES, RESOLUTION_CLASSES
from .storage import written
from .streaming.windows import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Names of the CTEs that a query's SQL begins with.
_WITH: dict[str, str] = {}


def query(sql: str | None = None, *uses: str):
    """Registers a function q_<name> with its SQL; uses: the CTEs before it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = ", ".join(f"{n} as ({_WITH[n]})" for n in uses)
            recursive = "recursive " if "cc" in uses else ""
            ORACLES[f.__name__] = f"with {recursive}{parts} {sql}" if parts else sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The files that documents stand for

_EXTENSIONS = [".jpg", ".png", ".webp", ".tiff", ".cr2"]
_RANKS = [60, 85, 75, 90, 100]


def _by_id(values: list, id_: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(id_), F.lit(len(values))) + 1).cast("int"))


def assets(spark: SparkSession, sf_dir: str, signatures: bool = False) -> DataFrame:
    """Texts become hashes and signatures before the join, which so shuffles no text, at any size."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = docs.select(
        "doc_id",
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), _by_id(_EXTENSIONS)).alias("path"),
        (F.col("n_chars") * 1024).cast("bigint").alias("file_size"),
        (F.lit(320) + F.col("doc_id") * 37 % 7680).cast("int").alias("width"),
        (F.lit(240) + F.col("doc_id") * 53 % 4320).cast("int").alias("height"),
        F.lit(24).alias("bit_depth"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        (F.lit(1600000000) + F.col("doc_id") * 7919 % 1000003).cast("double").alias("mtime"),
        (F.col("doc_id") * 41 % 256).cast("int").alias("r"),
        (F.col("doc_id") * 67 % 256).cast("int").alias("g"),
        (F.col("doc_id") * 101 % 256).cast("int").alias("b"),
        *([simhash("text").alias("perceptual_hash")] if signatures else []),
    )
    rows = rows.withColumn("pixel_count", F.col("width").cast("bigint") * F.col("height")).withColumn("quality_score", S.quality_score())
    error = F.when(F.col("toxic") == 1, "image file is truncated")
    return rows.join(labels.hint("merge"), "doc_id", "left").withColumn("error", error).drop("toxic")


def _case(expr: str, values: list) -> str:
    return f"case {expr} " + " ".join(f"when {i} then {v!r}" for i, v in enumerate(values)) + " end"


_WITH["files"] = f"""
select d.doc_id, '/lib/' || source || '/' || lang || '/' || d.doc_id::varchar || {_case("d.doc_id % 5", _EXTENSIONS)} as path,
  (n_chars * 1024)::bigint file_size, (320 + d.doc_id * 37 % 7680)::int width, (240 + d.doc_id * 53 % 4320)::int height, 24 bit_depth,
  sha256(text) file_hash, (1600000000 + d.doc_id * 7919 % 1000003)::double mtime, case when toxic = 1 then 'image file is truncated' end error,
  (d.doc_id * 41 % 256)::int r, (d.doc_id * 67 % 256)::int g, (d.doc_id * 101 % 256)::int b, {_case("d.doc_id % 5", _RANKS)} rank, text
from documents d left join labels l on d.doc_id = l.doc_id"""
_WITH["assets"] = """
select *, width::bigint * height pixel_count,
  case when width::bigint * height > 0 then least(50.0::double, (width::bigint * height) / 1000000.0::double * 2.0::double) else 0.0::double end
  + case when file_size > 0 then least(30.0::double, file_size / 1048576.0::double * 3.0::double) else 0.0::double end
  + least(10.0::double, bit_depth / 3.2::double) + rank / 5.0::double quality_score
from files"""
_WITH["exact"] = """
select dense_rank() over (order by first) group_id, 'exact' match_type, path, file_hash
from (select path, file_hash, min(path) over (partition by file_hash) first, count(*) over (partition by file_hash) n from assets) where n > 1"""
_WITH["members"] = """
select e.group_id, e.match_type, a.*, row_number() over (partition by e.group_id order by quality_score desc, a.path) rn
from exact e join assets a on e.path = a.path"""
_EXACT = ("files", "assets", "exact")
_MEMBERS = (*_EXACT, "members")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(assets(spark, sf_dir), "assets")
    return groups.ranked(groups.exact_groups(rows), rows)


# Exact duplicates


@query("select group_id::bigint group_id, match_type, path, file_hash from exact", *_EXACT)
def q_exact_groups(spark, sf_dir):
    rows = written(assets(spark, sf_dir).select("path", "file_hash"), "assets")
    return groups.exact_groups(rows).join(rows, "path").select("group_id", "match_type", "path", "file_hash")


@query("select group_id::bigint group_id, max(case when rn = 1 then path end) best_path, count(*)::bigint image_count, coalesce(sum(case when rn > 1 then file_size end), 0)::bigint potential_savings from members group by group_id", *_MEMBERS)
def q_best_per_group(spark, sf_dir):
    return groups.group_summary(members(spark, sf_dir)).select("group_id", "best_path", "image_count", "potential_savings")


@query("select count(case when rn > 1 then 1 end)::bigint total_duplicates, count(case when rn = 1 then 1 end)::bigint total_groups, coalesce(sum(case when rn > 1 then file_size end), 0)::bigint total_waste from members", *_MEMBERS)
def q_potential_savings(spark, sf_dir):
    return reports.statistics(members(spark, sf_dir))


@query("select group_id::bigint group_id, path, quality_score from members where rn > 1", *_MEMBERS)
def q_duplicates(spark, sf_dir):
    return groups.duplicates(members(spark, sf_dir)).select("group_id", "path", "quality_score")


@query("select path from assets a where not exists (select 1 from exact e where e.file_hash = a.file_hash)", *_EXACT)
def q_exclude_exact(spark, sf_dir):
    return groups.perceptual_candidates(assets(spark, sf_dir).withColumn("perceptual_hash", F.col("file_hash"))).select("path")


@query("select count(*)::bigint images, count(error)::bigint errors from assets", "files", "assets")
def q_valid_and_failed(spark, sf_dir):
    rows = assets(spark, sf_dir)
    return groups.valid_assets(rows).select(F.lit(0).alias("e")).unionByName(groups.failed_assets(rows).select(F.lit(1).alias("e"))).agg(F.count("*").alias("images"), F.sum("e").cast("bigint").alias("errors"))


# Projections and scalars


@query("select path, quality_score from assets", "files", "assets")
def q_quality_score(spark, sf_dir):
    return assets(spark, sf_dir).select("path", "quality_score")


@query(
    "select path, parse_filename(path) filename, regexp_extract(path, '^(.*)/[^/]*$', 1) directory, regexp_extract(path, '([.][^.]*)$', 1) extension, "
    "width::varchar || 'x' || height::varchar resolution, path || ':' || mtime::bigint::varchar || ':' || file_size::varchar cache_key from assets",
    "files",
    "assets",
)
def q_projections(spark, sf_dir):
    rows = assets(spark, sf_dir)
    return rows.select("path", S.filename("path").alias("filename"), S.directory("path").alias("directory"), S.extension("path").alias("extension"), S.resolution("width", "height").alias("resolution"), S.cache_key("path", F.col("mtime").cast("bigint"), "file_size").alias("cache_key"))


_COLOR = """
case when (case when greatest(r, g, b) = 0 then 0 else (greatest(r, g, b) - least(r, g, b))::double / greatest(r, g, b) end) < 0.15::double
  then case when (r + g + b)::double / 3 < 50 then 'black' when (r + g + b)::double / 3 < 128 then 'gray' else 'white' end
when r > g and r > b then case when g > b * 1.5::double then case when r > g * 1.2::double then 'orange' else 'yellow' end when r > b * 1.5::double then 'red' else 'pink' end
when g > r and g > b then case when r > b * 1.5::double then 'yellow' when b > r * 1.3::double then 'cyan' else 'green' end
when b > r and b > g then case when r > g * 1.3::double then 'purple' when g > r * 1.3::double then 'cyan' else 'blue' end
else 'brown' end"""


@query(f"select path, {_COLOR} color from files", "files")
def q_color_names(spark, sf_dir):
    return assets(spark, sf_dir).select("path", S.color_name("r", "g", "b").alias("color"))


@query(f"select {_COLOR} color, count(*)::bigint n from files group by 1", "files")
def q_color_counts(spark, sf_dir):
    return moves.color_counts(assets(spark, sf_dir))


_CLASS = "case " + " ".join(f"when greatest(width, height) >= {least} then '{name}'" for name, least in RESOLUTION_CLASSES) + " else 'unknown' end"
_TURN = "case when height = 0 then 'landscape' when width::double / height between 0.95::double and 1.05::double then 'square' when width > height then 'landscape' else 'portrait' end"


@query(f"select {_CLASS} category, {_TURN} orientation, count(*)::bigint n from files group by 1, 2", "files")
def q_resolution_counts(spark, sf_dir):
    return moves.resolution_counts(assets(spark, sf_dir))


def _alphabet(column: str) -> str:
    return "case " + " ".join(f"when upper(substr({column}, 1, 1)) between '{a}' and '{z}' then '{name}'" for name, a, z in ALPHABET_FOLDERS) + " end"


@query(f"select {_alphabet('name')} folder, count(*)::bigint n from (select p_name as name from part union all select c_name from customer union all select s_name from supplier) group by 1")
def q_alphabet_counts(spark, sf_dir):
    names = [_table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("part", "p_name"), ("customer", "c_name"), ("supplier", "s_name"))]
    return names[0].unionByName(names[1]).unionByName(names[2]).groupBy(S.alphabet_folder("name").alias("folder")).agg(F.count("*").alias("n"))


_RESERVED = ", ".join(f"'{n}'" for n in RESERVED_NAMES)


@query(f"""
select page_id, case when x = '' then 'unnamed' else x end clean, length(url)::int length from (
  select page_id, url, trim(case when upper(case when regexp_matches(c, '(?s)^[.]*[^.].*[.][^.]+$') then regexp_extract(c, '(?s)^(.*)[.][^.]+$', 1) else c end) in ({_RESERVED}) then '_' || c else c end, ' .') x
  from (select page_id, url, regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') c from pages))""")
def q_sanitized_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", S.sanitized("url").alias("clean"), F.length("url").alias("length"))


@query("select o_orderkey, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') exif_time, strftime(o_orderdate, '%Y-%m-%d') as day, true parses from orders")
def q_exif_times(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return rows.select("o_orderkey", S.exif_time("o_orderdate").alias("exif_time"), day.alias("day"), S.parsed_date(day).isNotNull().alias("parses"))


@query("select doc_id, case when regexp_matches(lower(text), 'truncat|premature|eof|unexpected end') then 'truncated' when regexp_matches(lower(text), 'exif|ifd|tag|tiff') then 'bad_exif' else 'unknown' end kind from documents")
def q_corruption_kinds(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.corruption_of("text").alias("kind"))


# Signatures and near duplicates

_WITH["vectors"] = "select vec_id id, embedding, list_transform(range(1, 65), lambda p: case when embedding[p] > 0 then 1 else 0 end) bits from embeddings"
_WITH["sims"] = """
select doc_id id, list(bit order by p) bits from (
  select doc_id, p, (sum(b) > 0)::int bit from (select distinct doc_id, unnest(string_split(lower(text), ' ')) w from documents) tok
  join (select w, p, case when ((instr('0123456789abcdef', substr(h, (p // 4 + 1)::int, 1)) - 1) >> (3 - (p % 4))::int) & 1 = 1 then 1 else -1 end b
    from (select w, sha256(w) h from (select distinct unnest(string_split(lower(text), ' ')) w from documents)), (select range p from range(256))) using (w)
  group by 1, 2) group by 1"""
_HEX = "array_to_string(list_transform(range({n}), lambda k: substr('0123456789abcdef', (bits[4 * k + 1] * 8 + bits[4 * k + 2] * 4 + bits[4 * k + 3] * 2 + bits[4 * k + 4] + 1)::int, 1)), '')"


def vector_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_bits("embedding").alias("signature"))


def text_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written down, as a filter on a Python column would have it made twice."""
    return written(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), simhash("text").alias("signature")), "signatures")


@query(f"select id, {_HEX.format(n=16)} signature from vectors", "vectors")
def q_sign_signatures(spark, sf_dir):
    return vector_signatures(spark, sf_dir)


@query(f"select id, {_HEX.format(n=64)} signature from sims", "sims")
def q_simhash_signatures(spark, sf_dir):
    return text_signatures(spark, sf_dir)


_APART = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: (z[1] <> z[2])::int))::int"


@query(f"select a.id id1, b.id id2, {_APART} distance from vectors a join vectors b on a.id < b.id where {_APART} <= 18", "vectors")
def q_hamming_pairs(spark, sf_dir):
    return index.all_pairs(written(vector_signatures(spark, sf_dir), "vectors"), 18, 64)


@query(f"select count(*)::bigint exact_pairs, true met from vectors a join vectors b on a.id < b.id where {_APART} <= 18", "vectors")
def q_index_recall(spark, sf_dir):
    """The pairs of the search by all pairs, and whether the index finds 9 of 10 of them at least."""
    rows = written(vector_signatures(spark, sf_dir), "vectors")
    exact, found = index.all_pairs(rows, 18, 64), index.near_pairs(rows, 18, 64, use_index=True).select("id1", "id2", F.lit(1).alias("hit"))
    return exact.join(found, ["id1", "id2"], "left").agg(F.count("*").alias("exact_pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("met"))


_TABLES, _BITS = INDEX_TIERS[0][1:]
#: A distance at which the test tables have near copies: an edit changes more of a short text than of a picture.
_NEAR_AT = 32


def _keys(hash_bits: int, tables: int, bits: int) -> str:
    parts = [f"select {t} table_id, id, bits, (" + " + ".join(f"bits[{p + 1}]::bigint * {1 << (bits - 1 - k)}" for k, p in enumerate(places)) + ")::bigint bucket_key from sims" for t, places in enumerate(index.positions(tables, bits, hash_bits))]
    return " union all ".join(parts)


_WITH["buckets"] = _keys(256, _TABLES, _BITS)
_WITH["reps"] = "select min(id) id, bits from sims group by bits"


@query("select table_id, bucket_key, id from buckets", "sims", "buckets")
def q_index_buckets(spark, sf_dir):
    return index.buckets(text_signatures(spark, sf_dir), _TABLES, _BITS).select("table_id", "bucket_key", "id")


@query("select count(*)::bigint buckets, avg(n) avg_bucket_size, max(n)::bigint max_bucket_size, stddev_pop(n) / avg(n) > 1 uneven from (select count(*) n from buckets group by table_id, bucket_key)", "sims", "buckets")
def q_index_statistics(spark, sf_dir):
    return index.index_statistics(index.buckets(text_signatures(spark, sf_dir), _TABLES, _BITS)).drop("cv")


@query("select coalesce(sum(n * (n - 1) // 2), 0)::bigint candidate_pairs from (select count(*) n from buckets group by table_id, bucket_key)", "sims", "buckets")
def q_pair_estimate(spark, sf_dir):
    return index.pair_estimate(index.buckets(text_signatures(spark, sf_dir), _TABLES, _BITS))


_WITH["pairs"] = f"select id1, id2, distance from (select distinct a.id id1, b.id id2, {_APART} distance from buckets a join buckets b on a.table_id = b.table_id and a.bucket_key = b.bucket_key and a.id < b.id join reps ra on ra.id = a.id join reps rb on rb.id = b.id) where distance <= {_NEAR_AT}"


@query("select id1, id2, distance from pairs", "sims", "buckets", "reps", "pairs")
def q_index_pairs(spark, sf_dir):
    """Between representatives of equal signatures."""
    reps, _ = index.representatives(text_signatures(spark, sf_dir))
    return index.indexed_pairs(written(reps, "representatives"), _NEAR_AT, _TABLES, _BITS)


@query("select s.id, r.id rep from sims s join reps r on s.bits = r.bits", "sims", "reps")
def q_signature_classes(spark, sf_dir):
    return index.representatives(text_signatures(spark, sf_dir))[1]


@query("select distinct a.id query_id, b.id id from buckets a join buckets b on a.table_id = b.table_id and a.bucket_key = b.bucket_key and a.id <> b.id where a.id % 100 = 0", "sims", "buckets")
def q_index_candidates(spark, sf_dir):
    """The search takes as queries the ids that 100 divides, against all rows."""
    rows = text_signatures(spark, sf_dir)
    return index.candidates_of(rows.filter("id % 100 = 0"), rows, _TABLES, _BITS)


_WITH["signed"] = "select a.path, s.bits from assets a join sims s on a.doc_id = s.id where not exists (select 1 from exact e where e.file_hash = a.file_hash)"
_WITH["near"] = f"select a.path u, b.path v from signed a join signed b on a.path < b.path where {_APART} <= {_NEAR_AT}"
_WITH["edges"] = "select u, v from near union all select v, u from near"
_WITH["cc"] = "select u node, u label from edges union select b.v, cc.label from cc join edges b on cc.node = b.u"
_WITH["perceptual"] = "select dense_rank() over (order by component) rank, node path from (select node, min(label) component from cc group by node)"
_NEAR = (*_EXACT, "sims", "signed", "near", "edges", "cc", "perceptual")


@query("select rank::bigint group_id, 'perceptual' match_type, path from perceptual", *_NEAR)
def q_perceptual_groups(spark, sf_dir):
    return groups.perceptual_groups(written(assets(spark, sf_dir, True), "assets"), _NEAR_AT, use_index=False)


@query(f"select a.rank::bigint group_id, max({_APART.replace('a.bits', 'x.bits').replace('b.bits', 'y.bits')})::bigint radius from perceptual a join (select rank, min(path) first from perceptual group by rank) f on a.rank = f.rank join signed x on x.path = a.path join signed y on y.path = f.first group by 1", *_NEAR)
def q_group_radius(spark, sf_dir):
    """How far members are from the first of their group; single linkage bounds only neighbours' distances."""
    rows = written(assets(spark, sf_dir, True), "assets")
    found = groups.spread(groups.perceptual_groups(rows, _NEAR_AT, use_index=False), rows)
    return found.select("group_id", F.col("radius").cast("bigint").alias("radius"))


@query("select group_id::bigint group_id, match_type, path from exact union all select rank + (select max(group_id) from exact), 'perceptual', path from perceptual", *_NEAR)
def q_all_groups(spark, sf_dir):
    """With the index, at a recall that leaves no pair out."""
    return groups.all_groups(written(assets(spark, sf_dir, True), "assets"), _NEAR_AT, use_index=True, target_recall=1 - 1e-9)


_SIZES = "(values (500), (5000), (20000), (100000), (300000), (650000), (10000000)) t(n)"


@query(f"select n::bigint n, case when n < 10000 then 15 when n < 50000 then 18 when n < 200000 then 20 when n < 500000 then 25 else 30 end::int tables, case when n < 10000 then 20 when n < 50000 then 18 when n < 200000 then 16 when n < 500000 then 14 else 12 end::int bits from {_SIZES}")
def q_index_tiers(spark, sf_dir):
    return spark.createDataFrame([(n, *index.tier(n)) for n in (500, 5000, 20000, 100000, 300000, 650000, 10000000)], "n long, tables int, bits int")


@query(f"select n::bigint n, (n::bigint * (n - 1) // 2)::bigint brute_force, floor(n * least(n - 1, greatest(0.0::double, n / 65536.0::double - 1) * 20 * 0.7::double) / 2)::bigint compared from {_SIZES}")
def q_reduction_estimate(spark, sf_dir):
    found = [(n, index.estimate(n)) for n in (500, 5000, 20000, 100000, 300000, 650000, 10000000)]
    return spark.createDataFrame([(n, e["brute_force_comparisons"], e["estimated_lsh_comparisons"]) for n, e in found], "n long, brute_force long, compared long")


# Selection, reports and views


def _strategy(name: str, order: str) -> None:
    @query(f"select path, case when row_number() over (partition by group_id order by {order}, path) = 1 then 'keep' else 'delete' end decision from members", *_MEMBERS)
    def q(spark, sf_dir):
        return selection.select(members(spark, sf_dir), name)

    QUERIES[f"q_select_{name}"], ORACLES[f"q_select_{name}"] = QUERIES.pop("q"), ORACLES.pop("q")


for _name, _order in (("quality", "quality_score desc"), ("largest", "file_size desc"), ("smallest", "file_size"), ("newest", "mtime desc"), ("oldest", "mtime")):
    _strategy(_name, _order)


@query("select count(*)::bigint selected, coalesce(sum(file_size), 0)::bigint selected_bytes from members where rn > 1", *_MEMBERS)
def q_selected_size(spark, sf_dir):
    rows = written(members(spark, sf_dir), "members")
    return selection.selected_size(selection.select(rows), rows)


@query("select (select count(*) from assets)::bigint images, (select count(error) from assets)::bigint errors, count(case when rn = 1 then 1 end)::bigint exact_groups, count(case when rn > 1 then 1 end)::bigint exact_duplicates, 0::bigint perceptual_groups, 0::bigint perceptual_duplicates from members", *_MEMBERS)
def q_scan_summary(spark, sf_dir):
    return reports.scan_summary(members(spark, sf_dir), assets(spark, sf_dir))


@query("select group_id::bigint group_id, match_type, case when rn = 1 then 'keep' else 'duplicate' end status, path, width, height, file_size, quality_score from members", *_MEMBERS)
def q_export_rows(spark, sf_dir):
    return reports.export_rows(written(members(spark, sf_dir), "members")).drop("rn")


@query("select group_id::bigint group_id, path from members m where exists (select 1 from members o where o.group_id = m.group_id and (contains(lower(parse_filename(o.path)), 'src1') or contains(lower(regexp_extract(o.path, '^(.*)/[^/]*$', 1)), 'src1')))", *_MEMBERS)
def q_filtered_groups(spark, sf_dir):
    return reports.filtered(written(members(spark, sf_dir), "members"), "exact", "SRC1").select("group_id", "path")


_WITH["summary"] = "select group_id::bigint group_id, max(case when rn = 1 then path end) best_path, count(*)::bigint image_count, coalesce(sum(case when rn > 1 then file_size end), 0)::bigint potential_savings from members group by group_id"


@query("select * from summary order by potential_savings desc, group_id limit 10 offset 10", *_MEMBERS, "summary")
def q_second_page(spark, sf_dir):
    return reports.page(groups.group_summary(members(spark, sf_dir)), 2).select("group_id", "best_path", "image_count", "potential_savings")


@query("select group_id::bigint group_id, path from (select *, count(*) over (partition by group_id) n from members where not (rn > 1 and path like '%.png')) where n > 1", *_MEMBERS)
def q_after_deletion(spark, sf_dir):
    rows = written(members(spark, sf_dir), "members")
    return groups.without_deleted(rows, rows.filter("rn > 1 and path like '%.png'")).select("group_id", "path")


# The cache: a file per user, its versions and accesses from events

_WITH["touches"] = "select '/cache/' || user_id::varchar path, epoch_us(ts)::bigint as moment, round(abs(coalesce(value, 0)) * 100)::bigint size from events"
_WITH["versions"] = "select path, moment, size, row_number() over (partition by path order by moment desc, size desc) rn from touches"


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.concat(F.lit("/cache/"), F.col("user_id").cast("string")).alias("path"), at.alias("at"), F.round(F.abs(F.coalesce("value", F.lit(0.0))) * 100).cast("bigint").alias("size"))


def _as_cache(rows: DataFrame) -> DataFrame:
    keyed = rows.select("path", F.col("at").cast("double").alias("mtime"), F.col("size").alias("file_size"), F.col("at").cast("double").alias("created_at"), F.col("at").cast("double").alias("last_accessed"), F.lit(None).cast("string").alias("dominant_color"))
    return keyed.withColumn("cache_key", S.cache_key("path", F.col("mtime").cast("bigint"), "file_size"))


@query("select path, moment mtime, size file_size from versions where rn = 1", "touches", "versions")
def q_cache_upsert(spark, sf_dir):
    """The last version of each path."""
    rows = _as_cache(_touches(spark, sf_dir))
    best = W.partitionBy("path", "mtime").orderBy(F.col("file_size").desc())
    rows = rows.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k")
    return cache.upserted(spark.createDataFrame([], rows.schema), rows).select("path", F.col("mtime").cast("bigint").alias("mtime"), "file_size")


def _first_and_last(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What was cached at each path's first access, and the files as they are after the last."""
    rows = _touches(spark, sf_dir)
    ends = rows.groupBy("path").agg(F.min(F.struct("at", "size")).alias("a"), F.max(F.struct("at", "size")).alias("z"))
    stored = _as_cache(ends.select("path", "a.at", "a.size"))
    stored = stored.withColumn("cache_key", S.cache_key("path", F.lit(0), "file_size"))
    files = ends.select("path", F.lit(0).alias("mtime"), F.col("z.size").alias("file_size"))
    return stored, files


_WITH["ends"] = "select path, arg_min(size, moment * 1000000 + size) s0, arg_max(size, moment * 1000000 + size) s1, min(moment) a0, max(moment) a1 from (select path, moment::hugeint as moment, size from touches) group by path"


@query("select path, s1 file_size, s0 = s1 hit from ends", "touches", "ends")
def q_cache_lookup(spark, sf_dir):
    stored, files = _first_and_last(spark, sf_dir)
    return cache.lookup(files, stored).select("path", "file_size", "hit")


@query("select count(*)::bigint total, count(case when s0 = s1 then 1 end)::bigint hits, count(case when s0 <> s1 then 1 end)::bigint misses, count(case when s0 = s1 then 1 end) / count(*)::double * 100.0::double hit_rate from ends", "touches", "ends")
def q_cache_hit_rate(spark, sf_dir):
    stored, files = _first_and_last(spark, sf_dir)
    return cache.hit_statistics(cache.lookup(files, stored))


@query("select path, s1 file_size from ends where s0 <> s1", "touches", "ends")
def q_cache_misses(spark, sf_dir):
    stored, files = _first_and_last(spark, sf_dir)
    return cache.misses(files, stored).select("path", "file_size")


@query("select path, a1::bigint last_accessed from ends", "touches", "ends")
def q_cache_touch(spark, sf_dir):
    stored, _ = _first_and_last(spark, sf_dir)
    at = _touches(spark, sf_dir).join(stored.select("path", "cache_key"), "path").select("cache_key", F.col("at").cast("double").alias("at"))
    return cache.touched(stored, at).select("path", F.col("last_accessed").cast("bigint").alias("last_accessed"))


@query("select path from ends where a1 / 1000000.0::double < (select max(a1) / 1000000.0::double from ends) - 86400.0::double", "touches", "ends")
def q_cache_stale(spark, sf_dir):
    rows = _touches(spark, sf_dir).groupBy("path").agg((F.max("at") / 1e6).alias("last_accessed"))
    now = rows.agg(F.max("last_accessed")).first()[0]
    return cache.stale(rows, now or 0.0, 1).select("path")


def _known_and_there(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A path per user, and those of which a supplier has the number."""
    there = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("/cache/"), F.col("s_suppkey").cast("string")).alias("path"))
    return _touches(spark, sf_dir).select("path").distinct(), there


@query("select distinct '/cache/' || user_id::varchar path from events where user_id not in (select s_suppkey from supplier)")
def q_cache_missing(spark, sf_dir):
    return cache.missing(*_known_and_there(spark, sf_dir))


@query("select distinct '/cache/' || user_id::varchar path from events where user_id in (select s_suppkey from supplier)")
def q_cache_present(spark, sf_dir):
    return cache.present(*_known_and_there(spark, sf_dir))


@query("select path, case when s1 % 3 = 0 then s1::varchar || ',0,0' end dominant_color from ends", "touches", "ends")
def q_cache_colors(spark, sf_dir):
    stored, now = _first_and_last(spark, sf_dir)
    colors = now.filter("file_size % 3 = 0").select("path", F.concat(F.col("file_size").cast("string"), F.lit(",0,0")).alias("dominant_color"))
    return cache.with_colors(stored, colors).select("path", "dominant_color")


@query("select path from ends where path <> '/cache/7' and path <> '/cache/1'", "touches", "ends")
def q_cache_invalidated(spark, sf_dir):
    """Without a path and without a folder, whose neighbours /cache/10 and so on stay."""
    stored, _ = _first_and_last(spark, sf_dir)
    return cache.without_directory(cache.without_path(stored, "/cache/7"), "/cache/1").select("path")


@query("select count(*)::bigint entries, coalesce(sum(s1), 0)::bigint total_bytes, round(coalesce(sum(s1), 0)::bigint / 1048576.0::double, 2) total_mb from ends", "touches", "ends")
def q_cache_statistics(spark, sf_dir):
    return cache.statistics(_first_and_last(spark, sf_dir)[1])


@query("select path directory, max(moment)::bigint last_used from touches group by path order by last_used desc, directory limit 10", "touches")
def q_recent_directories(spark, sf_dir):
    return reports.recent(_touches(spark, sf_dir).select(F.col("path").alias("directory"), "at"))


@query("select strftime(ts, '%Y-%m-%d %H:00') as hour, event_type, count(*)::bigint n, count(distinct user_id)::bigint users from events group by 1, 2")
def q_hourly_events(spark, sf_dir):
    """Events and users by hour."""
    return _table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("select date_trunc('hour', ts) as start, event_type, count(*)::bigint n from events group by 1, 2")
def q_windowed_counts(spark, sf_dir):
    """The batch form of the counts that a stream keeps."""
    rows = windowed_counts(_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


# Plans


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per document, with a file named by its language."""
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit("/"), "lang", F.lit(".jpg")).alias("path"))


_WITH["listing"] = "select '/lib/' || doc_id::varchar || '/' || lang || '.jpg' path, lang from documents"


@query("select 'move' op, path src, '/lib/' || lang || case when k > 0 then '_' || k::varchar else '' end || '.jpg' dest, 'planned' status from (select *, row_number() over (partition by lang order by path) - 1 k from listing)", "listing")
def q_plan_move_to_parent(spark, sf_dir):
    return moves.move_to_parent(_listing(spark, sf_dir), "/lib").select("op", "src", "dest", "status")


@query("select 'move' op, path src, '/new' || path dest, case when exists (select 1 from labels l where path like '/lib/' || l.doc_id::varchar || '/%') then 'skipped' else 'planned' end status from listing", "listing")
def q_plan_move_tree(spark, sf_dir):
    files = _listing(spark, sf_dir)
    present = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id").select(F.concat(F.lit("/new/lib/"), F.col("doc_id").cast("string"), F.lit("/"), "lang", F.lit(".jpg")).alias("path"))
    return moves.move_with_structure(files, "/", "/new", present).select("op", "src", "dest", "status")


@query(
    "select 'rename' op, path src, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || source || '_' || lang || '_' || k::varchar || regexp_extract(path, '([.][^.]*)$', 1) dest, 'planned' status "
    "from (select f.path, d.source, d.lang, row_number() over (partition by d.source, d.lang order by parse_filename(f.path)) k from files f join documents d on d.doc_id = f.doc_id)",
    "files",
)
def q_plan_rename_by_parent(spark, sf_dir):
    return moves.rename_by_parent(assets(spark, sf_dir).select("path"), "/lib").select("op", "src", "dest", "status")


@query(f"select 'move' op, path src, '/flat/' || {_alphabet('name')} || '/' || name dest, 'planned' status from (select '/flat/' || c_name path, c_name as name from customer)")
def q_plan_alphabet(spark, sf_dir):
    files = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/flat/"), "c_name").alias("path"))
    return moves.sort_alphabetical(files, "/flat").select("op", "src", "dest", "status")


@query(f"select 'copy' op, '/flat/' || parse_filename(path) src, '/flat/' || {_CLASS} || '/' || {_TURN} || '/' || parse_filename(path) dest, 'planned' status from files", "files")
def q_plan_resolution(spark, sf_dir):
    flat = assets(spark, sf_dir).withColumn("path", F.concat(F.lit("/flat/"), S.filename("path")))
    return moves.sort_by_resolution(flat, "/flat", copy=True).select("op", "src", "dest", "status")


_FORMATS = ["JPEG", "PNG", "GIF", "TIFF"]
_PREFERRED = [".jpg", ".png", ".gif", ".tiff"]


@query(
    f"select 'rename' op, path src, case when ok then path else regexp_extract(path, '^(.*)[.][^.]*$', 1) || {_case('doc_id % 4', _PREFERRED)} end dest, case when ok then 'skipped' else 'planned' end status "
    "from (select *, (doc_id % 4 = 0 and doc_id % 5 = 0) or (doc_id % 4 = 1 and doc_id % 5 = 1) or (doc_id % 4 = 3 and doc_id % 5 = 3) ok from files)",
    "files",
)
def q_plan_fix_extensions(spark, sf_dir):
    return moves.fix_extensions(assets(spark, sf_dir).withColumn("format", _by_id(_FORMATS)).select("path", "format")).select("op", "src", "dest", "status")


@query("select 'convert' op, path src, regexp_extract(path, '^(.*)[.][^.]*$', 1) || '.jpg' dest, 'planned' status from files where path like '%.png' or path like '%.webp'", "files")
def q_plan_convert(spark, sf_dir):
    return moves.convert_to_jpg(assets(spark, sf_dir).select("path")).select("op", "src", "dest", "status")


@query(
    "select '/lib/' || doc_id::varchar src, 2 depth from documents where doc_id not in (select doc_id from labels)",
)
def q_plan_empty_folders(spark, sf_dir):
    """Folders of documents without a label hold no file."""
    docs = _table(spark, sf_dir, "documents")
    folders = docs.select(F.concat(F.lit("/lib/"), F.col("doc_id").cast("string")).alias("path"))
    files = docs.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select(F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit("/a.jpg")).alias("path"))
    return moves.empty_folders(folders, files, "/lib").select("src", (F.col("depth") - 1).alias("depth"))


@query(f"select 'delete' op, path src from members where rn > 1", *_MEMBERS)
def q_plan_delete_duplicates(spark, sf_dir):
    return moves.act_on_duplicates(written(members(spark, sf_dir), "members"), "delete").select("op", "src")


@query("select 'symlink' op, m.path src, b.path dest from members m join members b on m.group_id = b.group_id and b.rn = 1 where m.rn > 1", *_MEMBERS)
def q_plan_link_duplicates(spark, sf_dir):
    return moves.act_on_duplicates(written(members(spark, sf_dir), "members"), "symlink").select("op", "src", "dest")


_KINDS = ["none", "truncated", "bad_exif", "invalid_format", "unknown"]


@query(
    f"""select path, case when not readable then 'permission_error' when kind = 'none' then 'clean'
  when kind = 'invalid_format' then case when writable and parent_writable then 'quarantined' else 'skipped' end
  when not writable then 'skipped' when repaired then 'repaired' when parent_writable then 'quarantined' else 'skipped' end status
from (select path, doc_id % 11 <> 0 readable, doc_id % 7 <> 0 writable, doc_id % 13 <> 0 parent_writable, doc_id % 3 = 0 repaired, {_case('doc_id % 5', _KINDS)} kind from files)""",
    "files",
)
def q_repair_decisions(spark, sf_dir):
    not_zero = lambda n: F.col("doc_id") % n != 0
    rows = assets(spark, sf_dir).select("path", not_zero(11).alias("readable"), not_zero(7).alias("writable"), not_zero(13).alias("parent_writable"), (F.col("doc_id") % 3 == 0).alias("repaired"), _by_id(_KINDS).alias("corruption_type"))
    return repair.decide(rows).select("path", "status")


_PICTURE = [(0, 0, 0), (40, 3, 90), (80, 6, 180), (5, 250, 17)]


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content: a picture of four pixels for each document, its colour and three that follow from it."""
    channel = lambda c, add: F.lpad(F.hex((F.col(c) + add) % 256), 2, "0")
    body = F.concat(*[channel(c, add) for shift in _PICTURE for c, add in zip("rgb", shift)])
    content = F.concat(F.lit(b"P6 4 1 255\n"), F.unhex(body))
    return assets(spark, sf_dir).select("path", content.alias("content"))


def _channel(c: str, k: int) -> str:
    return " + ".join(f"({c} + {shift[k]}) % 256" for shift in _PICTURE)


@query(f"select path, (({_channel('r', 0)}) // 4)::int r, (({_channel('g', 1)}) // 4)::int g, (({_channel('b', 2)}) // 4)::int b from files", "files")
def q_mean_color(spark, sf_dir):
    """The dominant colour of one cluster is the mean of the pixels, truncated; decoded from the pictures' bytes."""
    return analyze.colors(pictures(spark, sf_dir)).select("path", "r", "g", "b")


_WITH["two_colors"] = f"select path, least(a, b) first, greatest(a, b) last from (select path, {_COLOR} a, (select {_COLOR} from (select f.b r, f.r g, f.g b)) b from files f)"


@query("select case when first = last then first else first || '_' || last end palette, count(*)::bigint n from two_colors group by 1", "files", "two_colors")
def q_palette(spark, sf_dir):
    """Of each file's colour and the one with its channels turned."""
    turned = F.array(F.struct("r", "g", "b"), F.struct(F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b")))
    return moves.palette_groups(assets(spark, sf_dir).withColumn("colors", turned))


@query(f"select 'move' op, '/flat/' || parse_filename(path) src, '/flat/' || {_COLOR} || '/' || parse_filename(path) dest from files where not (path like '%.cr2')", "files")
def q_plan_color(spark, sf_dir):
    flat = assets(spark, sf_dir).withColumn("path", F.concat(F.lit("/flat/"), S.filename("path")))
    return moves.sort_by_color(flat, "/flat").select("op", "src", "dest")


# Views, statistics and user decisions


@query("select group_id::bigint group_id, max(case when rn = 1 then path end) best_path, count(*)::bigint n, string_agg(path, '|' order by rn, quality_score desc, path) paths from members group by group_id", *_MEMBERS)
def q_nested_groups(spark, sf_dir):
    rows = groups.nested(members(spark, sf_dir))
    return rows.select("group_id", "best_path", F.size("images").cast("long").alias("n"), F.array_join(F.transform("images", lambda i: i["path"]), "|").alias("paths"))


def _tenths(unit: int, name: str) -> str:
    """Bytes in a unit with one decimal, halves up."""
    t = f"((file_size * 20 + {unit}) // {2 * unit})"
    return f"({t} // 10)::varchar || '.' || ({t} % 10)::varchar || ' {name}'"


_SIZE = f"case when file_size < 1024 then file_size::varchar || '.0 B' when file_size < 1048576 then {_tenths(1024, 'KB')} when file_size < 1073741824 then {_tenths(1048576, 'MB')} else {_tenths(1073741824, 'GB')} end"


@query(f"select path, parse_filename(path) filename, {_SIZE} file_size_formatted, width::varchar || 'x' || height::varchar resolution from assets", "files", "assets")
def q_human_size(spark, sf_dir):
    rows = assets(spark, sf_dir).withColumns({"format": F.lit("JPEG")})
    return reports.image_view(rows).select("path", "filename", "file_size_formatted", "resolution")


@query("select doc_id, format('{:,}', n_chars) shown, case when n_chars < 60 then n_chars::varchar || 's' when n_chars < 3600 then (n_chars // 60)::varchar || 'm ' || (n_chars % 60)::varchar || 's' else (n_chars // 3600)::varchar || 'h ' || (n_chars % 3600 // 60)::varchar || 'm' end as lasts from documents")
def q_durations(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.with_separators("n_chars").alias("shown"), S.duration("n_chars").alias("lasts"))


@query("select path, r r1, g g1, b b1 from files", "files")
def q_parsed_rgb(spark, sf_dir):
    """The colour as the cache has it, and back."""
    rows = analyze.dominant_text(assets(spark, sf_dir)).withColumn("c", S.parsed_rgb("dominant_color"))
    return rows.select("path", F.col("c.r").alias("r1"), F.col("c.g").alias("g1"), F.col("c.b").alias("b1"))


@query("select url, case when length(p) <= 60 then p when 59 - length(d) - length(x) >= 1 then d || '/' || substr(s, 1, 59 - length(d) - length(x)) || x end short from (select url, '/keep/' || page_id::varchar d, '/keep/' || page_id::varchar || '/' || u || '.html' p, '.html' x, u s from (select page_id, url, regexp_replace(url, '[^a-z]', '-', 'g') u from pages))")
def q_shortened_paths(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/keep/"), F.col("page_id").cast("string"), F.lit("/"), F.regexp_replace("url", "[^a-z]", "-"), F.lit(".html"))
    return rows.select("url", path.alias("path")).select("url", S.shortened("path", 60).alias("short"))


@query("select path, group_id::bigint group_id, file_size, quality_score, error, width from members", *_MEMBERS)
def q_json_round_trip(spark, sf_dir):
    rows = members(spark, sf_dir).select("path", "group_id", "file_size", "quality_score", "error", "width")
    return reports.from_json(reports.to_json(rows), rows.schema)


@query("select path from assets where path > '/lib/src2' order by path limit 500", "files", "assets")
def q_keyset_page(spark, sf_dir):
    """The first 500 paths behind one."""
    return reports.keyset_page(assets(spark, sf_dir).select("path"), "path", "/lib/src2")


@query("select path from files where path like '/lib/src1/%' and (path like '%.png' or path like '%.tiff')", "files")
def q_files_below(spark, sf_dir):
    return files.by_extension(files.inside(assets(spark, sf_dir).select("path"), "/lib/src1"), [".png", ".tiff"])


_WITH["outcomes"] = "select path src, case doc_id % 4 when 0 then 'error' when 1 then 'skipped' else 'done' end status, file_size, case when doc_id % 4 = 0 then 'no room for ' || doc_id::varchar end error from files"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _by_id(["error", "skipped", "done", "done"])
    failed = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("no room for "), F.col("doc_id").cast("string")))
    return assets(spark, sf_dir).select(F.col("path").alias("src"), status.alias("status"), "file_size", failed.alias("error"))


@query("select count(case when status = 'done' then 1 end)::bigint processed, count(case when status = 'error' then 1 end)::bigint errors, count(case when status = 'skipped' then 1 end)::bigint skipped, coalesce(sum(case when status = 'done' then file_size end), 0)::bigint space_saved from outcomes", "files", "outcomes")
def q_action_statistics(spark, sf_dir):
    return reports.action_statistics(_outcomes(spark, sf_dir))


@query("select src path, error from outcomes where status = 'error'", "files", "outcomes")
def q_error_details(spark, sf_dir):
    return reports.error_details(_outcomes(spark, sf_dir))


@query("select status, count(*)::bigint n from outcomes group by 1", "files", "outcomes")
def q_status_counts(spark, sf_dir):
    return reports.status_counts(_outcomes(spark, sf_dir))


@query("select 'delete' op, path src from (select path, row_number() over (partition by group_id order by mtime desc, path) k from members) where k > 1", *_MEMBERS)
def q_plan_delete_all_but_newest(spark, sf_dir):
    """An action on the selections of a strategy, not on the best by score."""
    rows = written(members(spark, sf_dir), "members")
    return moves.act_on_duplicates(rows, "delete", selections=selection.select(rows, "newest")).select("op", "src")


@query("select path src, case when path like '/lib/src1/%' then '/trash/' || parse_filename(path) end dest, case when path like '/lib/src1/%' then 'planned' else 'error' end status from members where rn > 1", *_MEMBERS)
def q_plan_trash_selected(spark, sf_dir):
    rows = written(members(spark, sf_dir), "members")
    plan = moves.trash_selected(selection.select(rows), "/lib/src1", "/trash", spark.createDataFrame([], "path string"))
    return plan.select("src", "dest", "status")


@query("select 'move' op, case when path like '/lib/src1/%' then 'planned' else 'error' end status, count(*)::bigint n from members where rn > 1 group by 2", *_MEMBERS)
def q_plan_statistics(spark, sf_dir):
    rows = written(members(spark, sf_dir), "members")
    return moves.plan_statistics(moves.trash_selected(selection.select(rows), "/lib/src1", "/trash", spark.createDataFrame([], "path string")))


@query("select count(*)::bigint checked, count(case when doc_id % 5 = 0 then 1 end)::bigint clean, count(case when doc_id % 5 <> 0 then 1 end)::bigint others from files", "files")
def q_repair_counts(spark, sf_dir):
    rows = assets(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 5 == 0, "clean").otherwise(_by_id(["repaired", "quarantined", "skipped", "error"])))
    found = repair.counts(rows)
    return found.select("checked", "clean", (F.col("repaired") + F.col("quarantined") + F.col("skipped") + F.col("errors")).alias("others"))
