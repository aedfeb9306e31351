"""The queries opN_<name> over the whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jpeg, minhash, mixing, quality, sampling, substrings, urls, warc
from .common import as_long, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> tuple[str, str]:
    """The rank file and the pattern of the public tokenizer that op10 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: The contract's rules.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(as_long("page_id"), "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars", "n_repeated")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(as_long("page_id"), "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = jpeg.store(table(spark, sf_dir, "documents").select(as_long("doc_id"), "text")).select("doc_id", "source_bytes", "media")
    kept = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(":"), F.col("thumb_hash"))
    return jpeg.probe(kept).select("doc_id", F.col("source_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", size.alias("feature"))


def op5_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_random_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, known = quality.learn(docs, labels)
    scored = quality.score_statistics(known, model)
    return scored.select("doc_id", (quality.fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.compare_with_next(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer_file())


QUERIES: dict[str, Query] = {
    "op1_host_suffixes": op1_host_suffixes,
    "op2_url_rules": op2_url_rules,
    "op3_tensored_minhash": op3_tensored_minhash,
    "op4_jpeg_media": op4_jpeg_media,
    "op5_capture_index": op5_capture_index,
    "op6_random_features": op6_random_features,
    "op7_level_doubling": op7_level_doubling,
    "op8_weighted_mix": op8_weighted_mix,
    "op9_weighted_sampling": op9_weighted_sampling,
    "op10_byte_bpe": op10_byte_bpe,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_url_rules": f"""
with parts as (
  select page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) x, coalesce(contains(url, '://'), false) ok from pages
), split as (
  select page_id, case when ok then translate(x.h, '{_UPPER}', '{_LOWER}') else '' end host, case when ok then x.p else '' end path from parts
), rules(kind, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit as (
  select page_id, h || p as rule, kind, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) k
  from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select cast(s.page_id as bigint) page_id, host, path, rule, coalesce(kind, 'allow') verdict
from split s left join fit f on s.page_id = f.page_id and k = 1""",
    "op5_capture_index": """
with p as (
  select cast(page_id as bigint) page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages
), f as (select payload_digest, payload_bytes, max(page_id) top from p where payload_bytes >= 1000 group by 1, 2)
select p.page_id, p.payload_bytes, p.payload_digest, case when top > page_id then 'revisit' else 'response' end record_type,
  case when top > page_id then top end refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes = f.payload_bytes""",
    "op3_tensored_minhash": rf"""
with recursive split as (
  select cast(doc_id as bigint) doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') words from documents
), shingle as (
  select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) s from split
), size as (select doc_id, count(*) n from shingle group by doc_id),
shared as (select a.doc_id x, b.doc_id y, count(*) k from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from shared join size a on a.doc_id = x join size b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
both_ways as (select x, y from link union all select y, x from link),
reach(node, label) as (select x, x from both_ways union select b.y, r.label from reach r join both_ways b on r.node = b.x),
least as (select node, min(label) label from reach group by node)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(label, d.doc_id) component_id, coalesce(label, d.doc_id) = d.doc_id kept
from split d left join size s on s.doc_id = d.doc_id left join least l on l.node = d.doc_id""",
    "op7_level_doubling": r"""
with split as (
  select cast(doc_id as bigint) doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents
), starts as (
  select doc_id, unnest(range(1, len(words) - 48)) k, unnest(list_transform(range(1, len(words) - 48), lambda i: md5(array_to_string(words[i:i + 49], ' ')))) h
  from split where len(words) >= 50
), covered as (select doc_id, k from (select doc_id, k, min(doc_id) over (partition by h) first from starts) where first < doc_id),
word as (select doc_id, unnest(range(1, len(words) + 1)) k, unnest(words) w from split),
marked as (
  select w.doc_id, w.k, w.w, count(c.k) over (partition by w.doc_id order by w.k rows between 49 preceding and current row) > 0 gone
  from word w left join covered c on c.doc_id = w.doc_id and c.k = w.k
), counted as (
  select doc_id, count(*) n_words, count(*) filter (gone) n_removed, coalesce(string_agg(w, ' ' order by k) filter (not gone), '') kept from marked group by doc_id
)
select s.doc_id, coalesce(n_words, 0)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
from split s left join counted c on c.doc_id = s.doc_id""",
    "op8_weighted_mix": r"""
with docs as (
  select cast(doc_id as bigint) doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size,
    coalesce(1.0::double / (1.0::double + 10.0::double * (length(text) - length(translate(text, '!#$%&*|', ''))) / greatest(length(text), 1)), 1.0::double) quality,
    (cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '-mix'), 1, 13) as bigint) as double) + 0.5::double) / 4503599627370496.0::double u
  from documents
), sizes as (
  select source, cast(sum(size) as bigint) source_size, (row_number() over (order by source nulls last) - 1) % 3 turn from docs group by source
), caps as (
  select source, source_size, 3 * source_size cap, case turn when 0 then 5 when 1 then 2 else 1 end w from sizes
), ranked as (
  select *, row_number() over (order by cap::double / w, source nulls last) r,
    (select sum(source_size) from caps) - coalesce(sum(cap) over (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) rest,
    (select sum(w) from caps) - coalesce(sum(w) over (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) heft
  from caps
), level as (select r, rest, heft from ranked where rest * w <= cap * heft order by r limit 1),
target as (
  select source, source_size, case when l.r is null or k.r < l.r then cap::double else (l.rest * w)::double / l.heft::double end target
  from ranked k left join level l on true
), plan as (
  select *, cast(case when source_size > 0 then least(floor(target / source_size), 3) else 0 end as bigint) epochs from target
), sums as (
  select d.*, p.source_size, p.target, p.epochs, case when p.epochs >= 3 then 0 else p.target - p.epochs * p.source_size end part,
    sum(size) over (partition by d.source order by -ln(u) / quality, doc_id rows between unbounded preceding and current row) - size before
  from docs d join plan p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target, cast(size * (epochs + case when part - before > size / 2 then 1 else 0 end) as bigint) taken from sums""",
}
