"""The corpus pipeline: quality, near duplicates, repeated substrings, the mix of sources, and token ids.

Each stage takes the documents that its predecessor kept, all of them and their whole texts, and its decisions take effect.
All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm import bpe, minhash, mixing, quality, substrings
from lookalike.llm.common import stash, table
from lookalike.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; the classifier learns from the labels of documents that are here."""
    model, _ = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score_texts(docs, model, out="_score").filter("_score >= 0.5").select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that is linked by a similarity of 0.8 or more; each row is judged by its text."""
    return minhash.keep_one(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that a document with a smaller id has too."""
    return substrings.remove(docs)


#: Weight of a document that the classifier is sure to reject, so that every document can be taken.
LEAST_WEIGHT = 0.01


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it. Its weight in the sampling is the classifier's score, learnt
    from the labels of documents that are here; texts are not kept with their statistics."""
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), "source", mixing.n_words("text").alias("size"), mixing.text_digest("text"), F.col("text").alias("_text"))
    known = stash(quality.featurize(slim, "_text"), "mix-statistics")
    model = quality.learn_from(known.withColumnRenamed("id", "doc_id"), table(spark, sf_dir, "labels"))
    weight = F.greatest(F.col("_score"), F.lit(LEAST_WEIGHT))
    scored = quality.score_statistics(known, model, out="_score")
    rows = stash(scored.select("id", "source", "size", mixing.sample_key("id", weight).alias("at"), "_digest"), "mix-rows")
    return mixing.mix(docs, planned=mixing.plan_rows(rows))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), *tokenizer_file(), decodes="decodes")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "decodes", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near),
    ("substrings", cut_repeats),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]

#: The classifier, the sketches and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
