"""The corpus pipeline: quality, exact copies, near copies, source mix, tokens.

Every stage reads whole texts, keeps the columns of documents (all but the last), gives no rows for an empty
table, and runs whatever the number, order or repetition of rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posetta.llm import bpe, exact_dedup, jaccard, mixing, quality
from posetta.llm.words import fresh
from posetta.plans.session import scratch_dir, small_batches, table


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session whose Python workers get few rows at once, as its result is still to be computed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking scores at least 0.5; the others go. Null texts score as empty ones do; equal
    texts score alike, whatever their ids, so repeated rows stay or go together; null ids train nothing."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z lower-cased): the one with the largest doc_id, null ids last. Null
    texts are equal to empty ones. Of rows that are the same in id and folded text the first by text stays."""
    names = [fresh(docs, x) for x in ("key", "sha", "nth")]
    key, sha, nth = names
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = exact_dedup.exact_dedup(docs, keep="max").where("kept").select(id_text.alias(key), F.col("text_sha256").alias(sha))
    rows = docs.withColumns({key: id_text, sha: F.sha2(exact_dedup.fold_case(F.col("text")), 256)}).join(kept.hint("merge"), [key, sha], "left_semi")
    same = Window.partitionBy(key, sha).orderBy("text")
    return rows.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*docs.columns)


@in_small_batches
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: the one with the smallest doc_id.
    Documents without words, or without an id, all stay; so do all rows of an id that stays."""
    kept = jaccard.jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    return known.select(*docs.columns).union(docs.where("doc_id is null"))


@in_small_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document in each pass; no document more than twice. Null and empty texts take
    nothing and go; a null source is one like the others; repeated rows are rows of their own."""
    return mixing.mixed_documents(docs)


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with their number, a digest of them and one of what they decode to. A null text
    counts as empty and has no ids."""
    import public_tokenizers

    return bpe.bpe(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, digests=True, ids_too=True)


STAGES = [("quality", good_quality), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("mixing", mixed), ("bpe", tokens)]

#: Learned scores and drawn mixes aren't for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read by the next."""
    docs, base = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
