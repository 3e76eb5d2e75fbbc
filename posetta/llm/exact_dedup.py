"""Exact dedup by content sort (operator 4), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetta.plans.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_case(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed; null is empty. lower() has a fast path for
    plain ASCII, but changes other letters too, so only ASCII texts take it."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", chunk_rows: int = 64, hot_keys: int = 20_000) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    The normalised bytes are range-partitioned at sampled splitters (their first bytes, then their digest,
    so that samples stay small), sorted within partitions by the external sorter, and rows with equal
    neighbours, compared in full, form a group. keep says whether the smallest or the largest id stays.

    Texts with at least max(chunk_rows, rows / hot_keys) copies are hot: their digests, at most hot_keys of
    them, are broadcast, and their rows are dealt to chunks of about chunk_rows. Each chunk is sorted like
    any group; the leads of the chunks, compared in full again, then meet in one small aggregate.

    Null texts count as empty, and empty texts form a group like any other. Of rows that tie on id within a
    group, one is kept; null ids come last. An empty table gives no rows. Only id_col and text_col are
    read, so that other columns can have any name."""
    n, big = docs.count(), keep == "max"
    rows = docs.select(F.col(id_col).alias("_id"), fold_case(F.col(text_col)).alias("_t")).withColumn("_h", F.sha2("_t", 256))
    least = max(chunk_rows, n // hot_keys)
    hot = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= least).select("_h", F.ceil(F.col("_c") / least).alias("_c"))
    rows = rows.join(F.broadcast(hot), "_h", "left")
    key = [F.substring("_t", 1, 24).alias("_p"), "_h", F.when(F.col("_c").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), F.col("_c"))).alias("_b")]
    rows = rows.select("_id", "_t", F.col("_c").isNotNull().alias("_hot"), *key).repartitionByRange("_p", "_h", "_b")
    same = Window.partitionBy("_p", "_h", "_b", "_t")
    order = same.orderBy(F.desc_nulls_last("_id") if big else F.asc_nulls_last("_id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = rows.select(
        "_id", "_h", "_hot",
        F.first("_id").over(whole).alias("_lead"),
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.row_number().over(order).alias("_rn"),
        "_t",
    )
    chunks = stored(chunks.withColumn("_t", F.when(F.col("_hot") & (F.col("_rn") == 1), F.col("_t"))), "content-sort")
    best = F.max if big else F.min
    leads = chunks.where("_hot and _rn = 1")
    groups = leads.groupBy("_h", "_t").agg(best("_lead").alias("_keep"), F.sum("_n").alias("_size"))
    leads = leads.select("_h", "_t", "_lead").join(groups, ["_h", "_t"]).select("_h", "_lead", "_keep", "_size")
    made = chunks.where("_hot").alias("c").join(leads.alias("l"), (F.col("c._h") == F.col("l._h")) & F.col("c._lead").eqNullSafe(F.col("l._lead"))).select("c._id", "c._h", "c._lead", "c._rn", "l._keep", "l._size")
    cold = chunks.where("not _hot").select("_id", "_h", "_lead", "_rn", F.col("_lead").alias("_keep"), F.col("_n").alias("_size"))
    return made.union(cold).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        ((F.col("_rn") == 1) & F.col("_lead").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_h").alias("text_sha256"),
    )
