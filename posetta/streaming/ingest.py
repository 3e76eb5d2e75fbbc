"""Streaming ingestion into the content store: staged micro-batches, compaction into packs, recovery.

Layout under a base folder: staged/batch=N holds what micro-batch N brought (its payloads, new or not yet known),
packs/ the compacted payloads, index/ where they lie, and done/ which batches the packs have. A batch that runs
again after a failure overwrites its own folder, so each content is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from posetta.functions.digests import digest
from posetta.operators import store

SCHEMA = "chunk string, payload binary"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def staged(spark: SparkSession, base: str) -> DataFrame:
    """Payloads of batches that no pack has yet."""
    rows = _table(spark, f"{base}/staged", f"{SCHEMA}, batch bigint")
    return rows.join(_table(spark, f"{base}/done", "batch bigint"), "batch", "left_anti").select("batch", "chunk", "payload")


def payloads(spark: SparkSession, base: str) -> DataFrame:
    """All payloads, staged or packed, once each; those whose bytes don't have their digest are left out, as they
    are when a store is opened again."""
    packs = _table(spark, f"{base}/packs", f"run bigint, pack bigint, {SCHEMA}").select("chunk", "payload")
    every = staged(spark, base).select("chunk", "payload").union(packs).dropDuplicates(["chunk"])
    return store.verified(every).where("valid").select("chunk", "payload")


def start(stream: DataFrame, base: str, content_col: str, trigger: dict | None = None, most_pending: int | None = None) -> StreamingQuery:
    """Starts the query: digests of the stream's contents, those not kept yet are staged. trigger is that of the writer
    ({"availableNow": True}, or {"processingTime": "30 seconds"}, which rotates by time; rows a batch, and so
    rotation by size, are the source's maxFilesPerTrigger). With most_pending batches staged, a batch first
    compacts, which holds the source back."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        if most_pending is not None and staged(spark, base).select("batch").distinct().count() >= most_pending:
            compact(spark, base)
        content = F.coalesce(F.col(content_col).cast("binary"), F.lit("").cast("binary"))
        rows = df.select(digest(content).alias("chunk"), content.alias("payload")).dropDuplicates(["chunk"])
        known = _table(spark, f"{base}/staged", f"{SCHEMA}, batch bigint").where(F.col("batch") != n).select("chunk")
        known = known.union(_table(spark, f"{base}/packs", f"run bigint, pack bigint, {SCHEMA}").select("chunk"))
        rows.join(known, "chunk", "left_anti").write.mode("overwrite").parquet(f"{base}/staged/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, base: str, pack_rows: int = 1 << 14) -> int:
    """Packs all staged batches and marks them as done; gives their number. The packs are written first and the
    marks last, so that a failure between leaves payloads twice, which reading evens out, but never loses one."""
    open_ = staged(spark, base)
    batches = sorted(r[0] for r in open_.select("batch").distinct().collect())
    if not batches:
        return 0
    rows = open_.select("chunk", "payload").dropDuplicates(["chunk"])
    run = batches[-1]
    packs, index = store.packed(rows, pack_rows)
    packs.withColumn("run", F.lit(run)).select("run", "pack", "chunk", "payload").write.mode("append").parquet(f"{base}/packs")
    index.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{base}/index")
    spark.createDataFrame([(b,) for b in batches], "batch bigint").coalesce(1).write.mode("append").parquet(f"{base}/done")
    return len(batches)


def forget(spark: SparkSession, base: str) -> None:
    """Deletes the staged folders that packs have."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in _table(spark, f"{base}/done", "batch bigint").distinct().collect():
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/staged/batch={r[0]}")
        path.getFileSystem(conf).delete(path, True)


def progress(query: StreamingQuery) -> dict:
    """What the query has done so far."""
    last = query.lastProgress
    return {"batches": len(query.recentProgress), "rows": sum(p["numInputRows"] for p in query.recentProgress), "last_batch": last["batchId"] if last else None, "failed": query.exception() is not None}
