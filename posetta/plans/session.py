"""Sessions, tables and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Rows that Python gets at once, at most, after small_batches(): 2 MB of documents as they usually are.
ROWS_A_BATCH = 1024
_OWN: dict[str, str] = {}
#: Where the tables are that stored() has made and that are still referred to.
_PATHS: dict[int, str] = {}


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session on this machine, as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("posetta")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # else each column call looks up its caller
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name; columns are pruned by what the query selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on Python gets at most ROWS_A_BATCH rows at once in this session, not 10,000: a batch of whole texts stands
    several times in an executor's memory, outside the heap and in each of its workers. A lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, a local session gets a folder of
    its own, which goes at exit, and a cluster session one in the warehouse."""
    conf = spark.sparkContext.getConf()
    if shared := conf.get("spark.checkpoint.dir"):
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _OWN[app] = tempfile.mkdtemp(prefix="posetta-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        else:
            _OWN[app] = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), f"_scratch-{app}")
    return _OWN[app]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written as a table in the shared folder and read again. This cuts the lineage: the rows outlive
    any executor, and what is read twice is computed once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() made, once nothing reads them any more, through the file system that Spark uses.
    What a result still reads stays until the folder itself is cleared."""
    for df in tables:
        if path := _PATHS.pop(id(df), None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
