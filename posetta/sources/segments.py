"""Append-only log segments: files {id:020}.log that hold SEGv1 and then records of a length (four bytes, most
significant first) and a value."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posetta.plans.sequence import running
from posetta.plans.session import dropped, stored

MAGIC = b"SEGv1"
NAME = r"(?:^|/)([0-9]{20})\.log$"
#: Bytes of records, but for the last one of them, that reach the driver as one row.
PIECE = 1 << 20


def encoded(values: Iterable[bytes]) -> bytes:
    return MAGIC + b"".join(struct.pack(">I", len(v)) + v for v in values)


def records(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """((offset, value) of every complete record, length of the valid part); without the magic, none and 0."""
    if not data.startswith(MAGIC):
        return [], 0
    out, at = [], len(MAGIC)
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            break
        out.append((at + 4, data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out, at


def replay(spark: SparkSession, path: str) -> DataFrame:
    """(segment, slot, offset, length, value) of all complete records under path, by any file system Spark reads. A
    torn tail is left out; files that aren't named or don't begin like a segment are ignored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    files = files.select(F.regexp_extract("path", NAME, 1).alias("name"), "content").where("name <> ''").select(F.col("name").cast("long").alias("segment"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, _ = records(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([o for o, _ in rows], pa.int64()), pa.array([len(v) for _, v in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["segment", "slot", "offset", "length", "value"])

    return files.mapInArrow(parse, "segment bigint, slot bigint, offset bigint, length bigint, value binary")


def append(df: DataFrame, path: str, value: str, order: list[str], most_bytes: int = 1 << 28, most_total: int | None = None) -> int:
    """Writes the values (text or bytes; null counts as empty) by order as segments behind those under path, and returns
    how many. A segment is closed when it has most_bytes; beyond most_total bytes in the folder nothing is written
    and ValueError raised. Spark cuts the rows into segments and joins the records of a segment to pieces; these go
    through the driver, in order and one at a time, to a file that gets its name when it's whole."""
    spark = df.sparkSession
    rows = df.select(*order, F.coalesce(F.col(value).cast("binary"), F.lit("").cast("binary")).alias("_v")).withColumn("_n", (F.octet_length("_v") + 4).cast("long"))
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "records")
    rows = running(rows, F.col("_n"), order, F.col("_part"), out="_before").withColumn("_segment", F.expr(f"_before div {most_bytes}L"))
    record = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("_v")), 8, "0")), F.col("_v"))
    pieces = rows.select("_segment", F.expr(f"_before div {PIECE}L").alias("_piece"), "_before", record.alias("_record"))
    pieces = stored(pieces.groupBy("_segment", "_piece").agg(F.expr("listagg(_record) within group (order by _before)").alias("_bytes")), "pieces")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    fs = at.getFileSystem(conf)
    fs.mkdirs(at)
    names = {f.getPath().getName(): f.getLen() for f in fs.listStatus(at)}
    there = [int(n[:20]) for n in names if len(n) == 24 and n.endswith(".log") and n[:20].isdigit()]
    sizes = {r["_segment"]: r["n"] + len(MAGIC) for r in pieces.groupBy("_segment").agg(F.sum(F.octet_length("_bytes")).alias("n")).collect()}
    if most_total is not None and sum(names.values()) + sum(sizes.values()) > most_total:
        raise ValueError(f"{path} would hold more than {most_total} bytes")
    first = max(there, default=-1) + 1
    for k, own in groupby(pieces.orderBy("_segment", "_piece").toLocalIterator(), lambda r: r["_segment"]):
        part = hadoop.Path(f"{path}/{first + k:020}.part")
        out = fs.create(part)
        out.write(bytearray(MAGIC))
        for r in own:
            out.write(bytearray(r["_bytes"]))
        out.close()
        fs.rename(part, hadoop.Path(f"{path}/{first + k:020}.log"))
    dropped(pieces)
    return len(sizes)


def segment_state(spark: SparkSession, path: str) -> DataFrame:
    """(segment, bytes, valid_bytes, records, torn) of each file that is a segment."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    files = files.select(F.regexp_extract("path", NAME, 1).alias("name"), "content").where("name <> ''")

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(int(name), len(data), *((lambda r: (r[1], len(r[0])))(records(data)))) for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if data.startswith(MAGIC)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["segment", "bytes", "valid_bytes", "records"])

    return files.mapInArrow(state, "segment bigint, bytes bigint, valid_bytes bigint, records bigint").withColumn("torn", F.col("bytes") > F.col("valid_bytes"))
