"""Stored content: bytes, compressed where that pays, and a flag byte at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPRESSED, CHUNKED = 1, 2


def worth_compressing(sample: bytes, level: int = 4, ratio: float = 0.95) -> bool:
    import zstandard

    return bool(sample) and len(zstandard.ZstdCompressor(level=level).compress(sample)) < len(sample) * ratio


def encode(data: bytes, flags: int = 0, level: int = 4, sniff: int = 16 << 10, ratio: float = 0.95) -> bytes:
    """data as it's stored: whether to compress is judged by its first sniff bytes."""
    import zstandard

    if worth_compressing(data[:sniff], level, ratio):
        return zstandard.ZstdCompressor(level=level).compress(data) + bytes([flags | COMPRESSED])
    return data + bytes([flags])


def decode(stored: bytes) -> tuple[int, bytes]:
    """(flags, data); bytes that nothing can have stored raise ValueError."""
    import zstandard

    if not stored:
        raise ValueError("the flag byte is missing")
    flags, data = stored[-1], stored[:-1]
    if flags & COMPRESSED:
        try:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        except zstandard.ZstdError as e:
            raise ValueError(str(e)) from e
    return flags, data


def _mapped(df: DataFrame, column: str, fn: Callable[[bytes], bytes]) -> DataFrame:
    names, schema = df.columns, df.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index(column)
            new = pa.array([None if x is None else fn(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([new if k == at else b.column(k) for k in range(len(names))], names)

    return df.withColumn(column, F.col(column).cast("binary")).mapInArrow(apply, schema if dict(df.dtypes)[column] == "binary" else df.withColumn(column, F.col(column).cast("binary")).schema)


def encoded(df: DataFrame, column: str) -> DataFrame:
    """df with the column's bytes as they're stored; null stays null."""
    return _mapped(df, column, encode)


def decoded(df: DataFrame, column: str) -> DataFrame:
    """df with the column's stored bytes as they were."""
    return _mapped(df, column, lambda x: decode(x)[1])
