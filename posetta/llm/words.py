"""Words: runs of anything but blank, tab, newline, vertical tab, form feed and carriage return."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def WORD_COUNT(text: Column) -> Column:  # noqa: N802
    """Number of words as a long; null has none. Blanks are squeezed, then counted."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow(), with what its tasks have freed given back to the system at their end. Workers outlive their
    tasks, and else each keeps what its largest task took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return run


def arrow_kind(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def slot_bitmap(df: DataFrame, name: str, bits: int, pieces: int = 16) -> np.ndarray:
    """A bit for each hash of that column modulo bits (a power of two from 2^16), as 64-bit words. It's put together
    on the executors, in so many pieces, and reaches the driver with bits / 8 bytes."""
    each = bits // pieces

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            p = b.column(0).to_numpy()
            for k in np.unique(p // each).tolist():
                at = p[p // each == k] % each
                np.bitwise_or.at(held.setdefault(k, np.zeros(each // 64, np.uint64)), at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "bits"])

    p = F.pmod(F.xxhash64(name), F.lit(bits))
    got = df.select(p.alias("p")).repartition(pieces, F.floor(F.col("p") / each)).mapInArrow(put, "piece int, bits binary").collect()
    out = np.zeros((pieces, each // 64), np.uint64)
    for r in got:
        out[r["piece"]] |= np.frombuffer(r["bits"], np.uint64)
    return out.ravel()
