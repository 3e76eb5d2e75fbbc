"""A serialised form of sets of 32-bit positions, in chunks of 2^16 and blocks of 2^8.

Bytes: the number of chunks less 1 (two bytes), a header of eight bytes for each chunk that isn't empty (index, ones
less 1, bytes, kind; two bytes each, the upper byte of a sparse chunk's kind being its blocks less 1), and the chunks'
data. A full chunk has no data; a dense one its 8192 bytes; a sparse one two bytes for each block that isn't empty
(index, ones less 1) and then, for each block, its 32 bytes or, of fewer than 32 ones, a byte for each. No chunk, no
bytes. All numbers have their lowest byte first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARSE, DENSE, FULL = 0, 1, 2
CHUNK, BLOCK, CHUNK_BYTES, BLOCK_BYTES = 1 << 16, 1 << 8, 8192, 32


def chunk_encode(words: np.ndarray) -> tuple[int, int, bytes]:
    """(ones, kind with blocks, data) of a chunk's 1024 words."""
    raw = words.astype("<u8").tobytes()
    bit = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    ones = int(bit.sum())
    if ones == CHUNK:
        return ones, FULL, b""
    if ones >= CHUNK // 2:
        return ones, DENSE, raw
    per = bit.reshape(-1, BLOCK).sum(1)
    some = np.flatnonzero(per)
    header = np.stack([some, per[some] - 1], 1).astype(np.uint8).tobytes()
    data = b"".join(raw[i * BLOCK_BYTES : (i + 1) * BLOCK_BYTES] if per[i] >= BLOCK // 8 else np.flatnonzero(bit[i * BLOCK : (i + 1) * BLOCK]).astype(np.uint8).tobytes() for i in some)
    if len(header) + len(data) >= CHUNK_BYTES:
        return ones, DENSE, raw
    return ones, (len(some) - 1) << 8 | SPARSE, header + data


def chunk_decode(ones: int, kind: int, data: bytes) -> np.ndarray:
    """Positions in the chunk."""
    if kind & 255 == FULL:
        return np.arange(CHUNK)
    if kind & 255 == DENSE:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    n = (kind >> 8) + 1
    at, out = 2 * n, []
    for i, less in np.frombuffer(data[: 2 * n], np.uint8).reshape(-1, 2).astype(int):
        if less + 1 >= BLOCK // 8:
            part = np.flatnonzero(np.unpackbits(np.frombuffer(data[at : at + BLOCK_BYTES], np.uint8), bitorder="little"))
            at += BLOCK_BYTES
        else:
            part = np.frombuffer(data[at : at + less + 1], np.uint8).astype(np.int64)
            at += less + 1
        out.append(part + i * BLOCK)
    return np.concatenate(out)


def assemble(chunks: list[tuple[int, int, int, bytes]]) -> bytes:
    """The serialised set of its chunks (index, ones, kind, data) in order."""
    if not chunks:
        return b""
    header = b"".join(np.array([i, ones - 1, len(data), kind], "<u2").tobytes() for i, ones, kind, data in chunks)
    return np.array([len(chunks) - 1], "<u2").tobytes() + header + b"".join(data for *_, data in chunks)


def parse(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """The chunks of a serialised set."""
    if not data:
        return
    n = int(np.frombuffer(data[:2], "<u2")[0]) + 1
    at = 2 + 8 * n
    for i, less, size, kind in np.frombuffer(data[2:at], "<u2").reshape(-1, 4).astype(int):
        yield int(i), int(less) + 1, int(kind), data[at : at + size]
        at += size


def sliced(blocked: DataFrame) -> DataFrame:
    """(set_id, block, ones, kind, data) of blocks (set_id, block, words): each chunk on its own, without a shuffle."""
    kind = dict(blocked.dtypes)["set_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = [chunk_encode(np.asarray(w).view(np.uint64)) for w in b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary())))], ["set_id", "block", "ones", "kind", "data"])

    return blocked.select("set_id", "block", "words").mapInArrow(encode, f"set_id {kind}, block bigint, ones bigint, kind bigint, data binary")


def unsliced(chunks: DataFrame) -> DataFrame:
    """(set_id, pos) of sliced chunks."""
    kind = dict(chunks.dtypes)["set_id"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                _, block, ones, kd, data = (b.column(j)[k].as_py() for j in range(5))
                pos = chunk_decode(ones, kd, data) + block * CHUNK
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(k, 1)]).take(pa.array(np.zeros(len(pos), np.int64))), pa.array(pos, pa.int64())], ["set_id", "pos"])

    return chunks.select("set_id", "block", "ones", "kind", "data").mapInArrow(decode, f"set_id {kind}, pos bigint")


def serialised(chunks: DataFrame) -> DataFrame:
    """(set_id, data): each set's chunks put together; a set has 65,536 chunks of 8 KB at most."""

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        rows = list(zip(*(group[c].to_pylist() for c in ("block", "ones", "kind", "data"))))
        return pa.table({"set_id": group["set_id"].slice(0, 1), "data": pa.array([assemble(rows)], pa.binary())})

    kind = dict(chunks.dtypes)["set_id"]
    return chunks.where(F.col("block") < CHUNK).groupBy("set_id").applyInArrow(join, f"set_id {kind}, data binary")
