"""Row signatures (bit-sliced Bloom filters) with exact verification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = (1500, 5)


def optimal(n: int, fp: float) -> tuple[int, int]:
    """(bits, hashes) for n items a row and a share fp of false positives."""
    if n <= 0 or not 0 < fp < 1:
        raise ValueError("n must be over 0, and fp between 0 and 1")
    real = -n * math.log(fp) / math.log(2) ** 2
    return math.ceil(real), math.ceil(math.log(2) * real / n)


def slots(items: list[Column], bits: int, hashes: int, seed: int = 0) -> Column:
    """The slots of a composite item, by double hashing with fixed seeds."""
    low = F.lit((1 << 31) - 1)
    h1, h2 = (F.xxhash64(F.lit(seed + k), *items).bitwiseAND(low) for k in (1, 2))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: F.pmod(h1 + i * h2, F.lit(bits)))


def signed(rows: DataFrame, row: str, items: list[str], bits: int = DEFAULT[0], hashes: int = DEFAULT[1], seed: int = 0) -> DataFrame:
    """(slot, row): bit `row` of the slice of each slot that one of the row's items has."""
    return rows.select(F.explode(slots([F.col(c) for c in items], bits, hashes, seed)).alias("slot"), F.col(row).alias("row")).distinct()


def slices(signs: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(slot, block, rows): for each slot, the rows with that bit, in blocks of row numbers."""
    return signs.groupBy("slot", F.floor(F.col("row") / span).alias("block")).agg(F.sort_array(F.collect_list("row")).alias("rows"))


def candidates(signs: DataFrame, item: list[Column], bits: int = DEFAULT[0], hashes: int = DEFAULT[1], seed: int = 0) -> DataFrame:
    """(row) of all rows that have all slots of the item: all that hold it, and few others."""
    spark = signs.sparkSession
    wanted = spark.range(1).select(F.explode(F.array_distinct(slots(item, bits, hashes, seed))).alias("slot"))
    # one slot for each hash at most
    hit = signs.join(F.broadcast(wanted), "slot", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    need = wanted.agg(F.count(F.lit(1)).alias("n"))
    return hit.join(F.broadcast(need), "n").select("row")


def holding(rows: DataFrame, row: str, items: list[str], item: list[Column], bits: int = DEFAULT[0], hashes: int = DEFAULT[1]) -> DataFrame:
    """(row) of the rows that hold the item: candidates, then compared exactly."""
    found = candidates(signed(rows, row, items, bits, hashes), item, bits, hashes)
    same = F.lit(True)
    for c, x in zip(items, item):
        same = same & F.col(c).eqNullSafe(x)
    return rows.where(same).select(F.col(row).alias("row")).distinct().join(found, "row", "left_semi")


def dumped(signs: DataFrame, bits: int, as_hex: bool = False) -> DataFrame:
    """(row, dump): each row's signature as a string of bits, lowest slot first, or of hex bytes."""
    words = signs.groupBy("row").agg(F.collect_set("slot").alias("on"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-bits // 8) * 8 - 1)), lambda i: F.when(F.array_contains("on", i.cast("long")), "1").otherwise("0")), "")
    if as_hex:
        byte = lambda i: F.lpad(F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")
        text = F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-bits // 8) - 1)), byte), ""))
    return words.select("row", text.alias("dump"))
