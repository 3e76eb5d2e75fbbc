"""Algebra of position sets: rows (pos), rows with a set_id, or blocks (block, words)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").union(b.select("pos")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").intersect(b.select("pos"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").subtract(b.select("pos"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One shuffle by position, in which each side counts its own bit."""
    sides = a.select("pos", F.lit(1).alias("s")).union(b.select("pos", F.lit(2).alias("s")))
    return sides.groupBy("pos").agg(F.bit_or("s").alias("s")).where("s < 3").select("pos")


def folded(rows: DataFrame, how: str, first: object = None) -> DataFrame:
    """(pos) of the sets in rows (set_id, pos) taken together: and, or, xor, or and_not, which keeps what is in
    the set `first` and in no other. One grouping by position for any number of sets; no rows, no positions."""
    own = rows.select("set_id", "pos").distinct()
    if how == "or":
        return own.select("pos").distinct()
    grouped = own.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("set_id") == F.lit(first)).alias("in_first"))
    if how == "xor":
        return grouped.where("n % 2 = 1").select("pos")
    if how == "and_not":
        return grouped.where("n = 1 and in_first").select("pos")
    if how != "and":
        raise ValueError(how)
    # the number of sets is one row
    sets = own.agg(F.countDistinct("set_id").alias("sets"))
    return grouped.join(F.broadcast(sets), F.col("n") == F.col("sets")).select("pos")


def block_op(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """The same on blocks (block, words): a block that isn't there is all zeros, and results keep none that are."""
    kind, word = {
        "and": ("inner", lambda x, y: x.bitwiseAND(y)),
        "or": ("full", lambda x, y: x.bitwiseOR(y)),
        "xor": ("full", lambda x, y: x.bitwiseXOR(y)),
        "not": ("left", lambda x, y: x.bitwiseAND(F.bitwise_not(y))),
    }[how]
    zero: Column = F.array_repeat(F.lit(0).cast("long"), F.size(F.coalesce("wa", "wb")))
    both = a.select("block", F.col("words").alias("wa")).join(b.select("block", F.col("words").alias("wb")), "block", kind)
    out = both.select("block", F.zip_with(F.coalesce("wa", zero), F.coalesce("wb", zero), word).alias("words"))
    return out.where(F.exists("words", lambda w: w != 0))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts of both sets, their union and intersection, whether they're equal, disjoint, or one within the
    other, and their Jaccard and cosine similarities (null where both, or one, are empty)."""
    sides = a.select("pos", F.lit(1).alias("s")).union(b.select("pos", F.lit(2).alias("s")))
    n = lambda s: F.count(F.when(F.col("s") == s, 1))
    got = sides.groupBy("pos").agg(F.bit_or("s").alias("s")).agg(n(1).alias("a"), n(2).alias("b"), n(3).alias("both"))
    return got.select(
        (F.col("a") + F.col("both")).alias("count_a"),
        (F.col("b") + F.col("both")).alias("count_b"),
        F.col("both").alias("count_and"),
        (F.col("a") + F.col("b") + F.col("both")).alias("count_or"),
        ((F.col("a") == 0) & (F.col("b") == 0)).alias("equal"),
        (F.col("both") == 0).alias("disjoint"),
        (F.col("a") == 0).alias("subset"),
        (F.col("b") == 0).alias("superset"),
        F.try_divide(F.col("both"), F.col("a") + F.col("b") + F.col("both")).alias("jaccard"),
        F.try_divide(F.col("both").cast("double"), F.sqrt((F.col("a") + F.col("both")) * (F.col("b") + F.col("both")).cast("double"))).alias("cosine"),
    )
