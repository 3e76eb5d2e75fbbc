"""Prefix sums over (pos, x), positions dense from 0, and searches in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetta.plans.sequence import holding, running

SPAN = 1 << 12


def prefix(df: DataFrame, value: Column | None = None) -> DataFrame:
    """(pos, x, before, cum): the sum of the values before and up to each position. value sums a mapped item."""
    value = F.col("x") if value is None else value
    out = running(df.select("pos", "x", value.alias("_v")), F.col("_v"), ["pos"], F.floor(F.col("pos") / SPAN))
    return out.select("pos", "x", "before", (F.col("before") + F.coalesce("_v", F.lit(0))).alias("cum"))


def sums(sums_of: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (i) with the sum of the first i items; 0 for i = 0, the total beyond the end."""
    # one row
    ends = sums_of.agg(F.coalesce(F.max(F.struct("pos", "cum")).getField("cum"), F.lit(0)).alias("total"), F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n"))
    hit = queries.join(sums_of.select((F.col("pos") + 1).alias("i"), "cum"), "i", "left").join(F.broadcast(ends))
    return hit.select(*queries.columns, F.when(F.col("i") <= 0, 0).when(F.col("i") > F.col("n"), F.col("total")).otherwise(F.col("cum")).cast("long").alias("sum"))


def values(sums_of: DataFrame) -> DataFrame:
    """(pos, x) again from prefix sums."""
    later = sums_of.select((F.col("pos") + 1).alias("pos"), F.col("cum").alias("prev"))
    return sums_of.select("pos", "cum").join(later, "pos", "left").select("pos", (F.col("cum") - F.coalesce("prev", F.lit(0))).alias("x"))


def changed(df: DataFrame, deltas: DataFrame) -> DataFrame:
    """(pos, x) after deltas (pos, delta), of which a position can have many or be new."""
    both = df.select("pos", "x").union(deltas.select("pos", "delta"))
    return both.groupBy("pos").agg(F.sum("x").alias("x"))


def assigned(df: DataFrame, leaves: DataFrame) -> DataFrame:
    """(pos, x) with the leaves (pos, x) written over."""
    return df.select("pos", "x").join(leaves.select("pos"), "pos", "left_anti").union(leaves.select("pos", "x"))


def lower_bound(sums_of: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (w) with lower_bound, the least i whose first i items sum to w or more (items mustn't be
    negative): 0 for w <= 0, one more than the items where w is above the total; and with search, the same less
    1, null where w is above the total.

    Blocks of SPAN positions, with the sums before and after them, are the directory: a query finds its block
    among them by a join on buckets of sums, then its position in the block by an equality join on it."""
    rows = sums_of.withColumn("block", F.floor(F.col("pos") / SPAN))
    directory = rows.groupBy("block").agg(F.min("before").alias("low"), F.max("cum").alias("high"), F.max("pos").alias("last"))
    ends = directory.agg(F.coalesce(F.max("last") + 1, F.lit(0)).alias("n"))
    # sums up to `high` and above `low` lie in a block: w - 1 is in [low, high)
    asked = queries.where("w > 0").select("w", (F.col("w") - 1).alias("point")).distinct()
    at = holding(asked, "point", directory.select("block", "low", "high"), "low", "high").where("block is not null").select("w", "block")
    hit = at.join(rows.select("block", "pos", "before", "cum"), "block").where("before < w and cum >= w").groupBy("w").agg(F.min("pos").alias("p"))
    out = queries.join(hit, "w", "left").join(F.broadcast(ends))
    bound = F.when(F.col("w") <= 0, 0).otherwise(F.coalesce(F.col("p") + 1, F.col("n") + 1))
    return out.select(*queries.columns, bound.cast("long").alias("lower_bound"), F.when(F.col("w") <= 0, F.when(F.col("n") > 0, 0)).otherwise(F.col("p")).cast("long").alias("search"))


def complement(df: DataFrame, most: int) -> DataFrame:
    """(pos, x) with most - x for x; its prefix sums count what is missing."""
    return df.select("pos", (F.lit(most) - F.col("x")).alias("x"))


def pushed(df: DataFrame, items: DataFrame) -> DataFrame:
    """(pos, x) with items (n, x) after the last position, in the order of n, which counts from 0."""
    # one row
    ends = df.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("end"))
    return df.select("pos", "x").union(items.join(F.broadcast(ends)).select((F.col("n") + F.col("end")).alias("pos"), "x"))


def popped(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """((pos, x) without the last n, the last n)."""
    rows = df.select("pos", "x").join(F.broadcast(df.agg((F.max("pos") + 1).alias("end"))))
    return rows.where(F.col("pos") < F.col("end") - n).select("pos", "x"), rows.where(F.col("pos") >= F.col("end") - n).select("pos", "x")


def fixed(df: DataFrame, size: int) -> DataFrame:
    """(pos, x) with zeros for the positions below size that aren't there, so that positions are dense."""
    every = df.sparkSession.range(size).select(F.col("id").alias("pos"))
    return every.join(df.select("pos", "x"), "pos", "left").select("pos", F.coalesce("x", F.lit(0)).cast("long").alias("x")).union(df.where(F.col("pos") >= size).select("pos", "x"))
