"""The wavelet matrix as tables: one bit vector for each bit of the symbols, most significant first.

Building sorts stably by one bit at a time: the position at the next level is the number of zeros before, for a
zero, or all zeros plus the ones before, for a one. Batches of queries descend level by level, each level two
rank lookups, so that their cost is the depth, not the length of their views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posetta.operators import bits
from posetta.plans.sequence import running
from posetta.plans.session import stored


@dataclass(frozen=True)
class WaveletIndex:
    """levels: the rank index of all bit vectors, set_id being the depth; gaps: that of their complements; zeros:
    how many zeros each level has."""

    levels: DataFrame
    gaps: DataFrame
    zeros: list[int]
    size: int
    depth: int


def build(v: DataFrame, depth: int | None = None) -> WaveletIndex:
    """The index of rows (pos, sym), symbols not negative. The depth is that of the largest symbol."""
    size, top = v.agg(F.count(F.lit(1)), F.coalesce(F.max("sym"), F.lit(0))).first()
    depth = max(1, int(top).bit_length()) if depth is None else depth
    at, ones, zeros = v.select("pos", F.col("sym").cast("long").alias("sym")), [], []
    for d in range(depth):
        bit = F.shiftright("sym", depth - 1 - d).bitwiseAND(F.lit(1))
        level = running(at.withColumn("bit", bit), F.col("bit"), ["pos"], F.floor(F.col("pos") / bits.BLOCK), out="r1")
        level = stored(level, f"level-{d}")
        n0 = size - (level.agg(F.sum("bit")).first()[0] or 0)
        zeros.append(int(n0))
        ones.append(level.where("bit = 1").select(F.lit(d).alias("set_id"), "pos"))
        at = level.select(F.when(F.col("bit") == 0, F.col("pos") - F.col("r1")).otherwise(n0 + F.col("r1")).alias("pos"), "sym")
    every = ones[0]
    for o in ones[1:]:
        every = every.union(o)
    sizes = v.sparkSession.range(depth).select(F.col("id").cast("int").alias("set_id"), F.lit(size).alias("size"))
    whole = stored(bits.with_all_blocks(bits.blocks(every), sizes), "wavelet-blocks")
    # the complement has ones beyond the end too, which nothing asks for
    gaps = bits.directory(whole.withColumn("words", F.transform("words", lambda w: F.bitwise_not(w))))
    return WaveletIndex(stored(bits.directory(whole), "wavelet"), stored(gaps, "wavelet-gaps"), zeros, size, depth)


def _ranked(index: WaveletIndex, q: DataFrame, d: int) -> DataFrame:
    """q with the ones before its columns i and j at level d, as ri and rj."""
    q = bits.rank1(index.levels, q.withColumn("set_id", F.lit(d)).withColumn("_j", F.col("j")), "ri", dense=True)
    keep = F.col("i")
    q = bits.rank1(index.levels, q.withColumn("_i", keep).withColumn("i", F.col("_j")), "rj", dense=True)
    return q.withColumn("i", F.col("_i")).drop("_i", "_j", "set_id")


def quantile(index: WaveletIndex, queries: DataFrame) -> DataFrame:
    """queries (qid, lo, hi, k) with the k-th smallest symbol of the view, null where there is none."""
    q = queries.select("qid", F.col("lo").alias("i"), F.col("hi").alias("j"), "k", F.lit(0).cast("long").alias("sym")).where("k >= 0 and k < hi - lo")
    for d in range(index.depth):
        q = _ranked(index, q, d)
        n0 = (F.col("j") - F.col("i")) - (F.col("rj") - F.col("ri"))
        low, z = F.col("k") < n0, F.lit(index.zeros[d])
        q = q.select(
            "qid",
            F.when(low, F.col("i") - F.col("ri")).otherwise(z + F.col("ri")).alias("i"),
            F.when(low, F.col("j") - F.col("rj")).otherwise(z + F.col("rj")).alias("j"),
            F.when(low, F.col("k")).otherwise(F.col("k") - n0).alias("k"),
            F.when(low, F.col("sym")).otherwise(F.col("sym") + (1 << (index.depth - 1 - d))).alias("sym"),
        )
    return queries.join(q.select("qid", "sym"), "qid", "left")


def counts(index: WaveletIndex, queries: DataFrame) -> DataFrame:
    """queries (qid, lo, hi, sym) with lt, eq and gt of the view."""
    zero = F.lit(0).cast("long")
    lo, hi = F.greatest(zero, F.least("lo", F.lit(index.size))), F.greatest(zero, F.least("hi", F.lit(index.size)))
    fits = (F.col("sym") >= 0) & (F.col("sym") < (1 << index.depth))
    q = queries.select("qid", lo.alias("i"), F.greatest(lo, hi).alias("j"), "sym", zero.alias("lt"), zero.alias("gt"), fits.alias("fits"))
    for d in range(index.depth):
        q = _ranked(index, q, d)
        one = F.shiftright("sym", index.depth - 1 - d).bitwiseAND(F.lit(1)) == 1
        n1 = F.col("rj") - F.col("ri")
        n0, z = (F.col("j") - F.col("i")) - n1, F.lit(index.zeros[d])
        q = q.select(
            "qid", "sym", "fits",
            F.when(one, z + F.col("ri")).otherwise(F.col("i") - F.col("ri")).alias("i"),
            F.when(one, z + F.col("rj")).otherwise(F.col("j") - F.col("rj")).alias("j"),
            F.when(one, F.col("lt") + n0).otherwise(F.col("lt")).alias("lt"),
            F.when(one, F.col("gt")).otherwise(F.col("gt") + n1).alias("gt"),
        )
    eq = F.col("j") - F.col("i")
    whole = F.col("lt") + F.col("gt") + eq
    below = F.col("sym") < 0
    got = q.select(
        "qid",
        F.when(F.col("fits"), F.col("lt")).when(below, 0).otherwise(whole).cast("long").alias("lt"),
        F.when(F.col("fits"), eq).otherwise(0).cast("long").alias("eq"),
        F.when(F.col("fits"), F.col("gt")).when(below, whole).otherwise(0).cast("long").alias("gt"),
    )
    return queries.join(got, "qid")


def get(index: WaveletIndex, queries: DataFrame) -> DataFrame:
    """queries (qid, i) with the symbol at i, null outside: the symbol of the view [i, i + 1)."""
    one = queries.select("qid", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"), F.when((F.col("i") >= 0) & (F.col("i") < index.size), 0).otherwise(-1).cast("long").alias("k"))
    return queries.join(quantile(index, one).select("qid", "sym"), "qid", "left")


def _nodes(index: WaveletIndex, queries: DataFrame, keep) -> DataFrame:
    """(qid, sym, cnt) of symbols of each query's view and range of symbols (qid, lo, hi, low, high, k; low or high
    null: no bound). From level to level each node parts into the rows with a zero and those with a one; nodes
    without rows or beyond the range go, and keep(nodes, level) drops those that can't be among the answers."""
    zero = F.lit(0).cast("long")
    lo, hi = F.greatest(zero, F.least("lo", F.lit(index.size))), F.greatest(zero, F.least("hi", F.lit(index.size)))
    q = queries.select("qid", "k", F.coalesce("low", zero).alias("low"), F.coalesce("high", F.lit(1 << index.depth).cast("long")).alias("high"), lo.alias("i"), hi.alias("j"), zero.alias("sym")).where("i < j and low < high")
    for d in range(index.depth):
        q = _ranked(index, q, d)
        z, below = F.lit(index.zeros[d]), 1 << (index.depth - 1 - d)
        left = F.struct((F.col("i") - F.col("ri")).alias("i"), (F.col("j") - F.col("rj")).alias("j"), F.col("sym"))
        right = F.struct((z + F.col("ri")).alias("i"), (z + F.col("rj")).alias("j"), (F.col("sym") + below).alias("sym"))
        q = q.select("qid", "k", "low", "high", F.explode(F.array(left, right)).alias("n")).select("qid", "k", "low", "high", "n.i", "n.j", "n.sym")
        q = stored(keep(q.where((F.col("i") < F.col("j")) & (F.col("sym") < F.col("high")) & (F.col("sym") + below > F.col("low"))), below), f"nodes-{d}")
    return q.select("qid", "k", "sym", (F.col("j") - F.col("i")).alias("cnt"))


def _first(queries: DataFrame, *order) -> DataFrame:
    """The first k rows of each query, in that order."""
    return queries.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where("_r <= k").drop("_r")


def mink(index: WaveletIndex, queries: DataFrame) -> DataFrame:
    """(qid, sym, cnt): for each query (qid, lo, hi, low, high, k) the k smallest symbols of its view that are at least
    low and below high, with their counts. Each node that lies in the range has a symbol, so the first k + 2 nodes
    of a level are enough, the outer two being cut by the range perhaps."""
    return _first(_nodes(index, queries, lambda q, below: _first(q.withColumn("k", F.col("k") + 2), "sym").withColumn("k", F.col("k") - 2)), "sym").select("qid", "sym", "cnt")


def maxk(index: WaveletIndex, queries: DataFrame) -> DataFrame:
    """The same with the k largest symbols."""
    down = F.desc("sym")
    return _first(_nodes(index, queries, lambda q, below: _first(q.withColumn("k", F.col("k") + 2), down).withColumn("k", F.col("k") - 2)), down).select("qid", "sym", "cnt")


def topk(index: WaveletIndex, queries: DataFrame) -> DataFrame:
    """(qid, sym, cnt): for each query (qid, lo, hi, low, high, k) the k most frequent symbols of its view in the range,
    of equal counts the larger symbol first. A node of n rows over m symbols has one with n / m rows at least; the
    k-th largest of these bounds, over nodes within the range, is what a node must hold to stay."""

    def keep(q: DataFrame, below: int) -> DataFrame:
        n = F.col("j") - F.col("i")
        least = F.when((F.col("sym") >= F.col("low")) & (F.col("sym") + below <= F.col("high")), F.ceil(n / below)).otherwise(0)
        by = Window.partitionBy("qid")
        rows = q.withColumn("_least", least)
        rows = rows.withColumn("_r", F.row_number().over(by.orderBy(F.desc("_least"))))
        need = F.max(F.when(F.col("_r") == F.col("k"), F.col("_least"))).over(by)
        return rows.withColumn("_need", F.coalesce(need, F.lit(0))).where(n >= F.col("_need")).select(*q.columns)

    return _first(_nodes(index, queries, keep), F.desc("cnt"), F.desc("sym")).select("qid", "sym", "cnt")


def select(index: WaveletIndex, queries: DataFrame) -> DataFrame:
    """queries (qid, lo, hi, sym, n) with pos, the position in the view of the n-th (from 0) occurrence of the symbol in
    it, or null. Queries go down to the symbol's rows and from the n-th of those up again."""
    zero = F.lit(0).cast("long")
    lo, hi = F.greatest(zero, F.least("lo", F.lit(index.size))), F.greatest(zero, F.least("hi", F.lit(index.size)))
    q = queries.where((F.col("sym") >= 0) & (F.col("sym") < (1 << index.depth)) & (F.col("n") >= 0)).select("qid", "sym", "n", F.col("lo").alias("from"), lo.alias("i"), hi.alias("j"))
    one = lambda d: F.shiftright("sym", index.depth - 1 - d).bitwiseAND(F.lit(1)) == 1
    for d in range(index.depth):
        q, z = _ranked(index, q, d), F.lit(index.zeros[d])
        q = q.select("qid", "sym", "n", "from", F.when(one(d), z + F.col("ri")).otherwise(F.col("i") - F.col("ri")).alias("i"), F.when(one(d), z + F.col("rj")).otherwise(F.col("j") - F.col("rj")).alias("j"))
    q = stored(q.where("i + n < j").select("qid", "sym", "from", (F.col("i") + F.col("n")).alias("at")), "leaves")
    for d in reversed(range(index.depth)):
        # both kinds in one join, so that each level reads the one below once
        both = index.levels.where(F.col("set_id") == d).withColumn("set_id", F.lit(1)).union(index.gaps.where(F.col("set_id") == d).withColumn("set_id", F.lit(0)))
        up = q.withColumn("set_id", F.when(one(d), F.lit(1)).otherwise(F.lit(0))).withColumn("n", F.when(one(d), F.col("at") - index.zeros[d]).otherwise(F.col("at")))
        q = bits.select1(both, up, "pos").select("qid", "sym", "from", F.col("pos").alias("at"))
    return queries.join(q.select("qid", (F.col("at") - F.col("from")).alias("pos")), "qid", "left")
