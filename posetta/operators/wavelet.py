"""Queries over slices of integer sequences, relationally: rows (pos, sym), pos dense from 0.

A view is a half-open position range, and a search a half-open range of symbols; either bound of a search can be
left out. An invalid view is empty. Symbols are compared as signed longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetta.plans.sequence import holding, running

#: Positions in the smallest block of which counts() keeps a histogram; larger ones have twice as many each.
SPAN = 1 << 12


def view(v: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows of [lo, hi); `at` is the position in the view."""
    return v.where((F.col("pos") >= lo) & (F.col("pos") < hi)).withColumn("at", F.col("pos") - lo)


def search(v: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    if low is not None:
        v = v.where(F.col("sym") >= low)
    return v if high is None else v.where(F.col("sym") < high)


def get(v: DataFrame, queries: DataFrame, lo: int = 0) -> DataFrame:
    """queries (i) with the symbol at lo + i, null beyond the end of the whole sequence (not of the view)."""
    return queries.join(v.select((F.col("pos") - lo).alias("i"), "sym"), "i", "left").select(*queries.columns, F.when(F.col("i") >= 0, F.col("sym")).alias("sym"))


def histogram(v: DataFrame) -> DataFrame:
    """(sym, cnt), counted before the shuffle."""
    return v.groupBy("sym").agg(F.count(F.lit(1)).alias("cnt"))


def topk(v: DataFrame, k: int) -> DataFrame:
    """The k most frequent symbols; of equal counts the larger symbol comes first."""
    return histogram(v).orderBy(F.desc("cnt"), F.desc("sym")).limit(k)


def mink(v: DataFrame, k: int) -> DataFrame:
    return histogram(v).orderBy("sym").limit(k)


def maxk(v: DataFrame, k: int) -> DataFrame:
    return histogram(v).orderBy(F.desc("sym")).limit(k)


def counts(v: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (lo, hi, sym) with lt, eq and gt: rows of the view below, at and above the symbol.

    Histograms of blocks of positions, each level's twice as long as the one's below, answer the middle of a view
    by two blocks of a level at most; only rows of the two blocks at its ends are looked at one by one. So a
    query meets histograms in proportion to the logarithm of its view."""
    asked = queries.distinct()
    first, last = F.floor((F.col("lo") + SPAN - 1) / SPAN), F.floor(F.col("hi") / SPAN)
    block = F.floor(F.col("pos") / SPAN)
    top = v.agg(F.coalesce(F.max(block), F.lit(0))).first()[0]
    level = v.groupBy(block.alias("block"), F.col("sym").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    hist, levels = level.withColumn("level", F.lit(0)), max(1, int(top).bit_length())
    for k in range(1, levels):
        level = level.groupBy(F.shiftright("block", 1).alias("block"), "s").agg(F.sum("c").alias("c"))
        hist = hist.union(level.withColumn("level", F.lit(k)))
    # from the ends inwards: a block that is no left half, or before one that is no right half, goes at its level
    step = """(r, k) -> named_struct(
        'l', if(r.l < r.h and r.l % 2 = 1, r.l + 1, r.l) div 2, 'h', if(if(r.l < r.h and r.l % 2 = 1, r.l + 1, r.l) < r.h and r.h % 2 = 1, r.h - 1, r.h) div 2,
        'got', concat(r.got, if(r.l < r.h and r.l % 2 = 1, array(named_struct('level', k, 'block', r.l)), cast(array() as array<struct<level:int,block:bigint>>)),
            if(if(r.l < r.h and r.l % 2 = 1, r.l + 1, r.l) < r.h and r.h % 2 = 1, array(named_struct('level', k, 'block', r.h - 1)), cast(array() as array<struct<level:int,block:bigint>>))))"""
    start = "named_struct('l', f, 'h', greatest(f, t), 'got', cast(array() as array<struct<level:int,block:bigint>>))"
    inner = asked.withColumn("f", F.greatest(first, F.lit(0))).withColumn("t", F.least(last, F.lit(top + 1)))
    inner = inner.withColumn("n", F.explode(F.expr(f"aggregate(sequence(0, {levels}), {start}, {step}, r -> r.got)"))).select("lo", "hi", "sym", "n.level", "n.block")
    # a block beyond the last level is made of blocks of that level
    inner = inner.withColumn("block", F.when(F.col("level") < levels, F.array("block")).otherwise(F.array(F.col("block") * 2, F.col("block") * 2 + 1))).withColumn("level", F.least("level", F.lit(levels - 1))).withColumn("block", F.explode("block"))
    whole = inner.join(hist, ["level", "block"]).select("lo", "hi", "sym", "s", "c")
    single = first > last
    edges = F.when(single, F.array(F.struct(F.col("lo").alias("from"), F.col("hi").alias("to")))).otherwise(F.array(F.struct(F.col("lo").alias("from"), F.least("hi", first * SPAN).alias("to")), F.struct(F.greatest("lo", last * SPAN).alias("from"), F.col("hi").alias("to"))))
    parts = asked.withColumn("e", F.explode(edges)).where("e.from < e.to").withColumn("block", F.floor(F.col("e.from") / SPAN))
    rest = parts.join(v.select(block.alias("block"), "pos", F.col("sym").alias("s")), "block").where("pos >= e.from and pos < e.to").select("lo", "hi", "sym", "s", F.lit(1).cast("long").alias("c"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    got = whole.union(rest).groupBy("lo", "hi", "sym").agg(n(F.col("s") < F.col("sym")).alias("lt"), n(F.col("s") == F.col("sym")).alias("eq"), n(F.col("s") > F.col("sym")).alias("gt"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("lt", "eq", "gt")]
    return queries.join(got, ["lo", "hi", "sym"], "left").select(*queries.columns, *zero)


def select(v: DataFrame, queries: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """queries (sym, n) with the position in the view of the n-th (from 0) occurrence there, or null. Only the
    symbols asked for are ranked, by blocks of positions, so that a hot symbol isn't sorted in one task."""
    rows = v.where(F.col("pos") >= lo) if hi is None else view(v, lo, hi)
    rows = rows.select("pos", "sym").join(queries.select("sym").distinct(), "sym", "left_semi")
    ranked = running(rows, F.lit(1).cast("long"), ["pos"], F.floor(F.col("pos") / SPAN), ["sym"], "n")
    return queries.join(ranked.select("sym", "n", (F.col("pos") - lo).alias("pos")), ["sym", "n"], "left").select(*queries.columns, "pos")


def quantile(v: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (k) with sym, the k-th (from 0) smallest symbol of v, and nth, its number among equal symbols;
    nulls where k is no less than the rows. The histogram alone answers: nth is k less the smaller ones."""
    steps = running(histogram(v), F.col("cnt"), ["sym"], F.floor(F.col("sym") / SPAN), out="from").withColumn("upto", F.col("from") + F.col("cnt"))
    hit = holding(queries, "k", steps, "from", "upto")
    return hit.select(*queries.columns, "sym", (F.col("k") - F.col("from")).alias("nth"))
