"""Bit sequences: sets of positions, as rows (set_id, pos) or as blocks of 2^16 bits.

Positions count from 0; ranges are half-open. What has no answer is null. A block that isn't there is all
zeros. Bit i of a word is (word >> i) & 1; words keep their 64-bit pattern in a signed long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetta.functions.arrays import bound, running_sums
from posetta.plans.sequence import holding

BLOCK, WORD = 1 << 16, 64
WORDS = BLOCK // WORD


def mask_below(n: Column) -> Column:
    """A word whose n lowest bits are set, n from 0 to 63."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int")))


def shifted_one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def blocks(rows: DataFrame) -> DataFrame:
    """(set_id, block, words): the words of each block with a bit set. Repeated positions count once; bits are
    combined before the shuffle, so a hot set is no more than its blocks."""
    words = rows.where("pos is not null").groupBy("set_id", F.floor(F.col("pos") / BLOCK).alias("block"), F.floor((F.col("pos") % BLOCK) / WORD).cast("int").alias("w")).agg(F.bit_or(shifted_one(F.col("pos") % WORD)).alias("word"))
    # at most 1024 words a block
    packed = words.groupBy("set_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("w", "word"))).alias("m"))
    return packed.select("set_id", "block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))).alias("words"))


def positions(blocked: DataFrame) -> DataFrame:
    """(set_id, pos): the positions of the set bits."""
    some = blocked.select("set_id", "block", F.posexplode("words").alias("w", "word")).where("word <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.col("word").bitwiseAND(shifted_one(i)) != 0)
    return some.select("set_id", (F.col("block") * BLOCK + F.col("w") * WORD).alias("base"), F.explode(bits).alias("bit")).select("set_id", (F.col("base") + F.col("bit")).alias("pos"))


def directory(blocked: DataFrame) -> DataFrame:
    """The rank index: blocks with their number of ones, the ones of earlier blocks of the set, and the ones
    before each word of the block."""
    cum = F.expr(bound("counts", "transform(words, w -> cast(bit_count(w) as bigint))", running_sums("counts"))).cast("array<int>")
    out = blocked.withColumn("cum", cum)
    out = out.select("set_id", "block", "words", (F.element_at("cum", -1) + F.bit_count(F.element_at("words", -1))).cast("long").alias("ones"), "cum")
    starts = out.groupBy("set_id", "block").agg(F.sum("ones").alias("n"))
    w = Window.partitionBy("set_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("set_id", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return out.join(starts, ["set_id", "block"])


def with_all_blocks(blocked: DataFrame, sizes: DataFrame) -> DataFrame:
    """blocked with the blocks that aren't there below each set's size (sizes: set_id, size) as zeros, so that a
    rank query needs one equality join."""
    whole = sizes.select("set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / BLOCK))).alias("block"))
    return whole.join(blocked, ["set_id", "block"], "left").select("set_id", "block", F.coalesce("words", F.array_repeat(F.lit(0).cast("long"), WORDS)).alias("words"))


def access(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (set_id, i) with bit: whether position i is in the set; false outside."""
    there = rows.select("set_id", F.col("pos").alias("i")).distinct().withColumn("bit", F.lit(True))
    return queries.join(there, ["set_id", "i"], "left").withColumn("bit", F.coalesce("bit", F.lit(False)))


def rank1(index: DataFrame, queries: DataFrame, out: str = "rank1", dense: bool = False) -> DataFrame:
    """queries (set_id, i) with the number of ones in [0, i). A position in a block that isn't there takes the
    ones up to the last block before it. Only blocks and the distinct blocks of the queries have a window. A
    dense index has all blocks; see with_all_blocks()."""
    asked = queries.withColumn("block", F.floor(F.col("i") / BLOCK))
    off = F.col("i") % BLOCK
    word = F.floor(off / WORD).cast("int")
    inside = F.col("before") + F.get("cum", word) + F.bit_count(F.get("words", word).bitwiseAND(mask_below(off % WORD)))
    if dense:
        return asked.join(index.select("set_id", "block", "words", "cum", "before"), ["set_id", "block"], "left").select(*queries.columns, F.coalesce(inside, F.lit(0)).cast("long").alias(out))
    steps = index.select("set_id", "block", F.col("before"), (F.col("before") + F.col("ones")).alias("after"))
    wanted = asked.select("set_id", "block").distinct().join(steps.select("set_id", "block", F.lit(1).alias("there")), ["set_id", "block"], "left").where("there is null").select("set_id", "block", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"))
    w = Window.partitionBy("set_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    gaps = steps.union(wanted).withColumn("last", F.last("after", ignorenulls=True).over(w)).where("before is null").select("set_id", "block", F.coalesce("last", F.lit(0)).alias("gap"))
    found = asked.join(index.select("set_id", "block", "words", "cum", "before"), ["set_id", "block"], "left").join(gaps, ["set_id", "block"], "left")
    return found.select(*queries.columns, F.coalesce(inside, F.col("gap"), F.lit(0)).cast("long").alias(out))


def rank0(index: DataFrame, queries: DataFrame) -> DataFrame:
    return rank1(index, queries).withColumn("rank0", F.col("i") - F.col("rank1"))


def rank_range(index: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (set_id, lo, hi) with rank1, rank0 and the excesses of [lo, hi): excess is |ones - zeros|,
    excess1 ones - zeros and excess0 zeros - ones, null where negative."""
    a = rank1(index, queries.withColumn("i", F.col("lo")), "r_lo").drop("i")
    b = rank1(index, a.withColumn("i", F.col("hi")), "r_hi").drop("i")
    one, zero = F.col("r_hi") - F.col("r_lo"), F.col("hi") - F.col("lo") - (F.col("r_hi") - F.col("r_lo"))
    return b.select(*queries.columns, one.alias("rank1"), zero.alias("rank0"), F.abs(one - zero).alias("excess"), F.when(one >= zero, one - zero).alias("excess1"), F.when(zero >= one, zero - one).alias("excess0"))


def nth_bit(word: Column, n: Column) -> Column:
    """Position of the n-th (from 0) set bit of a word, null if there are fewer."""
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: word.bitwiseAND(shifted_one(i)) != 0), n.cast("int"))


def select1(index: DataFrame, queries: DataFrame, out: str = "select1") -> DataFrame:
    """queries (set_id, n) with the position of the n-th one, n from 0; null if there are no more than n.

    Blocks meet queries on a bucket of 2^16 ones, of which a block touches two at most."""
    first, last = F.floor(F.col("before") / BLOCK), F.floor((F.col("before") + F.col("ones") - 1) / BLOCK)
    spread = index.where("ones > 0").withColumn("bucket", F.explode(F.sequence(first, last)))
    asked = queries.withColumn("bucket", F.floor(F.col("n") / BLOCK))
    on = (F.col("q.set_id") == F.col("d.set_id")) & (F.col("q.bucket") == F.col("d.bucket")) & (F.col("q.n") >= F.col("d.before")) & (F.col("q.n") < F.col("d.before") + F.col("d.ones"))
    hit = asked.alias("q").join(spread.alias("d"), on, "left").select("q.*", "d.block", "d.words", "d.cum", (F.col("q.n") - F.col("d.before")).alias("r"))
    word = F.size(F.filter("cum", lambda c: c <= F.col("r"))) - 1
    hit = hit.withColumn("w", F.when(F.col("block").isNotNull(), word))
    pos = F.col("block") * BLOCK + F.col("w") * WORD + nth_bit(F.get("words", F.col("w")), F.col("r") - F.get("cum", F.col("w")))
    return hit.select(*queries.columns, pos.alias(out))


def select0(blocked: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (set_id, n) with the position of the n-th zero below the set's size (sizes: set_id, size).

    Runs of blocks without a one are gaps of known length; the other blocks are complemented, and the ones of
    that are selected."""
    ones = blocked.select("set_id", "block", F.transform("words", lambda w: F.bitwise_not(w)).alias("words"))
    ends = sizes.withColumn("top", F.floor((F.col("size") + BLOCK - 1) / BLOCK))
    zeros = directory(ones).join(sizes, "set_id")
    cut = F.greatest(F.lit(0), F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK))
    zeros = zeros.where(cut > 0).select("set_id", "block", "words", "cum", "ones")
    marks = zeros.select("set_id", "block", F.col("ones")).union(ends.select("set_id", F.col("top"), F.lit(0).cast("long")))
    w = Window.partitionBy("set_id").orderBy("block", F.desc("ones"))
    marks = marks.withColumn("prev", F.coalesce(F.lag("block").over(w), F.lit(-1)))
    gap = (F.col("block") - F.col("prev") - 1) * BLOCK
    marks = marks.withColumn("gap", F.greatest(gap, F.lit(0)))
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("before_gap", F.coalesce(F.sum(F.col("gap") + F.col("ones")).over(run), F.lit(0)))
    spans = marks.withColumn("before", F.col("before_gap") + F.col("gap")).join(zeros.select("set_id", "block", "words", "cum"), ["set_id", "block"], "left")
    spans = spans.select("set_id", "block", "prev", "words", "cum", "before", "before_gap", (F.col("before") + F.col("ones")).alias("after"))
    hit = holding(queries, "n", spans, "before_gap", "after", ["set_id"])
    r = F.col("n") - F.col("before")
    word = F.size(F.filter("cum", lambda c: c <= r)) - 1
    inside = F.col("block") * BLOCK + word * WORD + nth_bit(F.get("words", word), r - F.get("cum", word))
    pos = F.when(r < 0, (F.col("prev") + 1) * BLOCK + (F.col("n") - F.col("before_gap"))).otherwise(inside)
    out = hit.withColumn("_p", pos).join(sizes, "set_id", "left")
    return out.select(*queries.columns, F.when(F.col("_p") < F.col("size"), F.col("_p")).alias("select0"))


def counts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(set_id, size, count1, count0, every, any) of each set in sizes; an empty sequence has every, not any."""
    ones = rows.select("set_id", "pos").distinct().groupBy("set_id").agg(F.count("pos").alias("c"))
    c = F.coalesce("c", F.lit(0))
    return sizes.join(ones, "set_id", "left").select("set_id", "size", c.alias("count1"), (F.col("size") - c).alias("count0"), (c == F.col("size")).alias("every"), (c > 0).alias("any"))


def words_at(rows: DataFrame, queries: DataFrame, width: int = 64) -> DataFrame:
    """queries (set_id, i, len) with the bits [i, i + len) as a number; len up to width."""
    near = rows.select("set_id", "pos").distinct().withColumn("bucket", F.floor(F.col("pos") / width))
    asked = queries.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("i") / width), F.floor((F.col("i") + F.greatest("len", F.lit(1)) - 1) / width))))
    hit = asked.alias("q").join(near.alias("r"), (F.col("q.set_id") == F.col("r.set_id")) & (F.col("q.bucket") == F.col("r.bucket")) & (F.col("pos") >= F.col("i")) & (F.col("pos") < F.col("i") + F.col("len")), "left")
    keys = [F.col(f"q.{c}") for c in queries.columns]
    return hit.groupBy(*keys).agg(F.coalesce(F.bit_or(shifted_one(F.col("pos") - F.col("i"))), F.lit(0)).cast("long").alias("word"))


def put(rows: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after, changes with the bit before): changes are (set_id, pos, bit); one for each position."""
    now = rows.select("set_id", "pos").distinct()
    before = changes.join(now.withColumn("was", F.lit(True)), ["set_id", "pos"], "left").withColumn("was", F.coalesce("was", F.lit(False)))
    after = now.join(changes.select("set_id", "pos"), ["set_id", "pos"], "left_anti").union(changes.where("bit").select("set_id", "pos"))
    return after, before


def flip(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Each position of at (set_id, pos) toggled; repeated ones toggle once each."""
    both = rows.select("set_id", "pos").distinct().union(at.select("set_id", "pos"))
    return both.groupBy("set_id", "pos").count().where("count % 2 = 1").select("set_id", "pos")


def resized(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Positions at or beyond the new size are cleared, so that a later growth finds zeros there."""
    return rows.join(sizes, "set_id").where("pos < size").select("set_id", "pos")


def select_from(index: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (set_id, i, n) with select1_from: how far from i the n-th one at or after i lies."""
    at = rank1(index, queries, "_r").withColumn("_n", F.col("n")).withColumn("n", F.col("n") + F.col("_r")).drop("_r")
    got = select1(index, at, "_p")
    return got.select(*[F.col("_n").alias("n") if c == "n" else F.col(c) for c in queries.columns], (F.col("_p") - F.col("i")).alias("select1_from"))


def lsb(x: Column) -> Column:
    """Lowest set bit of a word, 0 for 0."""
    low = F.lit(-(1 << 63)).cast("long")
    return F.when(x == low, x).otherwise(x.bitwiseAND(-F.when(x == low, F.lit(0)).otherwise(x)))


def msb(x: Column) -> Column:
    """Highest set bit of a word, 0 for 0."""
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, F.lit(-(1 << 63)).cast("long")).otherwise(shifted_one(F.length(F.bin(x)) - 1))


def rank(index: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (set_id, bit, lo, hi) with rank: how many positions of [lo, hi) have that bit."""
    got = rank_range(index, queries)
    return got.select(*queries.columns, F.when(F.col("bit"), F.col("rank1")).otherwise(F.col("rank0")).alias("rank"))


def select(blocked: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (set_id, bit, n) with the position of the n-th such bit below the set's size, or null."""
    ones = select1(directory(blocked), queries.where("bit"), "select")
    zeros = select0(blocked, sizes, queries.where("not bit")).withColumnRenamed("select0", "select")
    return ones.join(sizes, "set_id", "left").select(*queries.columns, F.when(F.col("select") < F.coalesce("size", F.col("select") + 1), F.col("select")).alias("select")).union(zeros.select(*queries.columns, "select"))


def select0_from(blocked: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (set_id, i, n) with select0_from: how far from i the n-th zero at or after i lies."""
    at = rank0(directory(blocked), queries).withColumn("_n", F.col("n")).withColumn("n", F.col("n") + F.col("rank0"))
    got = select0(blocked, sizes, at.select(*queries.columns, "_n"))
    return got.select(*[F.col("_n").alias("n") if c == "n" else F.col(c) for c in queries.columns], (F.col("select0") - F.col("i")).alias("select0_from"))


def pushed(rows: DataFrame, sizes: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes) after bits more (set_id, k, bit), k counting from 0, are put behind each set's last position."""
    n = more.groupBy("set_id").agg((F.max("k") + 1).alias("_n"))
    new = more.where("bit").join(sizes, "set_id").select("set_id", (F.col("size") + F.col("k")).alias("pos"))
    return rows.select("set_id", "pos").distinct().union(new), sizes.join(n, "set_id", "left").select("set_id", (F.col("size") + F.coalesce("_n", F.lit(0))).alias("size"))


def popped(rows: DataFrame, sizes: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sizes) without each set's last n positions, and those as (set_id, k, bit), the last one first."""
    left = sizes.select("set_id", F.greatest(F.col("size") - n, F.lit(0)).alias("size"))
    gone = sizes.select("set_id", F.explode(F.when(F.col("size") > 0, F.sequence(F.greatest(F.col("size") - n, F.lit(0)), F.col("size") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("i"), "size")
    return resized(rows, left), left, access(rows, gone).select("set_id", (F.col("size") - 1 - F.col("i")).alias("k"), "bit")


def of_words(words: DataFrame) -> DataFrame:
    """(set_id, pos) of words (set_id, w, word): word w holds the positions from 64 w on."""
    return positions(words.groupBy("set_id", F.floor(F.col("w") / WORDS).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % WORDS).cast("int").alias("w"), "word"))).alias("m")).select("set_id", "block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long"))).alias("words")))


def chunks_of(lo: Column, hi: Column, width: int = BLOCK) -> Column:
    """Numbers of the chunks of width positions that [lo, hi) touches, as an array; of an empty range, none."""
    return F.when(lo < hi, F.sequence(F.floor(lo / width), F.floor((hi - 1) / width))).otherwise(F.array().cast("array<bigint>"))
