"""Mixing sources to target weights (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetta.llm.shingles import U, mixed
from posetta.llm.spans import let
from posetta.llm.words import WORD_COUNT, fresh
from posetta.plans.sequence import running
from posetta.plans.session import stored

#: Words with what stands after them.
PIECES = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Copies of a row that are told apart in one go.
STEP = 1 << 16


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share * all sizes, by weight; no target is above most times its size, and the excess is shared by
    weight among the others until none is above. Where all are full, the rest is left out."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        part = {i: left * weights[i] / whole for i in open_}
        over = [i for i in open_ if part[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else part[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def slots_for(words: int, target: float, block: int, most: int) -> int:
    """Blocks to take of a source with that many words: whole passes, and of the last one by words; one at
    least if the source has words."""
    held = -(-words // block)
    passes = min(most, int((target + 1e-6) // words)) if words else 0
    rest = round((target - passes * words) / block) if words and passes < most else 0
    return max(min(1, held), min(most * held, passes * held + min(held, rest)))


def shard_counts(slots: list[int], shards: int, shard: int, seed: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of each source's slots in an output shard. The counts of all shards are a multinomial draw
    of each source's slots, each shard being as likely for each slot, so they add up to the slots exactly. The
    draw goes down a binary tree: of a node's slots, the lower half of its shards gets a binomial share, drawn
    from the seed and the node alone, so any task can work out any shard. known: nodes that are drawn already."""
    lo, hi, first, count = 0, shards, np.zeros(len(slots), np.int64), np.array(slots, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (lo, hi) not in known:
            known[lo, hi] = np.random.default_rng([seed, lo, hi]).binomial(count, (mid - lo) / (hi - lo))
        left = known[lo, hi]
        if shard < mid:
            hi, count = mid, left
        else:
            lo, first, count = mid, first + left, count - left
    return first, count


def scattered(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, n below 2^62: six Feistel rounds on just enough bits, gone through again
    for what falls beyond n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mixed(np.arange(1, 7, dtype=U) + mixed(np.array([key], U)))
    out, todo = i.astype(U), np.arange(len(i))
    while len(todo):
        x = out[todo]
        left, right = x >> U(half), x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, shard_slots: int = 1 << 12, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, blocks, sources).

    Each source's words, its documents in a scattered order, form one stream that is packed into blocks of
    block words; the last one can be short. A source's target is its share of share * all words by weight
    (sources by code point, null last, weigh weights, repeating), at most most times its words. Its slots, as
    many blocks as make up the target, are drawn over the output shards of about shard_slots slots (see
    shard_counts()); slot i takes the block that a pseudorandom permutation of the source's blocks gives for
    i, another one in each pass, and slots and blocks meet by index. So a block is taken once a pass, and no
    document more than most times.

    rows: ka, kb (a hash of id, source and text, 128 bits), copy (of rows that are the same in these, the
    number), id, source, no (of the source), size, start (first word in the stream). blocks: no, block, pass,
    shard: one row for each block taken. sources: source, no, words, target.

    The statistics of the sources (one row each) go to the driver; their number mustn't grow with the
    documents. A null text has no words; documents without words take nothing; repeated rows count as
    rows; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *row_key(docs, id_col, text_col, source_col), WORD_COUNT(F.col(text_col)).alias("size"))
    rows = stored(rows.groupBy("ka", "kb").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")), "sizes")
    n = rows.count()
    each = sorted(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    sizes = [int(r["words"]) for r in each]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(each))], share, most)
    held = [-(-s // block) for s in sizes]
    slots = [slots_for(s, t, block, most) for s, t in zip(sizes, wanted)]
    sources = spark.createDataFrame([(r["source"], i, s, t) for i, (r, s, t) in enumerate(zip(each, sizes, wanted))], "source string, no int, words long, target double")
    # some thousand rows to a bucket; bucket totals are added up by thousands again
    rows = rows.withColumn("bucket", F.pmod("ka", F.lit(max(1, n // 1000)))).alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.no")
    total = F.col("size") * F.col("copies")
    order = Window.partitionBy("no", "bucket").orderBy("ka", "kb")
    within = F.sum(total).over(order.rowsBetween(Window.unboundedPreceding, 0)) - total
    parts = running(rows.groupBy("no", "bucket").agg(F.sum(total).alias("words")), F.col("words"), ["bucket"], F.floor(F.col("bucket") / 4096), by=["no"])
    placed = rows.withColumn("within", within).join(parts.select("no", "bucket", "before"), ["no", "bucket"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(STEP).cast("long"))))
    placed = placed.withColumn("copy", F.explode(F.sequence("copy", F.least(F.col("copy") + STEP, F.col("copies")) - 1)))
    placed = placed.select("ka", "kb", "copy", "id", "source", "no", "size", (F.col("before") + F.col("within") + F.col("copy") * F.col("size")).alias("start"))
    shards, whole = max(1, -(-sum(slots) // shard_slots)), sum(slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            for shard in b.column(0).to_pylist():
                first, count = shard_counts(slots, shards, shard, seed, known)
                for i in np.flatnonzero(count).tolist():
                    slot = np.arange(first[i], first[i] + count[i])
                    turn, at = np.divmod(slot, held[i])
                    took = np.empty(len(slot), np.int64)
                    for t in np.unique(turn).tolist():
                        mine = turn == t
                        took[mine] = scattered(at[mine], held[i], (seed * 1_000_003 + i) * 1_000_003 + t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), i, np.int32)), pa.array(took), pa.array(turn.astype(np.int32)), pa.array(np.full(len(slot), shard, np.int64))], ["no", "block", "pass", "shard"])
                for k in [k for k in known if k[1] <= shard]:
                    del known[k]  # shards come in order

    taken = spark.range(0, shards if whole else 0, 1, max(1, -(-whole // (1 << 18)))).mapInArrow(draw, "no int, block bigint, pass int, shard bigint")
    return placed, taken, sources


def row_key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Two 64-bit hashes that tell rows apart by id, source and text; none is null."""
    of = [F.col(id_col).isNull(), F.col(id_col), F.col(source_col).isNull(), F.col(source_col).cast("string"), F.col(text_col).isNull(), F.col(text_col)]
    return [F.xxhash64(F.lit(k), *of).alias(name) for k, name in ((1, "ka"), (2, "kb"))]


def taken_words(placed: DataFrame, taken: DataFrame, block: int = 64) -> DataFrame:
    """The rows of mix() cut at block bounds, joined by index with the blocks taken: ka, kb, copy, size, and for
    each part of the row in a taken block the words from and to (in the row), the pass and the shard."""
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    cut = cut.select("ka", "kb", "copy", "size", "no", "block", F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("from"), F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("to"))
    # what a shard grows to isn't in the statistics, so a merge join is asked for
    return cut.join(taken.hint("merge"), ["no", "block"]).select("ka", "kb", "copy", "size", "from", "to", "pass", "shard")


def mixed_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, **more) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, shards (of the output, in which parts of it
    stand)."""
    placed, taken, sources = mix(docs, id_col, text_col, source_col, block=block, **more)
    placed = stored(placed, "placed")
    parts = taken_words(placed, taken, block).groupBy("ka", "kb", "copy").agg(F.sum(F.col("to") - F.col("from")).alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    out = placed.join(parts, ["ka", "kb", "copy"], "left").join(sources.select("no", "words", "target"), "no")
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("size"), F.col("words").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, **more) -> DataFrame:
    """The mix as documents, with the columns of docs: for each pass, the words of a document in blocks that
    the pass takes, in their order, with what stands after each word. A document can so have several rows,
    cut or whole. Documents of which no block is taken go; n_chars, if there, is counted anew. Rows that are
    the same in id, source and text are told apart by number; null ids and sources are values like others."""
    placed, taken, _ = mix(docs, id_col, text_col, source_col, block=block, **more)
    parts = taken_words(placed, taken, block)
    cuts = parts.groupBy("ka", "kb", "copy", "size").agg(F.sort_array(F.collect_list(F.struct("pass", "from", "to"))).alias("cuts"))
    ka, kb, nth, made = (fresh(docs, x) for x in ("ka", "kb", "nth", "made"))
    a, b = row_key(docs, id_col, text_col, source_col)
    same = Window.partitionBy(ka, kb).orderBy(kb)
    full = docs.withColumns({ka: a, kb: b}).withColumn(nth, F.row_number().over(same) - 1)
    # numbers are compared by bounds, so that counting and joining share a shuffle by hash
    on = (F.col(f"d.{ka}") == F.col("c.ka")) & (F.col(f"d.{kb}") == F.col("c.kb")) & (F.col(f"d.{nth}") <= F.col("c.copy")) & (F.col(f"d.{nth}") >= F.col("c.copy"))
    both = full.alias("d").join(cuts.alias("c"), on)
    text, size = F.col(f"d.{text_col}"), F.col("c.size")
    whole = lambda mine: F.aggregate(mine, F.lit(0).cast("long"), lambda s, c: s + c["to"] - c["from"]) == size
    part = lambda words, mine: F.array_join(F.flatten(F.transform(mine, lambda c: F.slice(words, (c["from"] + 1).cast("int"), (c["to"] - c["from"]).cast("int")))), "")
    turns = F.transform(F.array_distinct("c.cuts.pass"), lambda p: F.filter("c.cuts", lambda c: c["pass"] == p))
    # a text is split once, and only if some pass takes a part of it
    split = lambda mine: F.when(F.forall(mine, whole), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(PIECES), 0))
    texts = let(turns, lambda t: let(split(t), lambda words: F.transform(t, lambda mine: F.when(whole(mine), F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")).otherwise(part(words, mine)))))
    out = [F.col(f"d.`{c}`") if c not in (text_col, "n_chars") else F.col(made).alias(text_col) if c == text_col else F.char_length(made).cast("long").alias(c) for c in docs.columns]
    return both.withColumn(made, F.explode(texts)).select(*out)
