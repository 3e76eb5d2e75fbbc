"""Line dedup by winnowing (operator 2), DataFrame functions only.

A run of lines is worth finding from `words` words on. So a window is a line and the next ones, or the ones
before it, up to that many words in all; a long line is a window of its own, and short ones share one. Of
each window the line with the least hash is its fingerprint. A repeated run of that many words has the same
windows in both places, each of its lines is in one of them, and so it has common fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetta.llm.spans import let
from posetta.llm.words import WORD_COUNT
from posetta.plans.session import stored


def windows(hashes: Column, more: Column, sizes: Column, words: int) -> Column:
    """Array of (g, w, lo, hi): for each window of a sequence of lines, first and last line, its fingerprint
    (the least line hash) and a hash of all of it (of a single line its own), from other hashes of the lines.
    sizes are the lines' words, one at least, so that no window has more than `words` lines."""
    n = F.size(hashes)

    def span(i: Column, step: int) -> Column:
        """How many lines a window that begins at i has, going forward (step 1) or back; 0 if there are too few."""
        size = lambda k: F.coalesce(F.get(sizes, i + step * k), F.lit(0)) if step > 0 else F.when(i >= k, F.get(sizes, i - k)).otherwise(F.lit(0))
        look = lambda s, k: F.when(s["sum"] >= words, s).otherwise(F.struct((s["sum"] + size(k)).alias("sum"), (s["n"] + 1).alias("n")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(words - 1)), F.struct(F.get(sizes, i).alias("sum"), F.lit(1).alias("n")), look, lambda s: F.when(s["sum"] >= words, s["n"]).otherwise(F.lit(0)))

    def at(i: Column) -> Column:
        ahead, back = span(i, 1), span(i, -1)
        one = lambda lo, m: F.struct(F.array_min(F.slice(hashes, lo + 1, m)).alias("g"), F.xxhash64(F.slice(more, lo + 1, m)).alias("w"), lo.alias("lo"), (lo + m - 1).alias("hi"))
        both = let(F.struct(ahead.alias("a"), back.alias("b")), lambda p: F.filter(F.array(F.when(p["a"] > 0, one(i, p["a"])), F.when(p["b"] > 1, one(i - p["b"] + 1, p["b"]))), lambda w: w.isNotNull()))
        # a line with words enough needs no look at others
        single = F.array(F.struct(F.get(hashes, i).alias("g"), F.get(more, i).alias("w"), i.alias("lo"), i.alias("hi")))
        return F.when(F.get(sizes, i) >= words, single).otherwise(both if words > 1 else F.array())

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per row of docs: id, n_lines, removed (line numbers from 0, ascending), clean (the text without
    them).

    Runs of lines with `words` words or more that stand earlier (by id, null first, then by the text's hash,
    then by line) go, however the earlier copies are spread: each window's fingerprint is joined with the
    first position of the same window, and from it the match is extended both ways to the window's ends, and
    on over the windows that follow. All lines of such a run are in windows that stand in the earlier copy
    too, so none is missed; a line only goes if it stands earlier in such a run, so the first copy of each
    line stays. Shorter lines that repeat on their own (headings, brackets) stay.

    Lines are compared byte by byte through two 64-bit hashes; blank lines are skipped over and always stay.
    Positions are reduced to the first one before they are shuffled, so that a line that very many documents
    have doesn't meet in one task, and the rows that refer to it are split by the adaptive skew join. Null
    texts count as empty; an empty text is one blank line. Rows with the same id and text count as one
    document, and each gets its result. An empty table gives no rows; only the two named columns are read."""
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    enough = rf"^{gap}*+(?:{word}++{gap}++){{{words - 1}}}{word}"  # looks no further than it must
    count = lambda x: F.when(x.rlike(enough), F.lit(words)).otherwise(WORD_COUNT(x)).cast("int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    solid = F.filter(F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("m"), i.alias("line"), count(x).alias("n"))), lambda x: x["n"] > 0)
    rows = full.select("id", "th", solid.alias("s")).select(F.struct("id", "th").alias("d"), F.col("s.h").alias("h"), F.col("s.m").alias("m"), F.col("s.n").alias("n"), F.col("s.line").alias("line")).where(F.size("h") > 0)
    rows = stored(rows, "line-hashes")
    marks = rows.select("d", "line", F.explode(windows(F.col("h"), F.col("m"), F.col("n"), words)).alias("f"))
    marks = stored(marks.select("d", F.col("f.g").alias("g"), F.col("f.w").alias("w"), F.get("line", F.col("f.lo")).alias("lo"), F.slice("line", F.col("f.lo") + 1, F.col("f.hi") - F.col("f.lo") + 1).alias("lines")), "fingerprints")
    first = marks.groupBy("g", "w").agg(F.min(F.struct("d", "lo")).alias("a"), F.max(F.struct("d", "lo")).alias("z")).where("a <> z").select("g", "w", "a")
    met = marks.join(first, ["g", "w"]).where(F.struct("d", "lo") != F.col("a"))
    gone = met.select("d", F.explode("lines").alias("line")).groupBy("d").agg(F.sort_array(F.collect_set("line")).alias("removed")).select("d.id", "d.th", "removed")
    out = full.alias("f").join(gone.alias("g"), F.col("f.id").eqNullSafe(F.col("g.id")) & (F.col("f.th") == F.col("g.th")), "left").select("f.id", "t", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    stays = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed"))
    clean = let(F.split("t", "\n", -1), lambda x: F.array_join(F.transform(stays(x), lambda i: F.get(x, i)), "\n"))
    lines = F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1
    return out.select(F.col("id").alias(id_col), lines.cast("long").alias("n_lines"), "removed", F.when(F.size("removed") == 0, F.col("t")).otherwise(clean).alias("clean"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), F.sha2("clean", 256).alias("clean_sha256"))
