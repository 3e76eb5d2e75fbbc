"""Secret scans (operator 1), DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetta.llm.spans import SPAN, apart, joined, let, matches, of_kind

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs under 24 fail the length test anyway, so only longer ones are looked at.
HEX_LONG = r"(?:(?<![0-9a-f])|\G)[0-9a-f]{24,}+"
CANDIDATE = r"(?:(?<![A-Za-z0-9+/_=-])|\G)[A-Za-z0-9+/_=-]{20,}+"
#: Candidates that aren't secrets: identifiers with a fixed layout, digits only, paths and rulers.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^/?(?:[A-Za-z0-9_-]{1,15}/)+[A-Za-z0-9_-]{0,15}$",
    r"(?i)(?:^|[^a-z0-9])(?:example|sample|dummy|placeholder|changeme|x{4,})(?:$|[^a-z0-9])",
]
#: What looks like dictionary words, with what stands between them; words have vowels and at most 16 letters.
WORDS = r"(?:[A-Z]?[a-z]{2,16}|[A-Z]{2,16})(?![a-z])|[+/_=-]+"
HARSH = r"(?i)[b-df-hj-np-tv-xz]{6}"
#: Character class, its pattern, and the bits a character that a window must reach.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9)]
#: Windows of a candidate that are looked at in one go; a long one is cut into so many, with an overlap.
PIECE = 512


def entropy_windows(text: Column, width: int, least: Column) -> Column:
    """(from, to) of the windows of that width, first to last, whose Shannon entropy reaches least bits a
    character; null if none does. text has characters of ASCII only.

    The characters are split once. Each piece of PIECE windows is read once: the entering and the leaving
    character change their own counts, and the sum of c * log2(c) by the difference at those two counts;
    entropy is log2(width) - sum / width. Counts are kept in a few longs, some bits for each character, so
    that a step copies those and not an array of all counts. So the work is in proportion to the length."""
    bits = width.bit_length() + 1
    per = 62 // bits
    slots = -(-128 // per)
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    mask = (1 << bits) - 1

    def piece(codes: Column, lo: Column, n: Column, bound: Column) -> Column:
        held = lambda counts, c: F.call_function("shiftright", F.get(counts, F.floor(c / per).cast("int")), (c % per) * bits).bitwiseAND(F.lit(mask)).cast("int")
        unit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c % per) * bits)

        def step(s: Column, i: Column) -> Column:
            """i: the entering character's number."""
            new, old = F.get(codes, i), F.when(i - lo >= width, F.get(codes, i - width)).otherwise(F.lit(-1))

            def moved(p: Column) -> Column:
                new, old = p["new"], p["old"]
                a, b = held(s["counts"], new), F.when(old >= 0, held(s["counts"], old)).otherwise(F.lit(0))
                total = s["sum"] + F.when(new == old, F.lit(0.0)).otherwise(F.get(f, a + 1) - F.get(f, a) + F.when(old >= 0, F.get(f, b - 1) - F.get(f, b)).otherwise(F.lit(0.0)))
                counts = F.transform(s["counts"], lambda c, k: c + F.when(k == F.floor(new / per), unit(new)).otherwise(F.lit(0)) - F.when((old >= 0) & (k == F.floor(old / per)), unit(old)).otherwise(F.lit(0)))
                counts = F.when(new == old, s["counts"]).otherwise(counts)
                return F.struct(counts.alias("counts"), total.alias("sum"))

            def marked(t: Column) -> Column:
                hit = (i - lo + 1 >= width) & (F.lit(width * math.log2(width)) - t["sum"] >= bound * width)
                return F.struct(t["counts"].alias("counts"), t["sum"].alias("sum"), F.when(s["first"].isNull() & hit, i - width + 1).otherwise(s["first"]).alias("first"), F.when(hit, i + 1).otherwise(s["last"]).alias("last"))

            return let(let(F.struct(new.alias("new"), old.alias("old")), moved), marked)

        none = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), slots).alias("counts"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"))
        end = F.least(lo + PIECE + width - 2, n - 1)
        return F.aggregate(F.sequence(lo, end), start, step, lambda s: F.struct(s["first"].alias("from"), s["last"].alias("to")))

    def windows(p: Column) -> Column:
        n = F.size(p["codes"])
        firsts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(PIECE))
        found = F.filter(F.transform(firsts, lambda lo: piece(p["codes"], lo, n, p["bound"])), lambda w: w["from"].isNotNull())
        return let(found, lambda w: F.when(F.size(w) > 0, F.struct(F.get(w, F.lit(0))["from"].alias("from"), F.element_at(w, -1)["to"].alias("to"))))

    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.when(F.char_length(text) >= width, let(F.struct(codes.alias("codes"), least.alias("bound")), windows))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, candidate: str = CANDIDATE) -> DataFrame:
    """One row per row of docs: id, base and added (arrays of spans: start, end, kind as an index of KINDS,
    hit).

    base has assignments, access keys and long hexadecimal strings by pattern. added has what the method
    finds beside them: in candidate strings, windows of width characters whose Shannon entropy reaches the
    bound of the string's character class, unless the string is allow-listed or overlaps a base span; the
    span runs from the first such window to the last.

    A null text counts as empty and has no spans; repeated rows and null ids each get their row; an empty
    table gives no rows; only the two named columns are read. Work is in proportion to a text's length and
    its matches."""
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    assign = F.filter(matches("_t", ASSIGN, 0, 2), lambda s: F.char_length(s["part"]) >= 6)
    access = F.filter(matches("_t", ACCESS, 1), lambda s: F.char_length(s["hit"]) >= 20)
    found = texts.select("_id", F.array(assign, access, matches("_t", HEX_LONG, 2)).alias("_kinds"), matches("_t", candidate, 3).alias("_cand"))
    words = lambda s: F.regexp_like(s["hit"], F.lit(r"^[A-Za-z+/_=-]+$")) & ~F.regexp_like(s["hit"], F.lit(HARSH)) & (F.regexp_replace(s["hit"], WORDS, "") == "")
    allowed = lambda s: F.exists(F.array(*[F.lit(p) for p in ALLOWED]), lambda p: F.regexp_like(s["hit"], p)) | words(s)

    def bound(s: Column) -> Column:
        out = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            out = F.when(s["hit"].rlike(pattern), F.lit(bits)).otherwise(out)
        return out

    good = F.filter(apart("_cand", "_kinds"), lambda s: ~allowed(s))
    seen = F.transform(good, lambda s: F.struct(s.alias("s"), entropy_windows(s["hit"], width, bound(s)).alias("w")))
    secret = F.transform(F.filter(seen, lambda x: x["w"].isNotNull()), lambda x: F.struct((x["s"]["start"] + x["w"]["from"]).cast("long").alias("start"), (x["s"]["start"] + x["w"]["to"]).cast("long").alias("end"), F.lit(3).alias("kind"), x["s"]["hit"].alias("hit"), x["s"]["hit"].alias("part"))).cast(SPAN)
    added = F.when(F.size("_cand") > 0, secret).otherwise(F.array().cast(SPAN))
    return found.select(F.col("_id").alias(id_col), F.flatten("_kinds").alias("base"), added.alias("added"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of scan_secrets()."""
    base, every = F.col("base"), F.concat(F.col("base"), F.col("added"))
    return found.select(
        id_col,
        of_kind(base, 0).alias("n_assign"),
        of_kind(base, 1).alias("n_access"),
        of_kind(base, 2).alias("n_hex"),
        of_kind(F.col("added"), 3).alias("n_entropy"),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(every, KINDS).alias("spans"),
    )
