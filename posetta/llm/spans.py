"""Spans of pattern matches as columns: code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from posetta.functions.arrays import bound, running_sums

SPAN = "array<struct<start:bigint,end:bigint,kind:int,hit:string,part:string>>"
#: With the text around a match, up to its neighbours.
SPAN_AROUND = SPAN[:-2] + ",before:string,after:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often the lambdas in use() refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: str, pattern: str, kind: int, part: int = 0, around: int = 0) -> Column:
    """All leftmost non-overlapping matches of pattern in the column of that name: array of (start, end, kind,
    hit, part), part being that group; with around, also so many characters before and after, from the gaps
    to the neighbours. The gaps between matches and the matches themselves alternate, so that running sums of
    their lengths give every position; a text without a match only pays for the test. The pattern mustn't
    match the empty string. (It's built as SQL text because building such trees by calls takes seconds.)"""
    p = "r'" + pattern.replace("'", r"\x27") + "'"
    shape = SPAN_AROUND if around else SPAN
    gap = f"named_struct('n', char_length(g)" + (f", 'before', right(g, {around}), 'after', left(g, {around}))" if around else ")")
    rows = f"arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {part}), transform(split({text}, {p}, -1), g -> {gap}))"
    # the fields of a row are hit, part and gap; the last gap has no match after it
    rows = f"transform({rows}, z -> named_struct('hit', z['0'], 'part', z['1'], 'gap', z['2']))"
    sums = running_sums("steps")
    end = "cast(at + x.gap.n as bigint)"
    one = f"named_struct('start', {end}, 'end', {end} + char_length(x.hit), 'kind', {kind}, 'hit', x.hit, 'part', x.part" + (", 'before', x.gap.before, 'after', x.after)" if around else ")")
    last = "transform(r, (x, i) -> named_struct('hit', x.hit, 'part', x.part, 'gap', x.gap, 'after', get(r, i + 1).gap.after))" if around else "r"
    steps = "transform(r, x -> cast(x.gap.n + coalesce(char_length(x.hit), 0) as bigint))"
    placed = bound("r", rows, f"filter(zip_with({last}, {bound('steps', steps, sums)}, (x, at) -> {one}), x -> x.hit is not null)")
    return F.expr(f"case when {text} rlike {p} then cast({placed} as {shape}) else cast(array() as {shape}) end")


def bare(s: Column) -> Column:
    """A span without the text around it."""
    return F.struct(*[s[x].alias(x) for x in ("start", "end", "kind", "hit", "part")])


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans, by start and then by kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(spans: str, others: str) -> Column:
    """The spans in the column of that name that overlap none of the others: an array of arrays, of spans of one
    kind each, which don't overlap each other and come by start. So halving finds the last one that starts
    before a span's end, and it overlaps the span if any does."""
    half = bound("m", "shiftright(r.lo + r.hi, 1)", "case when r.lo >= r.hi then r when get(o, m).`start` < s.`end` then named_struct('lo', m + 1, 'hi', r.hi) else named_struct('lo', r.lo, 'hi', m) end")
    before = f"aggregate(sequence(0, cast(log2(size(o)) as int)), named_struct('lo', 0, 'hi', size(o)), (r, k) -> {half}, r -> r.lo)"
    free = f"(size(o) = 0 or not coalesce(get(o, {before} - 1).`end` > s.`start`, false))"
    return F.expr(bound("kinds", others, f"filter({spans}, s -> forall(kinds, o -> {free}))"))


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
