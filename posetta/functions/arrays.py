"""Arrays in SQL text: names for values, and running sums in time linear in the array."""

from __future__ import annotations

#: Elements whose running sum is built at once; see running_sums().
CHUNK = 256


def bound(name: str, value: str, use: str) -> str:
    """SQL: use, in which name is value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def running_sums(x: str) -> str:
    """SQL: sums of all elements of x, an array of longs that isn't empty, before each one. Arrays can't be changed
    in place and an append copies them, so appends are made to chunks of CHUNK sums, and to an array of one
    sum for each chunk."""
    start = lambda at: f"named_struct('at', {at}, 'sums', cast(array() as array<bigint>))"
    append = "(s, v) -> named_struct('at', s.at + v, 'sums', concat(s.sums, array(s.at))), s -> s.sums"
    firsts = f"aggregate(transform(chunks, y -> aggregate(y, 0L, (a, b) -> a + b)), {start('0L')}, {append})"
    sums = f"flatten(transform(chunks, (y, k) -> aggregate(y, {start('firsts[k]')}, {append})))"
    chunks = f"transform(sequence(0, cast(floor((size({x}) - 1) / {CHUNK}) as int)), k -> slice({x}, k * {CHUNK} + 1, {CHUNK}))"
    return bound("chunks", chunks, bound("firsts", firsts, sums))
