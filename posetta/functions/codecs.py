"""Integer and bit-block codecs as columns; bytes are shown as lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_VARINT = {16: 3, 32: 5, 64: 10}


def one(n: int | Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n if isinstance(n, Column) else F.lit(n))


def bit_length(x: Column) -> Column:
    """Bits up to the highest set one, 64 for negative longs, 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def byte_hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))


def varint_length(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bit_length(x) / 7)).cast("long")


def varint(x: Column) -> Column:
    """Base-128, low group first, with a continuation bit on all but the last byte; a negative long counts as its
    unsigned pattern."""
    n = varint_length(x).cast("int")
    group = lambda i: F.call_function("shiftrightunsigned", x, (i * 7).cast("int")).bitwiseAND(F.lit(127))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte_hex(F.when(i < n - 1, group(i) + 128).otherwise(group(i)))), "")


def hex_bytes(text: Column) -> Column:
    """The bytes of a hex string as numbers, none of an empty one."""
    return F.transform(F.regexp_extract_all(text, F.lit("(..)"), 1), lambda x: F.conv(x, 16, 10).cast("long"))


def varint_decode(text: Column, bits: int = 64) -> Column:
    """(value, length) of the varint at the start of hex bytes; value is null and length 0 if they end too early,
    and value null and length that of the bytes read if it doesn't fit."""
    most = MAX_VARINT[bits]
    b = hex_bytes(text)
    last = F.array_position(F.transform(b, lambda x: x < 128), F.lit(True))
    used = F.slice(b, 1, F.greatest(last, F.lit(1)).cast("int"))
    room = bits - 7 * (most - 1)
    fits = (last < most) | ((last == most) & (F.get(b, F.lit(most - 1)) < (1 << room)))
    value = F.aggregate(F.transform(used, lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(127)), F.least(i * 7, F.lit(63)).cast("int"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    none = (F.length(text) < 2) | ((last == 0) & (F.size(b) < most))
    return F.when(none, F.struct(F.lit(None).cast("long").alias("value"), F.lit(0).cast("long").alias("length"))).otherwise(
        F.struct(F.when((last > 0) & fits, value).alias("value"), F.when(last > 0, F.least(last, F.lit(most))).otherwise(most).cast("long").alias("length"))
    )


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    low = x.bitwiseAND(F.lit(1))
    return F.call_function("shiftrightunsigned", x, F.lit(1)).bitwiseXOR(F.when(low == 1, F.lit(-1)).otherwise(F.lit(0)).cast("long"))


def scalar_length(x: Column) -> Column:
    """Bytes of a 32-bit number without leading zero bytes, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(bit_length(x) / 8)).cast("long")


def scalar(x: Column) -> Column:
    """A 32-bit number's bytes, lowest first, without leading zeros."""
    return F.array_join(F.transform(F.sequence(F.lit(0), (scalar_length(x) - 1).cast("int")), lambda i: byte_hex(F.call_function("shiftrightunsigned", x, (i * 8).cast("int")).bitwiseAND(F.lit(255)))), "")


def stream_encode(xs: Column) -> Column:
    """(data, control) of an array of 32-bit numbers: bytes of all, and for each four numbers a byte of their
    lengths less 1, two bits each, the first lowest; a last group that is short counts zeros that aren't written."""
    data = F.array_join(F.transform(xs, scalar), "")
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / 4).cast("int") - 1), lambda g: F.slice(xs, g * 4 + 1, F.lit(4)))
    byte = lambda g: F.aggregate(F.transform(g, lambda x, i: F.call_function("shiftleft", scalar_length(x) - 1, (i * 2).cast("int"))), F.lit(0).cast("long"), lambda a, x: a + x)
    control = F.when(F.size(xs) == 0, "").otherwise(F.array_join(F.transform(groups, lambda g: byte_hex(byte(g))), ""))
    return F.struct(F.when(F.size(xs) == 0, "").otherwise(data).alias("data"), control.alias("control"))


def stream_decode(data: Column, control: Column, n: Column) -> Column:
    """The n numbers of stream_encode(). The bytes are in the fold's state, so that they're parsed once."""

    def step(s: Column, i: Column) -> Column:
        code = F.call_function("shiftrightunsigned", F.get(s["ctl"], F.floor(i / 4).cast("int")), ((i % 4) * 2).cast("int"))
        length = (code.bitwiseAND(F.lit(3)) + 1).cast("int")
        value = F.aggregate(F.transform(F.slice(s["raw"], s["at"] + 1, length), lambda x, k: F.call_function("shiftleft", x, (k * 8).cast("int"))), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct(s["ctl"].alias("ctl"), s["raw"].alias("raw"), (s["at"] + length).alias("at"), F.concat(s["out"], F.array(value)).alias("out"))

    start = F.struct(hex_bytes(control).alias("ctl"), hex_bytes(data).alias("raw"), F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(F.sequence(F.lit(0), n.cast("int") - 1), start, step, lambda s: s["out"]))


def combinations(size: int) -> Column:
    """Row b, column c: ways to choose c of b, 0 <= b, c < size."""
    row, rows = [1] + [0] * size, []
    for _ in range(size + 1):
        rows.append(row[: size + 1])
        row = [1] + [row[k - 1] + row[k] for k in range(1, size + 1)]
    return F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])


def rrr_encode(x: Column, size: int = 15) -> Column:
    """(class, offset) of the low `size` bits: how many are set, and the rank of the pattern among those with as
    many, counted from the highest bit down."""
    data, comb = x.cast("long").bitwiseAND(F.lit((1 << size) - 1)), combinations(size)
    ones = F.bit_count(data).cast("long")

    def step(s: Column, b: Column) -> Column:
        hit = (data.bitwiseAND(one(b)) != 0) & (s["c"] > 0)
        return F.struct(F.when(hit, s["c"] - 1).otherwise(s["c"]).alias("c"), F.when(hit, s["o"] + F.get(F.get(comb, b), s["c"].cast("int"))).otherwise(s["o"]).alias("o"))

    offset = F.aggregate(F.sequence(F.lit(size - 1), F.lit(0)), F.struct(ones.alias("c"), F.lit(0).cast("long").alias("o")), step, lambda s: s["o"])
    return F.struct(ones.alias("class"), offset.alias("offset"))


def rrr_decode(cls: Column, offset: Column, size: int = 15) -> Column:
    comb = combinations(size)

    def step(s: Column, b: Column) -> Column:
        ways = F.get(F.get(comb, b), s["c"].cast("int"))
        hit = (s["c"] > 0) & (s["o"] >= ways)
        return F.struct(F.when(hit, s["c"] - 1).otherwise(s["c"]).alias("c"), F.when(hit, s["o"] - ways).otherwise(s["o"]).alias("o"), F.when(hit, s["v"] + one(b)).otherwise(s["v"]).alias("v"))

    start = F.struct(cls.cast("long").alias("c"), offset.cast("long").alias("o"), F.lit(0).cast("long").alias("v"))
    return F.aggregate(F.sequence(F.lit(size - 1), F.lit(0)), start, step, lambda s: s["v"])


def class_size(size: int) -> int:
    """Bits that hold a class of blocks of that size."""
    return size.bit_length()


def reverse_byte(x: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x.cast("long")), 8, "0")), 2, 10).cast("long")
