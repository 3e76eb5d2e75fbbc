"""Content digests: sha-256 over parts, each after its length as eight bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def framed(content: Column) -> Column:
    """Length and content of one part, as bytes; strings count in UTF-8."""
    b = content.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b)


def digest(*parts: Column) -> Column:
    """Lower-case hex digest of the parts in their order; of none, that of nothing. A null part makes it null."""
    return F.sha2(F.concat(*[framed(p) for p in parts]) if parts else F.lit("").cast("binary"), 256)


def digest_all(parts: Column) -> Column:
    """The same of an array of binaries."""
    return F.sha2(F.aggregate(parts, F.lit("").cast("binary"), lambda a, p: F.concat(a, framed(p))), 256)


def canonical(value: Column, kind: DataType | None = None) -> Column:
    """One text for equal values: JSON with fields in the type's order and, if the value's type is given, maps as
    entries sorted by key, however deep they lie (without the type, the value mustn't hold maps). Digests of
    structs are digests of this; it isn't the binary form of any other system."""
    value = value if kind is None else without_maps(value, kind)
    return F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})


def without_maps(value: Column, kind: DataType) -> Column:
    """value with every map in it as an array of entries sorted by key; null stays null."""
    if isinstance(kind, MapType):
        entries = F.transform(sorted_map(value), lambda e: F.struct(e["key"].alias("key"), without_maps(e["value"], kind.valueType).alias("value")))
        return entries
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: without_maps(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[without_maps(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def sorted_map(m: Column) -> Column:
    """A map as entries sorted by key, so that it compares, groups and hashes."""
    return F.array_sort(F.map_entries(m))
