"""A content-addressed store as tables.

blobs (digest, flags, size): one row for each content; chunks (digest, seq, chunk, size): what each is made of;
payloads (chunk, payload): the bytes, once each. Content in one chunk has that chunk's digest; in more, the digest
of its chunks' digests. Flag 1 says compressed (left to the file format here), flag 2 chunked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetta.functions import content
from posetta.functions.digests import canonical, digest, digest_all, sorted_map
from posetta.plans.session import stored

COMPRESSED, CHUNKED = 1, 2
MIN_SIZE, AVG_SIZE, MAX_SIZE = 1 << 16, 1 << 19, 1 << 21
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def boundaries(data: bytes, least: int = MIN_SIZE, mean: int = AVG_SIZE, most: int = MAX_SIZE) -> list[int]:
    """Ends of the chunks of data, by content: a gear hash of the last 64 bytes (byte i shifted by its age), with
    a stricter condition before the mean size than after it. Empty data is one empty chunk."""
    n = len(data)
    if n <= least:
        return [n]
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(n, np.uint64)
    for age in range(64):
        h[age:] += gear[: n - age] << np.uint64(age)
    bits = max(1, int(mean).bit_length() - 1)
    high = lambda k: np.flatnonzero(h >> np.uint64(64 - min(63, k)) == 0) + 1
    strict, loose = high(bits + 1), high(max(1, bits - 1))
    ends, at = [], 0
    while at < n:
        lo, mid, hi = at + least, at + mean, min(n, at + most)
        i = int(np.searchsorted(strict, lo + 1))
        end = int(strict[i]) if i < len(strict) and strict[i] <= min(mid, hi) else 0
        if not end:
            j = int(np.searchsorted(loose, mid + 1))
            end = int(loose[j]) if j < len(loose) and loose[j] <= hi else hi
        ends.append(min(end, n))
        at = ends[-1]
    return ends


def chunked(contents: DataFrame, id_col: str, content_col: str, sizes: tuple[int, int, int] = (MIN_SIZE, AVG_SIZE, MAX_SIZE)) -> DataFrame:
    """(id, seq, chunk, size, payload) of each row's content, text in UTF-8; null counts as empty."""
    kind = dict(contents.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, seq, parts = [], [], []
            for i, data in enumerate(b.column(1)):
                data = data.as_py() or b""
                start = 0
                for k, end in enumerate(boundaries(data, *sizes)):
                    at.append(i)
                    seq.append(k)
                    parts.append(data[start:end])
                    start = end
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(seq, pa.int64()), pa.array(parts, pa.binary())], ["id", "seq", "payload"])

    rows = contents.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"))
    out = rows.mapInArrow(cut, f"id {kind}, seq bigint, payload binary")
    return out.select("id", "seq", digest(F.col("payload")).alias("chunk"), F.octet_length("payload").cast("long").alias("size"), "payload")


def addressed(chunks: DataFrame) -> DataFrame:
    """(id, digest, flags, size, parts): the address of each content, parts being its chunks in order."""
    parts = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk", "size"))).alias("parts"))
    many = F.size("parts") > 1
    whole = digest_all(F.transform("parts", lambda p: F.unhex(p["chunk"])))
    return parts.select("id", F.when(many, whole).otherwise(F.get("parts", F.lit(0))["chunk"]).alias("digest"), F.when(many, CHUNKED).otherwise(0).alias("flags"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["size"]).alias("size"), "parts")


def put(contents: DataFrame, id_col: str, content_col: str, payloads: DataFrame | None = None, sizes: tuple[int, int, int] = (MIN_SIZE, AVG_SIZE, MAX_SIZE), coded: bool = False) -> dict[str, DataFrame]:
    """What storing the contents gives: addresses (id, digest, flags, size), manifests (digest, seq, chunk, size) of
    contents with more than one chunk, and new payloads (chunk, payload), those not in payloads yet, once each; coded
    ones are compressed where that pays and end with a flag byte. Contents are cut once, and what is cut is written."""
    chunks = stored(chunked(contents, id_col, content_col, sizes), "chunks")
    every = addressed(chunks.drop("payload"))
    manifests = every.where("flags <> 0").select("digest", F.explode("parts").alias("p")).select("digest", "p.seq", "p.chunk", "p.size").distinct()
    new = chunks.select("chunk", "payload").dropDuplicates(["chunk"])
    if payloads is not None:
        new = new.join(payloads.select("chunk"), "chunk", "left_anti")
    return {"addresses": every.drop("parts"), "manifests": manifests, "payloads": content.encoded(new, "payload") if coded else new}


def contains(store: DataFrame, asked: DataFrame, key: str = "digest") -> DataFrame:
    """asked with `found`: whether the store has the digest."""
    return asked.join(store.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def verified(payloads: DataFrame) -> DataFrame:
    """payloads with `valid`: whether the bytes have the digest under which they're kept."""
    return payloads.withColumn("valid", digest(F.col("payload")) == F.col("chunk"))


def get(addresses: DataFrame, manifests: DataFrame, payloads: DataFrame, strict: bool = True, coded: bool = False) -> DataFrame:
    """(digest, content) of the digests in addresses: null if absent. Chunk digests and lengths and the manifest's own
    digest are checked, and, if addresses say the size, that of the whole (else a read would be short); a manifest
    mustn't list another. What fails raises, or, if not strict, has null content."""
    sized = "size" in addresses.columns
    asked = addresses.groupBy("digest").agg(F.max("size" if sized else F.lit(None).cast("long")).alias("whole"))
    held = verified(content.decoded(payloads, "payload") if coded else payloads)
    held = held.join(manifests.select(F.col("digest").alias("chunk")).distinct(), "chunk", "left_anti")
    single = asked.join(held, F.col("digest") == F.col("chunk")).select("digest", F.col("payload").alias("content"), F.col("valid").alias("fine"))
    parts = asked.join(manifests, "digest").join(held, "chunk", "left")
    fine = F.coalesce(F.col("valid") & (F.octet_length("payload") == F.col("size")), F.lit(False))
    listed = parts.withColumn("fine", fine).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk", "payload"))).alias("p"), F.bool_and("fine").alias("fine"))
    own = digest_all(F.transform("p", lambda x: F.unhex(x["chunk"]))) == F.col("digest")
    # an array of binaries is put together in one copy
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["payload"])), ""))
    many = listed.select("digest", data.alias("content"), (F.col("fine") & own).alias("fine"))
    both = single.union(many.join(single.select("digest"), "digest", "left_anti"))
    bad = F.raise_error(F.concat(F.lit("invalid data under "), F.col("digest"))) if strict else F.lit(None)
    short = F.coalesce(F.octet_length("content") == F.col("whole"), F.lit(True))
    both = asked.join(both, "digest", "left").withColumn("fine", F.col("fine") & short)
    return both.select("digest", F.when(F.col("fine"), F.col("content")).when(F.col("fine").isNotNull(), bad.cast("binary")).alias("content"))


def trees(entries: DataFrame, interns: DataFrame | None = None) -> DataFrame:
    """(tree, entries, interns) from entries (tree, ord, name, kind, child): of equal names the last by ord holds,
    names are sorted; interns (tree, digest) are a set."""
    last = entries.groupBy("tree", "name").agg(F.max_by(F.struct("kind", "child"), "ord").alias("node"))
    made = last.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("name", F.col("node.kind").alias("kind"), F.col("node.child").alias("child")))).alias("entries"))
    none = F.array().cast("array<string>")
    if interns is None:
        return made.withColumn("interns", none)
    kept = interns.groupBy("tree").agg(F.array_sort(F.collect_set("digest")).alias("interns"))
    return made.join(kept, "tree", "full").withColumn("interns", F.coalesce("interns", none)).select("tree", "entries", "interns")


def command(program: Column, args: Column, env: Column) -> Column:
    """A command as a struct: arguments in their order, environment sorted by name."""
    return F.struct(program.alias("program"), args.alias("args"), sorted_map(env).alias("env"))


def function(kind: str, command_digest: Column, config_digest: Column) -> Column:
    """An action or a server: what to run, and with what."""
    if kind not in ("action", "server"):
        raise ValueError(kind)
    return F.struct(F.lit(kind).alias("kind"), command_digest.alias("command"), config_digest.alias("config"))


def struct_digest(value: Column) -> Column:
    return digest(canonical(value))


def resolved(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """(root, node, depth): all that can be reached from the roots over edges (parent, child), at the least depth; one
    join a level, on the nodes that are new."""
    seen = stored(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    new = seen
    for depth in range(1, most + 1):
        step = new.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        new = stored(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if new.isEmpty():
            return seen
        seen = seen.union(new)
    raise RuntimeError(f"deeper than {most}")


def packed(payloads: DataFrame, pack_rows: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """(packs, index) of payloads: chunks in digest order, put together in packs of about pack_rows, and for each
    chunk (chunk, pack, offset, length) where it lies. A pack's number is a range of digests."""
    n = payloads.count()
    packs = max(1, -(-n // pack_rows))
    pack = F.floor(F.conv(F.substring("chunk", 1, 8), 16, 10).cast("long") * packs / F.lit(1 << 32)).cast("long")
    rows = payloads.withColumn("pack", pack)
    w = Window.partitionBy("pack").orderBy("chunk")
    size = F.octet_length("payload").cast("long")
    index = rows.withColumn("length", size).withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("chunk", "pack", "offset", "length")
    return rows.select("pack", "chunk", "payload").repartition("pack").sortWithinPartitions("pack", "chunk"), index
