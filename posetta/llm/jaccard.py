"""N-gram Jaccard join by parity sketches (operator 6).

For sets of a and b shingles, a similarity of at least p/q bounds the symmetric difference: it has at most
(q - p) (a + b) / (q + p) elements, (a + b) / 9 at 4/5. Each element flips one bit of a parity sketch, so
two sketches differ in at most as many bits as the sets in elements, and in at most as many blocks of bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posetta.llm.shingles import U, mixed, runs, shingle_hashes, word_hashes
from posetta.llm.words import arrow_kind, released, slot_bitmap
from posetta.operators.components import components, joined
from posetta.plans.session import dropped, stored

SLOTS, SLICES = 1 << 18, 16
SKETCH_WORDS = 16
KEYS_A_PART = 500_000
#: Classes that a task remembers, so as to tell copies once; beyond it, it forgets them, and copies are told again.
REMEMBERED = 100_000


def band_edges(most: int, num: int, den: int) -> np.ndarray:
    """Least sizes of the bands: a set's partner of no smaller size is in its own band or the next."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return np.array([*out, out[-1] * den // num + 1], np.int64)


def group_shape(edges: np.ndarray, g: int, num: int, den: int) -> tuple[int, int, int]:
    """(blocks, keys, needed) of group g, which holds the sets of bands g and g + 1. Pairs with the smaller set in
    band g differ in d elements at most, so that of m blocks m - d at least are equal. Each set has d + r of its
    blocks as keys and leaves out m - d - r; by the same order for all, so r of the equal ones are keys of both."""
    top = int(edges[g + 1]) - 1
    d = (den - num) * (top + top * den // num) // (den + num)
    m = max(d + 4, -(-2 * top // 5))
    r = max(4, (m - d) // 2)
    return m, d + r, r


def block_keys(s: np.ndarray, light: np.ndarray, edges: np.ndarray, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """(group, side, keys) of a set for the group of its band (side 0) and that of the band below (side 1).

    The sketch of a group has that many blocks of 2^64 bits; a block is known by its parities, hashed. Blocks
    are ordered by how many rare shingles they have, then how many shingles, then by hash, and the first are
    keys: an order by what a block holds, the same for all sets."""
    band = int(np.searchsorted(edges, len(s), "right")) - 1
    out = []
    for g in range(band, max(-1, band - 2), -1):
        m, keys, _ = group_shape(edges, g, num, den)
        h = mixed(s ^ U(0xA5A5 + g))
        block = (h % U(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        count = np.bincount(block, minlength=m)
        parity = np.zeros(m, U)
        there = np.flatnonzero(count)
        parity[there] = np.bitwise_xor.reduceat(mixed(h)[order], np.concatenate([[0], np.cumsum(count[there])[:-1]]))
        pattern = mixed(parity + (np.arange(m, dtype=U) + U(g << 32)) * U(0x9E3779B97F4A7C15))
        rare = np.bincount(block, light, minlength=m)
        rank = (np.minimum(rare, 31).astype(U) << U(59)) | (np.minimum(count, 31).astype(U) << U(54)) | (pattern >> U(10))
        out.append((g, band - g, pattern[np.argpartition(rank, m - keys)[m - keys :]] if m > keys else pattern))
    return out


def parity_sketch(s: np.ndarray) -> bytes:
    """1024 bits, each the parity of the number of elements hashed to it."""
    bit = (mixed(s ^ U(0x5EED)) % U(64 * SKETCH_WORDS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)).tobytes()


def shingle_sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its distinct shingle hashes in order)."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    for lo, hi in runs(data):
        words, at = word_hashes(data[lo:hi])
        for i in range(hi - lo):
            yield lo + i, np.unique(shingle_hashes(words[at[i] : at[i + 1]], width))


def class_of(s: np.ndarray) -> int:
    """Fingerprint of a set."""
    both = mixed(s ^ U(0xC1A55)).sum(keepdims=True) + mixed(s).sum(keepdims=True) * U(len(s) * 2 + 1)
    return int(both.view(np.int64)[0]) if len(s) else 0


def shingle_classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, c, slice, counts): id, set size and class of each row; and, without an id, what each task has
    counted of hashed shingles, in slices."""
    kind = dict(docs.dtypes)[id_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.uint32)
        for b in batches:
            n, c = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, s in shingle_sets(b.column(1).to_pylist(), width):
                n[i], c[i] = len(s), class_of(s)
                seen[(s % U(SLOTS)).astype(np.int64)] += 1
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(c), none.cast(pa.int32()), none.cast(pa.binary())], ["id", "n", "c", "slice", "counts"])
        parts = np.split(seen, SLICES)
        none = pa.nulls(SLICES)
        yield pa.RecordBatch.from_arrays([none.cast(ids), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["id", "n", "c", "slice", "counts"])

    ids = arrow_kind(docs, id_col)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(released(apply), f"id {kind}, n bigint, c bigint, slice int, counts binary")


def heavy_slots(made: DataFrame) -> np.ndarray:
    """Hash slots whose shingles are far more frequent than the mean, as booleans: of a fixed size, however
    large the table. They only change which blocks come first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(blob, np.uint32).astype(np.int64)
                total[k] = total[k] + part if k in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "counts"])

    got = made.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, SLOTS // SLICES), np.int64)
    for r in got:
        counts[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    return counts > counts.mean() + 8 * np.sqrt(counts.mean()) + 32


def candidate_pairs(docs: DataFrame, text_col: str, width: int, heavy: np.ndarray, edges: np.ndarray, parts: int, num: int, den: int, small: int) -> DataFrame:
    """(gid, a, b, g, n). Of a key that up to `small` classes have, all pairs with one on side 0, n being how
    many such keys a and b share here, and gid null; of any other key its members as a, n being how many keys
    have just these members, gid standing for them, and b for the side."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose: list[tuple[int, int, int]] = []
        keys: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate(keys)
            own = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            part = ((key & U(0xFFFFFFFF)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, key, own = part[order], (key[order] >> U(32)).astype(np.uint32), own[order]
            cut = np.flatnonzero(np.r_[True, np.diff(part) != 0, True])
            of, at = np.array([w[0] for w in whose], np.int64), np.array([w[1] * 2 + w[2] for w in whose], np.uint16)
            rows: list = []
            for lo, hi in zip(cut, cut[1:]):
                who, times = np.unique(own[lo:hi], return_counts=True)
                rows.append((int(part[lo]), of[who].tobytes(), at[who].tobytes(), times.astype(np.uint16 if times.max() < 65536 else np.uint32).tobytes(), key[lo:hi].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["part", "classes", "places", "times", "keys"])

        for b in batches:
            for _, s in shingle_sets(b.column(0).to_pylist(), width):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)  # copies in one task are told once
                for g, side, k in block_keys(s, (~heavy[(s % U(SLOTS)).astype(np.int64)]).astype(float), edges, num, den):
                    whose.append((c, g, side))
                    keys.append(k)
                    held += len(k)
                if held > 4 * KEYS_A_PART:
                    yield flush()
                    whose, keys, held = [], [], 0
        if keys:
            yield flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for part, who, at, times, key in zip(*(b.column(k).to_pylist() for k in range(5))):
                who = np.frombuffer(who, np.int64)
                times = np.frombuffer(times, np.uint16 if len(times) == 2 * len(who) else np.uint32)
                got.setdefault(part, []).append((np.repeat(who, times), np.repeat(np.frombuffer(at, np.uint16), times), np.frombuffer(key, np.uint32)))
        for blobs in got.values():
            who, at, key = (np.concatenate(x) for x in zip(*blobs))
            blobs.clear()
            order = np.lexsort((who, at, key))
            who, at, key = who[order], at[order], key[order]
            # a key is of one group: the same 32 bits in two groups are two keys
            new = np.r_[True, (np.diff(key) != 0) | (np.diff(at >> 1) != 0)]
            again = np.r_[False, ~new[1:] & (np.diff(who) == 0)]
            who, at, new = who[~again], at[~again], new[~again]
            cut = np.r_[np.flatnonzero(new), len(who)]
            size = np.diff(cut)
            lo, k = cut[:-1][size > 1], size[size > 1]
            pairs: list[np.ndarray] = []
            for w in np.unique(k[k <= small]):
                rows = lo[k == w][:, None] + np.arange(w)
                i, j = np.triu_indices(w, 1)
                x, y = rows[:, i].ravel(), rows[:, j].ravel()
                keep = (at[x] & 1) + (at[y] & 1) < 2  # two of the upper band meet in their own group
                x, y = x[keep], y[keep]
                pairs.append(np.stack([np.minimum(who[x], who[y]), np.maximum(who[x], who[y]), (at[x] >> 1).astype(np.int64)], 1))
            if pairs and len(p := np.concatenate(pairs)):
                p, n = np.unique(p, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(p)).cast(pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(n.astype(np.int64))], ["gid", "a", "b", "g", "n"])
            told: dict[tuple[int, int], list] = {}
            for start, w in zip(lo[k > small], k[k > small]):
                members = who[start : start + w]
                told.setdefault((class_of(members.view(U)), int(at[start] >> 1)), [start, w, 0])[2] += 1
            for (gid, g), (start, w, n) in told.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(w, gid)), pa.array(who[start : start + w]), pa.array((at[start : start + w] & 1).astype(np.int64)), pa.array(np.full(w, g)), pa.array(np.full(w, n))], ["gid", "a", "b", "g", "n"])

    blobs = docs.select(text_col).mapInArrow(released(keyed), "part int, classes binary, places binary, times binary, keys binary")
    # a part is a partition, so that a task holds one
    return blobs.repartitionById(parts, F.col("part")).mapInArrow(released(met), "gid bigint, a bigint, b bigint, g bigint, n bigint")


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(c, n, sketch, shingles) of the classes in wanted (c, rep). A bitmap of hashed ids, at most 16 MB however
    many there are, spares most other texts the work; the join then decides."""
    n = wanted.count()
    bits = 1 << min(27, max(16, (16 * n).bit_length()))
    bitmap = docs.sparkSession.sparkContext.broadcast(slot_bitmap(wanted, "rep", bits))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(1).to_numpy()
            at = np.flatnonzero((bitmap.value[p // 64] >> (p % 64).astype(U)) & U(1))
            some = b.take(pa.array(at))
            rows = [(class_of(s), len(s), parity_sketch(s), s.tobytes()) for _, s in shingle_sets(some.column(2).to_pylist(), width)]
            if rows:
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary())))], ["id", "c", "n", "sketch", "shingles"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(bits)).alias("p"), F.col(text_col).alias("t"))
    rows = rows.mapInArrow(released(apply), f"id {kind}, c bigint, n bigint, sketch binary, shingles binary")
    # dealt by class alone, so that the join and the choice of one row share a shuffle
    same = (F.col("r.c") == F.col("w.c")) & (F.col("r.id") >= F.col("w.rep")) & (F.col("r.id") <= F.col("w.rep"))
    return rows.alias("r").join(wanted.alias("w"), same, "left_semi").select("c", "n", "sketch", "shingles").dropDuplicates(["c"])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that are as similar as asked. Sketches, which differ in no more bits than
    the sets in elements, spare most others the exact count."""
    few = sets.select("c", "n", "sketch")
    near = pairs.join(few.toDF("a", "na", "ka"), "a").join(few.toDF("b", "nb", "kb"), "b")
    near = near.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (3, 5))
            differ = np.bitwise_count(x ^ y).sum(1)
            size = b.column(2).to_numpy() + b.column(4).to_numpy()
            at = pa.array(np.flatnonzero(differ * (den + num) <= size * (den - num)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    near = near.select("a", "b", "na", "ka", "nb", "kb").mapInArrow(released(close), "a bigint, b bigint")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    full = sets.select("c", "shingles")
    return near.join(full.toDF("a", "xa"), "a").join(full.toDF("b", "xb"), "b").select("a", "b", "xa", "xb").mapInArrow(released(exact), "a bigint, b bigint")


def around_hubs(open_: DataFrame, sets: DataFrame, edges: np.ndarray, num: int, den: int) -> DataFrame:
    """(a, b): pairs of different components that can be as similar as asked, among classes near the same hub. open_:
    (hub, g, c, side, of), of being the component; each class has been held against its hub.

    For a hub P, x and y differ in the same elements as R(x) = x ^ P and R(y) do, so that R(x) and R(y) have
    (|R(x)| + |R(y)| - d) / 2 elements in common, d being the most in which x and y may differ. In one order of all
    elements, those not in P first, the first few of both then share one; how few follows from the sizes. Copies
    that were edited on their own share what they lost with many, but what they gained with hardly any.

    Where that number isn't positive, |R(x)| + |R(y)| <= d: the smaller of the two is linked with P itself, and the
    other one links with it, and so with the one class of P's component that allows for the most."""
    shapes = [group_shape(edges, g, num, den) for g in range(len(edges) - 1)]
    most = np.array([k - r for _, k, r in shapes])

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gap, first = [], [], []
            for g, p, x in zip(b.column(1).to_pylist(), b.column(5), b.column(6)):
                p, x = np.frombuffer(p.as_buffer(), U), np.frombuffer(x.as_buffer(), U)
                new, lost = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                size.append(len(x))
                gap.append(len(new) + len(lost))
                first.append(np.concatenate([new, lost])[: most[g] + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(size, pa.int64()), pa.array(gap, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["hub", "g", "c", "side", "of", "n", "r", "e"])

    full = sets.select("c", "shingles")
    rows = open_.join(full.toDF("hub", "p"), "hub").join(full.toDF("c", "x"), "c").select("hub", "g", "c", "side", "of", "p", "x")
    rows = stored(rows.mapInArrow(released(residuals), "hub bigint, g bigint, c bigint, side bigint, of bigint, n bigint, r bigint, e array<bigint>"), "residuals")
    d = F.element_at(F.array(*[F.lit(int(k)) for k in most]), (F.col("g") + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(int(edges[min(g + 2, len(edges) - 1)])) for g in range(len(most))]), (F.col("g") + 1).cast("int"))
    hub = rows.where("c = hub").select("hub", "g", F.col("of").alias("hub_of"), F.col("n").alias("hub_n"))
    known = rows.join(hub, ["hub", "g"])
    # the larger residual of a pair that isn't in one component is at least what the hub's link allows for, but for the sizes
    slack = F.floor(F.greatest(F.lit(0), top - F.col("hub_n")) * (den - num) / (2 * (den + num))) + 2
    short = F.least(F.floor(F.col("r") / 2) + slack, F.floor(d / 2) + 1).cast("int")
    y = known.select("hub", "g", F.col("c").alias("cy"), F.col("side").alias("sy"), F.col("of").alias("oy"), F.col("n").alias("ny"), F.col("r").alias("ry"), F.posexplode(F.slice("e", F.lit(1), short)).alias("iy", "e"))
    x = rows.select("hub", "g", F.col("c").alias("cx"), F.col("side").alias("sx"), F.col("of").alias("ox"), F.col("n").alias("nx"), F.col("r").alias("rx"), F.posexplode("e").alias("ix", "e"))
    may = F.floor((F.col("nx") + F.col("ny")) * (den - num) / (den + num))
    both = x.join(y, ["hub", "g", "e"]).where(F.expr("ox <> oy and sx + sy < 2 and (rx > ry or rx = ry and cx > cy)") & (2 * F.col("iy") <= F.col("ry") - F.col("rx") + may) & (2 * F.col("ix") <= F.col("rx") - F.col("ry") + may))
    spare = F.col("n") * (den - num) - F.col("r") * (den + num)
    best = known.where("of = hub_of").groupBy("hub", "g").agg(F.max(F.struct(spare.alias("spare"), F.col("c").alias("cy"))).alias("best"))
    close = known.where("of <> hub_of").join(best, ["hub", "g"]).where(spare + F.col("best.spare") >= 0).select(F.col("c").alias("cx"), F.col("best.cy").alias("cy"))
    return both.select("cx", "cy").union(close).select(F.least("cx", "cy").alias("a"), F.greatest("cx", "cy").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, small: int = 32) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Two documents link when den times the common shingles is at least num times all shingles of both. Words
    are lower-cased in A-Z only; a document with fewer than width words has its whole sequence as its one
    shingle; one without words, or a null text, links with nothing. Documents with equal sets form a class,
    and all else is done with classes. Sets are compared by 64-bit hashes of their shingles, in full.

    Similar sets share some number of keys, not just one; see group_shape(). Pairs from keys of up to `small`
    classes are counted, and a pair goes on if it has enough of them together with what it could share of the
    others. Classes that have enough of those others are first held against one class of each such key, the one
    with most of them. Pairs that aren't connected yet then go by what sets them apart from it; see
    around_hubs(). So no link between components is lost, and large groups don't give all their pairs.

    Null ids link nothing and have a null component; rows with one id and different texts connect what each
    is linked with, as one node has all rows of a class; an empty table gives no rows; only the two named
    columns are read."""
    made = stored(shingle_classes(docs, id_col, text_col, width), "classes")
    rows = made.where("slice is null").select("id", "n", "c")
    heavy = heavy_slots(made)
    total, most = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    edges = band_edges(most, num, den)
    parts = max(64, total * 2 // (3 * KEYS_A_PART))
    reps = rows.where("n > 0 and id is not null").groupBy("c").agg(F.min("id").alias("rep"))
    cand = stored(candidate_pairs(docs.where(F.col(id_col).isNotNull()), text_col, width, heavy, edges, parts, num, den, small), "pairs")
    shapes = [group_shape(edges, g, num, den)[2] for g in range(len(edges) - 1)]
    need = F.element_at(F.array(*[F.lit(r) for r in shapes]), (F.col("g") + 1).cast("int"))
    large = cand.where("gid is not null").select("gid", F.col("a").alias("c"), F.col("b").alias("side"), "g", "n")
    much = large.groupBy("c", "g").agg(F.sum("n").alias("l"))
    pairs = cand.where("gid is null").groupBy("a", "b", "g").agg(F.sum("n").alias("n"))
    pairs = pairs.join(much.toDF("a", "g", "la"), ["a", "g"], "left").join(much.toDF("b", "g", "lb"), ["b", "g"], "left")
    pairs = pairs.where(F.col("n") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) >= need).select("a", "b").distinct()
    large = stored(large.join(much.where(F.col("l") >= need), ["c", "g"]), "large")
    # the class with most such keys is the one most of the others are near to
    hubs = large.groupBy("gid", "g").agg(F.max(F.struct("l", "c")).alias("hub")).select("gid", "g", F.col("hub.c").alias("hub"))
    # of the shared keys, fewer than needed can be left out, in one order for all: those whose hubs have the fewest
    led = large.join(hubs, ["gid", "g"])
    led = led.join(led.groupBy("hub", "g").agg(F.sum("n").alias("leads")), ["hub", "g"])
    so_far = Window.partitionBy("c", "g").orderBy("leads", "hub", "gid").rowsBetween(Window.unboundedPreceding, 0)
    kept = stored(led.withColumn("kept", F.sum("n").over(so_far)).where(F.col("kept") >= need).select("gid", "g", "c", "side", "hub"), "led")
    stars = kept.where("hub <> c").select(F.least("hub", "c").alias("a"), F.greatest("hub", "c").alias("b"))
    pairs = stored(pairs.union(stars).distinct(), "tried")
    dropped(cand, large)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).union(kept.select("c")).union(kept.select("hub")).distinct().join(reps, "c")
    wanted = stored(wanted, "wanted")
    sets = stored(sets_of(docs, id_col, text_col, width, wanted), "sets")
    dropped(wanted)
    links = stored(verified(pairs, sets, num, den), "links")
    label = stored(components(links), "labels")
    dropped(links)
    open_ = kept.join(label, F.col("c") == F.col("node"), "left").select("gid", "g", "c", "side", "hub", F.coalesce("component", "c").alias("of"))
    several = open_.groupBy("gid", "g").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi")
    open_ = open_.join(several, ["gid", "g"], "left_semi").select("hub", "g", "c", "side", "of").distinct()
    own = open_.select("hub", "g").distinct().join(label, F.col("hub") == F.col("node"), "left")
    own = own.select("hub", "g", F.col("hub").alias("c"), F.lit(0).cast("long").alias("side"), F.coalesce("component", "hub").alias("of"))
    open_ = stored(open_.where("c <> hub").union(own), "open")
    if not open_.isEmpty():
        more = stored(around_hubs(open_, sets, edges, num, den).join(pairs, ["a", "b"], "left_anti"), "more")
        links = stored(verified(more, sets, num, den), "links")
        if not links.isEmpty():
            label = stored(joined(label, links), "labels")
        dropped(more, links)
    dropped(open_, sets, pairs, kept)
    least = reps.join(label, F.col("c") == F.col("node"), "left").select("c", "rep", F.coalesce("component", "c").alias("of"))
    first = least.groupBy("of").agg(F.min("rep").alias("component_id"))
    least = least.join(first, "of").select("c", "component_id")
    linked = rows.where("n > 0 and id is not null").join(least, "c").select("id", "n", "component_id")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
