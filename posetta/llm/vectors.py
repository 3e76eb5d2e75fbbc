"""Embedding near-dedup (operator 9): sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetta.operators.components import components
from posetta.plans.session import dropped, stored

SEED = 9


def layout(n: int, least: float, recall: float) -> tuple[int, int]:
    """Bits a table and tables for n vectors: about eight random vectors to a bucket, and tables enough that
    a pair whose cosine is just `least` meets in one of them with the chance recall."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 3)
    met = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def sign_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): for each table, the sides of its random hyperplanes on which a vector lies, as bits."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    side = (x @ planes > 0).reshape(len(x), tables, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def near_within(x: np.ndarray, own: np.ndarray, other: np.ndarray, weight: np.ndarray, keys: np.ndarray, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of a bucket. x: unit vectors. Rows of the side `own` are held against
    those of `other` (the same rows, or two parts of a bucket). A pair counts in the first table in which
    it meets. links: summed weights of a row's partners; root: least row reachable by these links."""
    n = len(x)
    a, b = [], []
    i, j = np.flatnonzero(own), np.flatnonzero(other)
    y, step = x[j], max(1, 4_000_000 // max(1, len(j)))  # products of 32 MB at once
    for at in range(0, len(i), step):
        p, q = np.nonzero(x[i[at : at + step]] @ y.T >= least)
        p, q = i[at + p], j[q]
        fine = p < q if own is other else np.ones(len(p), bool)
        p, q = p[fine], q[fine]
        if table:
            new = ~(keys[p, :table] == keys[q, :table]).any(1)
            p, q = p[new], q[new]
        a.append(p)
        b.append(q)
    a, b = np.concatenate(a), np.concatenate(b)
    links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return links.astype(np.int64), root
        root = new


def near_vectors(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, recall: float = 0.995, part_rows: int = 8000) -> DataFrame:
    """One row per row of vecs: id, n_links (other rows that have a cosine of `least` or more with it),
    component_id (smallest id reachable by links) and kept (whether it's that one).

    Equal vectors form a class, which counts with its number of rows, so that copies needn't be compared.
    Each class goes to one bucket in each table; within a bucket, cosines in double precision decide. A
    bucket of more than part_rows classes is cut into parts, and each two parts meet in a group of their
    own; no candidate is dropped. Groups come sorted, and a task holds one at a time. A group gives each of its
    rows the number of its links and the least row of its local component, not the pairs. Vectors are sent
    as they are in the table (floats in single precision), with their sides. Pairs that meet in no table
    aren't found (see layout()).

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, and vectors
    of different lengths don't link. Null ids link nothing, have a null component and are kept; rows that
    repeat are linked rows like any other; an empty table gives no rows; only the two named columns are read."""
    kind, single = dict(vecs.dtypes)[id_col], dict(vecs.dtypes)[vec_col] == "array<float>"
    fine = F.coalesce(F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec_col, lambda v: v != 0), F.lit(False))
    rows = vecs.select(F.col(id_col).alias("id"), F.when(fine & F.col(id_col).isNotNull(), F.transform(vec_col, lambda v: v + F.lit(0.0).cast("float" if single else "double"))).alias("v"))
    classes = stored(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    bits, tables = layout(classes.count(), least, recall)
    number = np.float32 if single else np.float64

    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(1)[:, None]
        return x / np.sqrt((x * x).sum(1))[:, None]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                dims = np.array([len(v) for v in b.column(0)])
                for d in np.unique(dims):
                    mine = b.take(pa.array(np.flatnonzero(dims == d)))
                    x = mine.column(0).flatten().to_numpy().reshape(-1, d)
                    keys = sign_keys(unit(x), bits, tables)
                    yield pa.RecordBatch.from_arrays([mine.column(1), mine.column(2), pa.array(np.full(len(x), d, np.int64)), pa.array([v.tobytes() for v in np.ascontiguousarray(x, number)], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array([k.tobytes() for k in keys.astype(np.uint32)], pa.binary())], ["rep", "copies", "d", "x", "each", "keys"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(group: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            t, _key, _d, i, j = group
            got = pa.Table.from_batches(held).combine_chunks()
            if len(got) < 2:
                return None
            x = unit(np.frombuffer(b"".join(got["x"].to_pylist()), number).reshape(len(got), -1))
            keys = np.frombuffer(b"".join(got["keys"].to_pylist()), np.uint32).reshape(len(got), -1)
            own = got["my"].to_numpy() == i
            other = own if i == j else ~own
            links, root = near_within(x, own, other, got["copies"].to_numpy(), keys, t, least)
            hit = np.flatnonzero(links)
            if not len(hit):
                return None
            reps = got["rep"].combine_chunks()
            return pa.RecordBatch.from_arrays([reps.take(pa.array(hit)), pa.array(links[hit]), reps.take(pa.array(root[hit]))], ["rep", "links", "root"])

        now, held = None, []
        for b in batches:
            by = [b.column(k).to_numpy() for k in range(5)]
            cut = np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in by], axis=0), True]) if b.num_rows else []
            for lo, hi in zip(cut, cut[1:]):
                group = tuple(int(c[lo]) for c in by)
                if group != now:
                    if held and (out := links_of(now, held)) is not None:
                        yield out
                    now, held = group, []
                held.append(b.slice(lo, hi - lo))
        if held and (out := links_of(now, held)) is not None:
            yield out

    def near(dealt: DataFrame) -> DataFrame:
        group = ["t", "key", "d", "i", "j"]
        return dealt.select(*group, "my", "rep", "copies", "x", "keys").sortWithinPartitions(*group).mapInArrow(searched, f"rep {kind}, links bigint, root {kind}")

    signs = stored(classes.mapInArrow(signed, f"rep {kind}, copies bigint, d bigint, x binary, each array<bigint>, keys binary"), "signs")
    bucket = ["t", "key", "d"]
    met = signs.select("rep", "copies", "d", "x", "keys", F.posexplode("each").alias("t", "key"))
    sizes = stored(signs.select("d", F.posexplode("each").alias("t", "key")).groupBy(*bucket).count().where("count > 1"), "buckets")
    total, split = sizes.agg(F.coalesce(F.sum(F.when(F.col("count") <= part_rows, F.col("count"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("count") > part_rows, F.col("count") * F.ceil(F.col("count") / part_rows))), F.lit(0))).first()
    # some 20,000 rows to a task; the merge join uses the partitions that it finds
    zero = F.lit(0).cast("long")
    small = met.repartition(max(16, math.ceil(total / 20_000)), *bucket).join(sizes.where(F.col("count") <= part_rows).hint("merge"), bucket, "left_semi")
    found = near(small.withColumns({"my": zero, "i": zero, "j": zero}))
    if split:
        large = sizes.where(F.col("count") > part_rows).select(*bucket, F.ceil(F.col("count") / part_rows).cast("long").alias("parts"))
        cut = met.join(large, bucket).withColumn("my", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("k", F.explode(F.sequence(zero, F.col("parts") - 1)))
        cut = cut.withColumns({"i": F.least("my", "k"), "j": F.greatest("my", "k")})
        found = found.union(near(cut.repartition(max(16, math.ceil(split / 20_000)), *bucket, "i", "j")))
    found = stored(found, "near")
    dropped(signs, sizes)
    labels = components(found, "rep", "root").select(F.col("node").alias("rep"), "component")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "rep", "left").join(labels, "rep", "left").select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, "v", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (component.cast("long") if kind in ("int", "smallint", "tinyint") else component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
