"""Disjoint sets over an edge table (connected components)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from posetta.plans.session import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternating star contraction: the large star hangs a node's larger neighbours on its smallest one, the
    small star does so with the smaller ones. Each round is a minimum by key (combined before the shuffle)
    and one join; a hub's rows are split by the adaptive skew join. A written table cuts the lineage after
    each round and goes when the next one is there; what is written is counted on the way, so that a round
    is one job. Nulls link nothing; loops and repeated edges change nothing; no edges give no rows."""
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull())
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    first = stored(e, "edges")
    nodes = first.select(F.col("u").alias("node")).union(first.select(F.col("v").alias("node"))).distinct()
    e, before = first.where("u <> v"), None
    held = None
    for _ in range(max_rounds):
        # neither side's size is bounded, so merging is asked for
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least.hint("merge"), "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        seen = Observation(f"round-{uuid.uuid4().hex}")
        e = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        if held is not None:
            dropped(held)
        held, now = e, (seen.get["n"], seen.get["h"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def joined(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """labels (node, component) after more edges, without going over the old ones again: the edges are those of a
    graph of components."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").join(of("a"), "a", "left").join(of("b"), "b", "left")
    known = stored(known.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")), "more-edges")
    met = components(known, "of_a", "of_b").select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = known.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("of_a").alias("component")), F.struct(F.col("b").alias("node"), F.col("of_b").alias("component")))).alias("x")).select("x.*")
    return labels.union(new).distinct().join(met, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
