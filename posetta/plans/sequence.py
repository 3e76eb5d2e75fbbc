"""Dense positions and prefix sums without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posetta.plans.session import stored


def running(df: DataFrame, value: Column, order: list, bucket: Column, by: list[str] | None = None, out: str = "before") -> DataFrame:
    """df with the sum of value over all rows that come earlier (of the same `by`), by bucket and then order.

    bucket must not fall as order rises. Sums by bucket are combined before the shuffle; only their small
    table has a window over all of a key; rows have one over their bucket. Nulls in value count as 0."""
    by = by or []
    rows = df.withColumn("_bucket", bucket).withColumn("_value", F.coalesce(value, F.lit(0)))
    parts = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, F.col("_bucket"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    on = F.lit(True)
    for c in [*by, "_bucket"]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    joined = rows.alias("r").join(parts.alias("p"), on)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_start") + F.col("_in")).alias(out))


def holding(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    """points, each with the span [lo, hi) that holds its `at`, if there's one, by left join. Spans of the same `by`
    don't overlap. Both are dealt to buckets as wide as the mean span, of which all spans together touch no more
    than twice their number, so that the join is one by equality, however many points and spans there are."""
    by = by or []
    n, whole = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(hi) - F.col(lo)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    width = max(1, -(-int(whole) // max(1, n)))
    bucket = lambda c: F.expr(f"({c}) div {width}L")
    dealt = spans.where(F.col(hi) > F.col(lo)).withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(f"{hi} - 1"))))
    asked = points.withColumn("_bucket", bucket(at))
    on = F.lit(True)
    for c in [*by, "_bucket"]:
        on = on & (F.col(f"p.{c}") == F.col(f"s.{c}"))
    on = on & (F.col(f"p.{at}") >= F.col(f"s.{lo}")) & (F.col(f"p.{at}") < F.col(f"s.{hi}"))
    return asked.alias("p").join(dealt.alias("s"), on, "left").select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c not in points.columns])


def with_positions(df: DataFrame, order: list, bucket: Column | None = None, by: list[str] | None = None, out: str = "pos") -> DataFrame:
    """df with dense positions from 0, by order, which must be total. Without a bucket the rows are
    range-partitioned on order, and the partitions, once written, are the buckets."""
    if bucket is not None:
        return running(df, F.lit(1).cast("long"), order, bucket, by, out)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows, "ranges")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    if by:
        return running(rows, F.lit(1).cast("long"), ["_at"], part, by, out).drop("_at")
    starts = rows.groupBy(part.alias("_part")).count().withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row for each partition
    rows = rows.withColumn("_part", part).withColumn("_in", at).join(F.broadcast(starts.select("_part", "_start")), "_part")
    return rows.select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))
