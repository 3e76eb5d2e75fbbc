"""Left folds over ordered items: map, filter, take, and folds run side by side or one after another.

An item sequence is a DataFrame with a position column of distinct values and a value column. Steps apply in the order in
which they are written, so take(5).filter(p) filters five items and filter(p).take(5) takes five."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """An aggregate of items. make(pos, x, where) gives its column over the rows for which where holds; after
    maps the result, as completing a fold does. start is added by folds that sum."""

    make: Callable[[Column, Column, Column], Column]
    after: tuple[Callable[[Column], Column], ...] = field(default=())

    def completing(self, fn: Callable[[Column], Column]) -> Fold:
        return Fold(self.make, (*self.after, fn))

    def column(self, pos: Column, x: Column, where: Column | None = None) -> Column:
        out = self.make(pos, x, F.lit(True) if where is None else where)
        for fn in self.after:
            out = fn(out)
        return out


def total(start: int = 0) -> Fold:
    """Sum of the items, of none the start; long overflow raises."""
    return Fold(lambda pos, x, w: F.lit(start) + F.coalesce(F.sum(F.when(w, x)), F.lit(0)))


def count(start: int = 0) -> Fold:
    return Fold(lambda pos, x, w: F.lit(start) + F.count(F.when(w, F.lit(1))))


def every(p: Callable[[Column], Column]) -> Fold:
    """Whether p holds for all items; true of none."""
    return Fold(lambda pos, x, w: F.coalesce(F.bool_and(F.when(w, p(x))), F.lit(True)))


def some(p: Callable[[Column], Column]) -> Fold:
    """Whether p holds for an item; false of none."""
    return Fold(lambda pos, x, w: F.coalesce(F.bool_or(F.when(w, p(x))), F.lit(False)))


def collected() -> Fold:
    """The items as an array in order. All of them come together in one row, so take() first."""
    return Fold(lambda pos, x, w: F.transform(F.array_sort(F.collect_list(F.when(w, F.struct(pos.alias("pos"), x.alias("x"))))), lambda s: s["x"]))


def joined_text(separator: str = "") -> Fold:
    """The items as strings, put together in order."""
    return Fold(lambda pos, x, w: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(w, F.struct(pos.alias("pos"), x.cast("string").alias("x"))))), lambda s: s["x"]), separator))


def custom(zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Fold:
    """Any step function over the ordered items, within the JVM. Like collected(), it holds all items."""

    def make(pos: Column, x: Column, w: Column) -> Column:
        items = F.array_sort(F.collect_list(F.when(w, F.struct(pos.alias("pos"), x.alias("x")))))
        args = (items, zero, lambda a, s: step(a, s["x"]))
        return F.aggregate(*args, finish) if finish else F.aggregate(*args)

    return Fold(make)


def mean() -> Fold:
    """Sum and count side by side, divided at the end; null of none."""
    return Fold(lambda pos, x, w: F.try_divide(total().make(pos, x, w), count().make(pos, x, w)))


@dataclass(frozen=True)
class Items:
    df: DataFrame
    pos: str = "pos"
    x: str = "x"

    def map(self, fn: Callable[[Column], Column]) -> Items:
        return Items(self.df.withColumn(self.x, fn(F.col(self.x))), self.pos, self.x)

    def filter(self, p: Callable[[Column], Column]) -> Items:
        return Items(self.df.where(p(F.col(self.x))), self.pos, self.x)

    def take(self, n: int) -> Items:
        """The first n items in order; a bounded sort on each partition and then over what they keep."""
        return Items(self.df.orderBy(self.pos).limit(n), self.pos, self.x)

    def fold(self, by: list[str] | None = None, **folds: Fold) -> DataFrame:
        """All folds side by side in one pass, with a column each; one row, or one for each `by`."""
        cols = [f.column(F.col(self.pos), F.col(self.x)).alias(name) for name, f in folds.items()]
        return self.df.groupBy(*by).agg(*cols) if by else self.df.agg(*cols)

    def ranked(self, n: int) -> Items:
        """The first n items with their rank in order, from 0, as column `rank`."""
        first = self.take(n)
        return Items(first.df.withColumn("rank", F.row_number().over(Window.orderBy(self.pos)) - 1), self.pos, self.x)

    def seq(self, first: tuple[int, Fold], second: tuple[int, Fold], names: tuple[str, str] = ("first", "second")) -> DataFrame:
        """first folds its number of items and the second one then its own from the rest; a fold that runs out
        of items keeps what it has."""
        n, m = first[0], second[0]
        items = self.ranked(n + m)
        col = [F.col(self.pos), F.col(self.x)]
        return items.df.agg(first[1].column(*col, F.col("rank") < n).alias(names[0]), second[1].column(*col, F.col("rank").between(n, n + m - 1)).alias(names[1]))

    def zip(self, **folds: tuple[int, Fold]) -> DataFrame:
        """Folds side by side, each of which takes its own number of items and is left alone after that."""
        items = self.ranked(max(n for n, _ in folds.values()))
        return items.df.agg(*[f.column(F.col(self.pos), F.col(self.x), F.col("rank") < n).alias(name) for name, (n, f) in folds.items()])

    def par(self, size: int, inner: Fold, outer: Callable[[Column], Column], out: str = "result") -> DataFrame:
        """Slices of size positions are folded each on its own by inner, and outer aggregates their results."""
        parts = self.df.groupBy(F.floor(F.col(self.pos) / size).alias("slice")).agg(inner.column(F.col(self.pos), F.col(self.x)).alias("part"))
        return parts.agg(outer(F.col("part")).alias(out))


def product(df: DataFrame, x: str = "x", out: str = "product") -> DataFrame:
    """One row: the exact product of long items, 1 of none. Equal factors are counted first; over 63 different
    factors beyond -1, 0 and 1 can't have a long product, so at most 64 rows come together, and an overflow
    raises."""
    size = F.abs(F.col(x).cast("decimal(20,0)"))  # that of the least long is no long
    signs = df.agg(F.coalesce(F.min(size), F.lit(1)).alias("low"), F.count(F.when(F.col(x) < 0, 1)).alias("minus"))
    powers = df.where(size > 1).groupBy(size.alias("v")).count().limit(64).agg(F.collect_list(F.struct("v", F.least("count", F.lit(64)).alias("c"))).alias("powers"))
    times = lambda a, s: F.aggregate(F.sequence(F.lit(1).cast("long"), s["c"]), a, lambda b, _: (b * s["v"]).cast("decimal(38,0)"))
    sign = F.when(F.col("minus") % 2 == 1, -1).otherwise(1).cast("decimal(38,0)")
    return signs.crossJoin(powers).select(F.when(F.col("low") == 0, F.lit(0).cast("long")).otherwise(F.aggregate("powers", sign, times).cast("long")).alias(out))


def closure(df: DataFrame, by: list[str], step: Callable, zero: object, schema: str, finish: Callable | None = None, pos: str = "pos", x: str = "x") -> DataFrame:
    """(by..., result) for each group: step, any Python function of a state and an item, over the items in order from
    zero, and finish at the end. step gives (state, done); a fold that is done reads no further item. schema is the
    result's type. For what no column expression can say: a group's items come together in one task."""
    import pandas as pd

    kinds = dict(df.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in by)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        state = zero
        for item in group.sort_values(pos)[x]:
            state, done = step(state, item)
            if done:
                break
        return pd.DataFrame([[*key, finish(state) if finish else state]], columns=[*by, "result"])

    return df.select(*by, pos, x).groupBy(*by).applyInPandas(run, f"{head}result {schema}")
