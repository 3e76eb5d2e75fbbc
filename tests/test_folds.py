"""Goldens and laws of folds."""

import pytest
from pyspark.sql import functions as F

from posetta.operators import folds
from posetta.operators.folds import Items


def items(spark, xs):
    return Items(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "pos bigint, x bigint"))


def one(df):
    return tuple(df.first())


def test_order_of_take_and_filter(spark):
    xs = items(spark, range(1, 21))
    even = lambda x: x % 2 == 0
    assert one(xs.take(5).filter(even).fold(a=folds.collected())) == ([2, 4],)
    assert one(xs.filter(even).take(5).fold(a=folds.collected())) == ([2, 4, 6, 8, 10],)


def test_seq_and_zip(spark):
    xs = items(spark, range(1, 21))
    assert one(xs.seq((3, folds.collected()), (5, folds.collected()))) == ([1, 2, 3], [4, 5, 6, 7, 8])
    assert one(items(spark, [1, 2]).fold(mean=folds.mean())) == (1.5,)
    assert one(xs.zip(a=(2, folds.total()), b=(4, folds.count()))) == (3, 4)
    assert one(items(spark, [1, 2]).seq((3, folds.count()), (5, folds.count()))) == (2, 0)


def test_identities_on_nothing(spark):
    none = items(spark, [])
    got = none.fold(s=folds.total(), n=folds.count(), a=folds.every(lambda x: x > 0), o=folds.some(lambda x: x > 0), c=folds.collected(), t=folds.joined_text())
    assert one(got) == (0, 0, True, False, [], "")
    assert one(folds.product(none.df)) == (1,)


def test_par_and_start(spark):
    xs = items(spark, range(1, 7)).map(lambda x: x * 3)
    total = lambda p: F.sum(p)
    assert one(xs.par(3, folds.total(), total)) == (63,)
    assert one(xs.par(7, folds.total(), total)) == (63,)
    assert one(xs.par(4, folds.count(), total)) == (6,)
    assert one(xs.fold(t=folds.total(100))) == (163,)


@pytest.mark.parametrize("xs", [[1, 2, 3, 4], [-1, 5, -7], [0, 9], [2] * 62, [-2] * 63])
def test_product(spark, xs):
    want = 1
    for x in xs:
        want *= x
    assert one(folds.product(items(spark, xs).df)) == (want,)


def test_product_overflow_raises(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        folds.product(items(spark, [2] * 64).df).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        items(spark, [2**62, 2**62]).fold(s=folds.total()).collect()


def test_custom_step_is_ordered(spark):
    got = items(spark, [1, 2, 3]).fold(v=folds.custom(F.lit(0).cast("long"), lambda a, x: a * 10 + x, lambda a: a + 1))
    assert one(got) == (124,)
