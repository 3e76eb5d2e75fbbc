"""Goldens and laws of bit sets, set algebra and prefix sums, against plain Python."""

import random

import pytest

from posetta.operators import bits, prefix, setops

POSITIONS = {"sparse": [777, 4099, 271828], "edge": [3, 9, 64, 65535, 65536, 65600], "far": [5, 1 << 33, (1 << 44) + 7, 1 << 50], "words": [1, 6, 63, 66, 67, 100, 127, 128, 190]}
SIZES = {"sparse": 300001, "edge": 65700, "far": (1 << 50) + 1, "words": 192, "empty": 70000}


@pytest.fixture(scope="module")
def sets(spark):
    rows = [(k, p) for k, ps in POSITIONS.items() for p in ps]
    rows += [("random", p) for p in random.Random(1).sample(range(200000), 2630)] + [("edge", 9)]
    return spark.createDataFrame(rows, "set_id string, pos bigint").cache()


@pytest.fixture(scope="module")
def truth(sets):
    out = {"empty": []}
    for k, p in sets.distinct().collect():
        out.setdefault(k, []).append(p)
    return {k: sorted(v) for k, v in out.items()}


def test_round_trip(sets, truth):
    got = {}
    for k, p in bits.positions(bits.blocks(sets)).collect():
        got.setdefault(k, []).append(p)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in truth.items() if v}


def test_rank_select_access(spark, sets, truth):
    index = bits.directory(bits.blocks(sets)).cache()
    asks = [(k, i) for k, ps in truth.items() for i in {0, 1, 65535, 65536, 65537, 131072, 199999, 300001, 1 << 45, *ps[:5], *[p + 1 for p in ps[-5:]]}]
    q = spark.createDataFrame(asks, "set_id string, i bigint")
    for r in bits.rank0(index, q).collect():
        want = sum(p < r.i for p in truth[r.set_id])
        assert (r.rank1, r.rank0) == (want, r.i - want), r
    for r in bits.access(sets, q).collect():
        assert r.bit == (r.i in truth[r.set_id])
    q = spark.createDataFrame([(k, n) for k, ps in truth.items() for n in {0, 1, len(ps) // 2, len(ps) - 1, len(ps)} if n >= 0], "set_id string, n bigint")
    for r in bits.select1(index, q).collect():
        assert r.select1 == (truth[r.set_id][r.n] if r.n < len(truth[r.set_id]) else None), r


def test_select0_and_counts(spark, sets, truth):
    sizes = spark.createDataFrame([(k, SIZES.get(k, 200000)) for k in truth], "set_id string, size bigint")
    asks = [(k, n) for k in truth if k != "far" for n in (0, 1, 2, 5, 60, 65000, 66000, 69999, 100000, 191, 183, 184)]
    for r in bits.select0(bits.blocks(sets), sizes, spark.createDataFrame(asks, "set_id string, n bigint")).collect():
        ones, size = set(truth[r.set_id]), SIZES.get(r.set_id, 200000)
        zeros = [i for i in range(size) if i not in ones]
        assert r.select0 == (zeros[r.n] if r.n < len(zeros) else None), r
    for r in bits.counts(sets, sizes).collect():
        n = len(truth[r.set_id])
        assert (r.count1, r.count0, r.any) == (n, r.size - n, n > 0)


def test_both_bits_and_both_ends(spark, sets, truth):
    sizes = spark.createDataFrame([(k, SIZES.get(k, 200000)) for k in truth], "set_id string, size bigint")
    blocked = bits.blocks(sets)
    zeros = {k: [i for i in range(SIZES.get(k, 200000)) if i not in set(truth[k])] for k in truth if k != "far"}
    asks = [(k, b, n) for k in zeros for b in (True, False) for n in (0, 2, 7, 2000, 66000)]
    for r in bits.select(blocked, sizes, spark.createDataFrame(asks, "set_id string, bit boolean, n bigint")).collect():
        of = truth[r.set_id] if r.bit else zeros[r.set_id]
        assert r.select == (of[r.n] if r.n < len(of) else None), r
    asks = [(k, i, n) for k in zeros for i in (0, 3, 65536, 65690) for n in (0, 1, 50)]
    for r in bits.select0_from(blocked, sizes, spark.createDataFrame(asks, "set_id string, i bigint, n bigint")).collect():
        of = [z - r.i for z in zeros[r.set_id] if z >= r.i]
        assert r.select0_from == (of[r.n] if r.n < len(of) else None), r
    rows, left, gone = bits.popped(*bits.pushed(sets, sizes, spark.createDataFrame([("edge", 0, True), ("edge", 1, False), ("empty", 0, True)], "set_id string, k bigint, bit boolean")), 2)
    size = {r.set_id: r["size"] for r in left.collect()}
    assert size["edge"] == 65700 and size["empty"] == 69999 and sorted((r.k, r.bit) for r in gone.where("set_id = 'edge'").collect()) == [(0, False), (1, True)]
    assert [(r.k, r.bit) for r in gone.where("set_id = 'empty'").orderBy("k").collect()] == [(0, True), (1, False)]
    assert sorted(p for k, p in rows.collect() if k == "edge") == truth["edge"]


def test_changes(spark, sets, truth):
    changes = spark.createDataFrame([("edge", 9, False), ("edge", 11, True), ("edge", 64, True)], "set_id string, pos bigint, bit boolean")
    after, before = bits.put(sets, changes)
    assert sorted(p for k, p in after.collect() if k == "edge") == [3, 11, 64, 65535, 65536, 65600]
    assert {r.pos: r.was for r in before.collect()} == {9: True, 11: False, 64: True}
    at = changes.select("set_id", "pos")
    again = bits.flip(bits.flip(sets, at), at)
    assert sorted(again.collect()) == sorted(sets.distinct().collect())


def test_words_and_single_bits(spark, sets):
    q = spark.createDataFrame([("words", 0, 8), ("words", 60, 10), ("words", 64, 63), ("words", 5, 0)], "set_id string, i bigint, len bigint")
    want = {(i, n): sum(1 << (p - i) for p in POSITIONS["words"] if i <= p < i + n) for i, n in ((0, 8), (60, 10), (64, 63), (5, 0))}
    assert {(r.i, r.len): r.word for r in bits.words_at(sets, q).collect()} == want
    x = spark.createDataFrame([(v,) for v in (0, 1, 12, -1, -(1 << 63), (1 << 62) + 4)], "x bigint")
    from pyspark.sql import functions as F

    got = {r.x: (r.l, r.m) for r in x.select("x", bits.lsb(F.col("x")).alias("l"), bits.msb(F.col("x")).alias("m")).collect()}
    low = -(1 << 63)
    assert got == {0: (0, 0), 1: (1, 1), 12: (4, 8), -1: (1, low), low: (low, low), (1 << 62) + 4: (4, 1 << 62)}


def test_set_laws(spark):
    rng = random.Random(2)
    a, b, c = ({rng.randrange(150000) for _ in range(400)} for _ in range(3))
    df = {k: spark.createDataFrame([(x,) for x in v], "pos bigint") for k, v in zip("abc", (a, b, c))}
    got = lambda d: {r[0] for r in d.collect()}
    assert got(setops.union(df["a"], df["b"])) == a | b
    assert got(setops.difference(df["a"], df["b"])) == a - b
    left = setops.symmetric_difference(setops.symmetric_difference(df["a"], df["b"]), df["c"])
    assert got(left) == got(setops.symmetric_difference(df["a"], setops.symmetric_difference(df["b"], df["c"]))) == a ^ b ^ c
    rows = spark.createDataFrame([(k, x) for k, v in zip("abc", (a, b, c)) for x in v], "set_id string, pos bigint")
    assert got(setops.folded(rows, "and")) == a & b & c
    assert got(setops.folded(rows, "xor")) == a ^ b ^ c
    assert got(setops.folded(rows, "and_not", "a")) == a - b - c
    blocked = {k: bits.blocks(v.selectExpr("0 as set_id", "pos")).drop("set_id") for k, v in df.items()}
    for how, want in (("and", a & b), ("or", a | b), ("xor", a ^ b), ("not", a - b)):
        out = setops.block_op(blocked["a"], blocked["b"], how).selectExpr("0 as set_id", "block", "words")
        assert {r.pos for r in bits.positions(out).collect()} == want
    assert setops.block_op(blocked["a"], blocked["a"], "xor").count() == 0
    same = setops.compared(df["a"], df["a"]).first()
    assert same.equal and same.subset and same.jaccard == 1.0


def test_prefix_sums(spark):
    xs = [2, 0, 0, 5, 1, 0, 7, 0, 3, 0]
    df = spark.createDataFrame(list(enumerate(xs)), "pos bigint, x bigint")
    p = prefix.prefix(df)
    q = spark.createDataFrame([(i,) for i in range(12)], "i bigint")
    assert {r.i: r.sum for r in prefix.sums(p, q).collect()} == {i: sum(xs[:i]) for i in range(12)}
    w = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 7, 8, 15, 18, 19, 40)], "w bigint")
    want = {w: next((i for i in range(11) if sum(xs[:i]) >= w), 11) for w in (0, 1, 2, 3, 7, 8, 15, 18, 19, 40)}
    assert {r.w: r.lower_bound for r in prefix.lower_bound(p, w).collect()} == want
    assert sorted(prefix.values(p).collect()) == list(enumerate(xs))
    longer = prefix.pushed(df, spark.createDataFrame([(0, 4), (1, 6)], "n bigint, x bigint"))
    assert sorted(longer.collect()) == list(enumerate([*xs, 4, 6]))
    assert [sorted(part.collect()) for part in prefix.popped(longer, 3)] == [list(enumerate(xs[:9])), [(9, 0), (10, 4), (11, 6)]]
    assert sorted(prefix.fixed(df.where("x > 0"), 12).collect()) == list(enumerate([*xs, 0, 0]))
    empty = prefix.prefix(df.where("false"))
    assert prefix.lower_bound(empty, w).where("w > 0").first().lower_bound == 1
