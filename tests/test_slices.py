"""Goldens of slices of sequences, relational and by index, and of components."""

import random

from posetta.operators import wavelet, wavelet_index
from posetta.operators.components import components, joined
from posetta.plans.sequence import holding, with_positions

SEQ = random.Random(40).choices([0, 2, 2, 3, 7, 7, 7, 9, 11], k=30)


def seq(spark, xs=SEQ):
    return spark.createDataFrame(list(enumerate(xs)), "pos bigint, sym bigint")


def pairs(df):
    return [(r.cnt, r.sym) for r in df.collect()]


def most(xs, k):
    """The k most frequent ones; of equal counts the larger first."""
    return sorted(((xs.count(x), x) for x in set(xs)), reverse=True)[:k]


def test_topk(spark):
    v = seq(spark)
    for lo, hi, low, high, k in ((0, 30, None, None, 4), (0, 30, 2, 8, 3), (0, 30, 3, None, 2), (5, 22, None, None, 3), (5, 22, 2, 10, 9), (0, 30, 4, 4, 3), (9, 3, None, None, 3)):
        part = wavelet.search(wavelet.view(v, lo, hi), low, high)
        xs = [x for x in SEQ[lo:hi] if (low is None or x >= low) and (high is None or x < high)]
        assert pairs(wavelet.topk(part, k)) == most(xs, k)
        assert pairs(wavelet.mink(part, k)) == [(xs.count(x), x) for x in sorted(set(xs))[:k]]
        assert pairs(wavelet.maxk(part, k)) == [(xs.count(x), x) for x in sorted(set(xs), reverse=True)[:k]]


def test_ties_go_to_the_larger_symbol(spark):
    assert pairs(wavelet.topk(seq(spark, [8, 4, 6, 4, 6, 8, 1]), 2)) == [(2, 8), (2, 6)]


def test_counts_and_quantile(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SPAN", 2)  # so that views have many blocks
    v = seq(spark)
    asks = [(lo, hi, sym) for lo, hi in ((0, 30), (0, 99), (3, 29), (4, 4), (7, 8), (1, 2), (8, 24), (30, 40), (13, 14), (5, 27)) for sym in (-1, 0, 2, 5, 7, 12)]
    for r in wavelet.counts(v, spark.createDataFrame(asks, "lo bigint, hi bigint, sym bigint")).collect():
        xs = SEQ[r.lo : r.hi]
        assert (r.lt, r.eq, r.gt) == (sum(x < r.sym for x in xs), xs.count(r.sym), sum(x > r.sym for x in xs)), r
    xs = sorted(SEQ[2:21])
    k = spark.createDataFrame([(i,) for i in range(-1, 21)], "k bigint")
    got = {r.k: (r.nth, r.sym) for r in wavelet.quantile(wavelet.view(v, 2, 21), k).collect()}
    assert got == {i: (i - xs.index(xs[i]), xs[i]) if 0 <= i < 19 else (None, None) for i in range(-1, 21)}


def test_select_and_get(spark):
    v, asks = seq(spark), [(x, n) for x in (0, 1, 2, 7, 9, 11) for n in range(4)]
    at = lambda x, n: next((i for k, i in enumerate(i for i, y in enumerate(SEQ[3:21]) if y == x) if k == n), None)
    assert {(r.sym, r.n): r.pos for r in wavelet.select(v, spark.createDataFrame(asks, "sym bigint, n bigint"), 3, 21).collect()} == {q: at(*q) for q in asks}
    i = spark.createDataFrame([(0,), (8,), (26,), (27,), (-1,)], "i bigint")
    assert {r.i: r.sym for r in wavelet.get(v, i, 3).collect()} == {0: SEQ[3], 8: SEQ[11], 26: SEQ[29], 27: None, -1: None}


def test_index_against_plain_python(spark):
    rng = random.Random(4)
    xs = [rng.randrange(37) for _ in range(500)]
    index = wavelet_index.build(seq(spark, xs))
    asks = [(k, *sorted((rng.randrange(501), rng.randrange(501))), rng.randrange(-1, 45)) for k in range(60)]
    q = spark.createDataFrame(asks, "qid bigint, lo bigint, hi bigint, sym bigint")
    for r in wavelet_index.counts(index, q).collect():
        view = xs[r.lo : r.hi]
        assert (r.lt, r.eq, r.gt) == (sum(x < r.sym for x in view), view.count(r.sym), sum(x > r.sym for x in view)), r
    q = q.selectExpr("qid", "lo", "hi", "qid * 3 as k")
    for r in wavelet_index.quantile(index, q).collect():
        view = sorted(xs[r.lo : r.hi])
        assert r.sym == (view[r.k] if r.k < len(view) else None), r
    views = [(k, *sorted((rng.randrange(501), rng.randrange(501))), rng.choice([None, 0, 9, 40]), rng.choice([None, 3, 20, 37]), rng.randrange(1, 9)) for k in range(40)]
    q = spark.createDataFrame(views, "qid bigint, lo bigint, hi bigint, low bigint, high bigint, k bigint")
    for fn, order in ((wavelet_index.topk, lambda p: (-p[0], -p[1])), (wavelet_index.mink, lambda p: p[1]), (wavelet_index.maxk, lambda p: -p[1])):
        found = {}
        for r in fn(index, q).collect():
            found.setdefault(r.qid, set()).add((r.cnt, r.sym))
        for qid, lo, hi, low, high, k in views:
            view = [x for x in xs[lo:hi] if x >= (low or 0) and (high is None or x < high)]
            assert found.get(qid, set()) == set(sorted(((view.count(x), x) for x in set(view)), key=order)[:k]), (fn.__name__, qid)
    asks = [(k, *sorted((rng.randrange(501), rng.randrange(501))), rng.randrange(-1, 40), rng.randrange(0, 6)) for k in range(60)]
    for r in wavelet_index.select(index, spark.createDataFrame(asks, "qid bigint, lo bigint, hi bigint, sym bigint, n bigint")).collect():
        at = [i for i, x in enumerate(xs[r.lo : r.hi]) if x == r.sym]
        assert r.pos == (at[r.n] if r.n < len(at) else None), r
    got = wavelet_index.get(index, spark.createDataFrame([(0, 0), (1, 499), (2, 500)], "qid bigint, i bigint")).collect()
    assert {r.qid: r.sym for r in got} == {0: xs[0], 1: xs[499], 2: None}


def test_selecting_reads_each_level_once(spark):
    """The plan grows with the depth, not with the power of two of it."""
    rng = random.Random(8)
    xs = [rng.randrange(90) * 11 for _ in range(300)]
    index = wavelet_index.build(seq(spark, xs))
    asks = [(k, *sorted((rng.randrange(301), rng.randrange(301))), rng.choice(xs), rng.randrange(0, 3)) for k in range(60)]
    got = wavelet_index.select(index, spark.createDataFrame(asks, "qid bigint, lo bigint, hi bigint, sym bigint, n bigint"))
    assert index.depth == 10 and got._jdf.queryExecution().analyzed().toString().count("Join") <= 2 * index.depth
    for r in got.collect():
        at = [i for i, x in enumerate(xs[r.lo : r.hi]) if x == r.sym]
        assert r.pos == (at[r.n] if r.n < len(at) else None), r


def test_positions_without_a_bucket(spark):
    rng = random.Random(5)
    keys = rng.sample(range(10000), 300)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert {r.k: r.pos for r in with_positions(df, ["k"]).collect()} == {k: i for i, k in enumerate(sorted(keys))}


def test_points_meet_spans(spark):
    rng = random.Random(6)
    cuts = {k: sorted(rng.sample(range(5000), 40)) for k in "ab"}
    spans = spark.createDataFrame([(k, lo, hi) for k, c in cuts.items() for lo, hi in zip(c[::2], c[1::2])] + [("c", 1 << 40, 1 << 50)], "k string, lo bigint, hi bigint")
    points = [(k, p) for k in "abcd" for p in (0, 1 << 45, *rng.sample(range(5200), 60))]
    for r in holding(spark.createDataFrame(points, "k string, p bigint"), "p", spans, "lo", "hi", ["k"]).collect():
        want = [(lo, hi) for lo, hi in zip(cuts.get(r.k, [])[::2], cuts.get(r.k, [])[1::2]) if lo <= r.p < hi] + [(1 << 40, 1 << 50)] * (r.k == "c" and r.p == 1 << 45)
        assert [(r.lo, r.hi)] == (want or [(None, None)])


def plain_components(edges):
    label = {x: x for e in edges if None not in e for x in e}
    while any(label[a] != label[b] for a, b in edges if a in label and b in label and None not in (a, b)):
        for a, b in edges:
            if None not in (a, b):
                label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(500, 500), (501, None), (None, 502)] + [(600 + i, 601 + i) for i in range(50)] + [(700, 701 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    label = components(df)
    assert {r.node: r.component for r in label.collect()} == plain_components(edges)
    more = [(rng.randrange(200), rng.randrange(800, 830)) for _ in range(12)] + [(900, 901), (620, 700), (None, 3)]
    got = {r.node: r.component for r in joined(label, spark.createDataFrame(more, "a bigint, b bigint")).collect()}
    assert got == plain_components(edges + more)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
