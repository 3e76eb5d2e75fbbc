"""Registered queries of the positional operators, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posetta.functions import codecs, content, digests, parsers, slicing
from posetta.operators import bits, folds, prefix, setops, signatures, store, wavelet, wavelet_index
from posetta.operators.components import components
from posetta.operators.folds import Items
from posetta.plans.sequence import with_positions
from posetta.plans.session import scratch_dir, table
from posetta.sources import segments
from posetta.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

V = "with v as (select row_number() over (order by ts, event_id) - 1 as pos, user_id as sym, event_type, event_id, cast(round(value * 100) as bigint) as cents from events)"
B = V + ", b as (select event_type as set_id, pos from v), sizes as (select event_type as set_id, (select count(*) from events) as size from events group by 1)"


def query(name: str, sql: str | None = None) -> Callable:
    def put(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event sequence: dense positions by time, user_id as symbol."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    e = with_positions(e, ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return e.select("pos", F.col("user_id").alias("sym"), "event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


def items(spark: SparkSession, sf_dir: str) -> Items:
    return Items(events(spark, sf_dir).select("pos", F.col("sym").alias("x")))


def unordered(spark: SparkSession, sf_dir: str) -> Items:
    """The same items for folds that don't ask for their order, by id instead of position."""
    return Items(table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("x")))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("set_id"), "pos")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # one row of the whole, one for each event type
    return e.select(F.col("event_type").alias("set_id")).distinct().join(F.broadcast(e.agg(F.count(F.lit(1)).alias("size"))))


def asked(spark: SparkSession, sf_dir: str, n: int, step: int, name: str = "i") -> DataFrame:
    """n numbers for each set, step apart."""
    types = sizes(spark, sf_dir).select("set_id")
    return types.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) * step).cast("long"), F.lit(step).cast("long"))))


# folds


@query("fold_sum", V + " select cast(coalesce(sum(sym), 0) as bigint) as total from v")
def fold_sum(s, d):
    return unordered(s, d).fold(total=folds.total())


@query("fold_count", V + " select count(*) as n from v")
def fold_count(s, d):
    return unordered(s, d).fold(n=folds.count())


@query("fold_prod", V + " select cast(product(case when (pos & (pos + 1)) = 0 then 2 else 1 end * case when sym % 2 = 0 then 1 else -1 end) as bigint) as product from v")
def fold_prod(s, d):
    """Two where the position is one less than a power of two, so that the product fits however many items there are."""
    e, pos = events(s, d), F.col("pos")
    x = F.when(pos.bitwiseAND(pos + 1) == 0, 2).otherwise(1) * F.when(F.col("sym") % 2 == 0, 1).otherwise(-1)
    return folds.product(e.select("pos", x.cast("long").alias("x")))


@query("fold_all", V + " select coalesce(bool_and(sym >= 0), true) as every, coalesce(bool_and(sym > 50), true) as over from v")
def fold_all(s, d):
    return unordered(s, d).fold(every=folds.every(lambda x: x >= 0), over=folds.every(lambda x: x > 50))


@query("fold_any", V + " select coalesce(bool_or(sym < 0), false) as minus, coalesce(bool_or(sym = 7), false) as seven from v")
def fold_any(s, d):
    return unordered(s, d).fold(minus=folds.some(lambda x: x < 0), seven=folds.some(lambda x: x == 7))


@query("fold_map_filter_take", V + " select cast(coalesce(sum(sym * 3), 0) as bigint) as total, count(*) as n from (select * from v where sym % 2 = 0 order by pos limit 500)")
def fold_map_filter_take(s, d):
    return items(s, d).filter(lambda x: x % 2 == 0).take(500).map(lambda x: x * 3).fold(total=folds.total(), n=folds.count())


@query("fold_take_filter", V + " select cast(coalesce(sum(sym), 0) as bigint) as total, count(*) as n from v where pos < 500 and sym % 2 = 0")
def fold_take_filter(s, d):
    return items(s, d).take(500).filter(lambda x: x % 2 == 0).fold(total=folds.total(), n=folds.count())


@query("fold_seq", V + " select cast(coalesce(sum(case when pos < 300 then sym end), 0) as bigint) as first, count(case when pos >= 300 and pos < 800 then 1 end) as second from v")
def fold_seq(s, d):
    return items(s, d).seq((300, folds.total()), (500, folds.count()))


@query("fold_zip_avg", V + " select sum(sym) / count(*) as mean, cast(sum(sym) as bigint) as total, count(*) as n from v")
def fold_zip_avg(s, d):
    return items(s, d).fold(mean=folds.mean(), total=folds.total(), n=folds.count())


@query("fold_zip_take", V + " select cast(sum(case when pos < 100 then sym end) as bigint) as total, count(case when pos < 250 then 1 end) as n from v")
def fold_zip_take(s, d):
    return items(s, d).zip(total=(100, folds.total()), n=(250, folds.count()))


@query("fold_conj", V + " select sym, event_type, array_to_string(list(cast(cents as varchar) order by pos), ',') as syms from v group by sym, event_type")
def fold_conj(s, d):
    e = Items(events(s, d).select("pos", F.col("cents").alias("x"), "sym", "event_type"))
    return e.fold(["sym", "event_type"], syms=folds.collected()).withColumn("syms", F.array_join(F.transform("syms", lambda x: x.cast("string")), ","))


@query("fold_string_concat", V + " select sym, string_agg(event_type, '' order by pos) as text from v group by sym")
def fold_string_concat(s, d):
    return Items(events(s, d).select("pos", F.col("event_type").alias("x"), "sym")).fold(["sym"], text=folds.joined_text())


@query("fold_par_sum", V + " select cast(sum(part) as bigint) as result from (select sum(sym * 3) as part from v group by pos // 97)")
def fold_par_sum(s, d):
    return items(s, d).map(lambda x: x * 3).par(97, folds.total(), lambda p: F.coalesce(F.sum(p), F.lit(0)))


@query("fold_begin", V + " select 100 + cast(sum(sym) as bigint) as total, 5 + count(*) as n from v")
def fold_begin(s, d):
    return unordered(s, d).fold(total=folds.total(100), n=folds.count(5))


@query("fold_custom", V + " select sym, cast(list_reduce(list_prepend(cast(1 as bigint), list(event_id order by pos)), lambda a, b: (a * 31 + b) % 1000003) as bigint) as rolling from v group by sym")
def fold_custom(s, d):
    e = Items(events(s, d).select("pos", F.col("event_id").alias("x"), "sym"))
    return e.fold(["sym"], rolling=folds.custom(F.lit(1).cast("long"), lambda a, x: (a * 31 + x) % 1000003))


@query("fold_completing", V + " select cast(sum(sym) * 2 as bigint) as twice, count(*) > 5 as more from v")
def fold_completing(s, d):
    return unordered(s, d).fold(twice=folds.total().completing(lambda x: x * 2), more=folds.count().completing(lambda n: n > 5))


@query("fold_closure", V + ", c as (select sym, pos, sum(sym) over (partition by sym order by pos) as upto from v) select sym, cast(coalesce(min(case when upto >= 500 then upto end), max(upto)) * 2 as bigint) as result from c group by sym")
def fold_closure(s, d):
    """Each user's items are added up until there are 500, then no further one is read; the sum is doubled at the end."""
    e = events(s, d).select("sym", "pos", F.col("sym").alias("x"))
    return folds.closure(e, ["sym"], lambda a, x: (a + int(x), a + int(x) >= 500), 0, "bigint", lambda a: a * 2)


# slices of the event sequence


@query("wm_topk", V + " select sym, count(*) as cnt from v where pos >= 100 and pos < 900 and sym >= 10 and sym < 120 group by sym order by cnt desc, sym desc limit 10")
def wm_topk(s, d):
    return wavelet.topk(wavelet.search(wavelet.view(events(s, d), 100, 900), 10, 120), 10)


@query("wm_topk_range", V + " select sym, count(*) as cnt from v where pos >= 100 and sym >= 5 group by sym order by cnt desc, sym desc limit 20")
def wm_topk_range(s, d):
    return wavelet.topk(wavelet.search(wavelet.view(events(s, d), 100, 1 << 40), 5), 20)


@query("wm_mink", V + " select sym, count(*) as cnt from v where pos >= 50 and pos < 700 and sym >= 3 group by sym order by sym limit 10")
def wm_mink(s, d):
    return wavelet.mink(wavelet.search(wavelet.view(events(s, d), 50, 700), 3), 10)


@query("wm_maxk", V + " select sym, count(*) as cnt from v where pos >= 50 and pos < 700 and sym < 90 group by sym order by sym desc limit 10")
def wm_maxk(s, d):
    return wavelet.maxk(wavelet.search(wavelet.view(events(s, d), 50, 700), None, 90), 10)


@query("wm_get", V + ", q as (select range * 7 as i from range(200)) select q.i, v.sym from q left join v on v.pos = q.i + 20")
def wm_get(s, d):
    return wavelet.get(events(s, d), s.range(200).select((F.col("id") * 7).alias("i")), 20)


@query("wm_rank", V + ", q as (select range % 50 as sym, range * 3 as hi from range(300)) select q.sym, q.hi, count(v.pos) as rank from q left join v on v.sym = q.sym and v.pos < q.hi group by q.sym, q.hi")
def wm_rank(s, d):
    q = s.range(300).select((F.col("id") % 50).alias("sym"), (F.col("id") * 3).alias("hi"), F.lit(0).cast("long").alias("lo"))
    return wavelet.counts(events(s, d), q).select("sym", "hi", F.col("eq").alias("rank"))


COUNTS_Q = ", q as (select range as qid, range * 5 as lo, range * 5 + range * 31 as hi, (range * 13) % 160 as sym from range(150))"


def counts_asked(s):
    i = F.col("id")
    return s.range(150).select(i.alias("qid"), (i * 5).alias("lo"), (i * 36).alias("hi"), (i * 13 % 160).alias("sym"))


COUNTS_SQL = V + COUNTS_Q + " select q.qid, q.lo, q.hi, q.sym, count(case when v.sym < q.sym then 1 end) as lt, count(case when v.sym = q.sym then 1 end) as eq, count(case when v.sym > q.sym then 1 end) as gt from q left join v on v.pos >= q.lo and v.pos < q.hi group by all"


@query("wm_counts", COUNTS_SQL)
def wm_counts(s, d):
    return wavelet.counts(events(s, d), counts_asked(s))


@query("wm_select", V + ", o as (select sym, pos, row_number() over (partition by sym order by pos) - 1 as n from v), q as (select range % 60 as sym, range // 20 as n from range(400)) select q.sym, q.n, o.pos from q left join o using (sym, n)")
def wm_select(s, d):
    return wavelet.select(events(s, d), s.range(400).select((F.col("id") % 60).alias("sym"), F.floor(F.col("id") / 20).alias("n")))


@query("wm_view_select", V + ", o as (select sym, pos - 111 as pos, row_number() over (partition by sym order by pos) - 1 as n from v where pos >= 111 and pos < 777), q as (select range % 60 as sym, range // 60 as n from range(400)) select q.sym, q.n, o.pos from q left join o using (sym, n)")
def wm_view_select(s, d):
    return wavelet.select(events(s, d), s.range(400).select((F.col("id") % 60).alias("sym"), F.floor(F.col("id") / 60).alias("n")), 111, 777)


@query("wm_quantile", V + ", o as (select sym, row_number() over (order by sym, pos) - 1 as k, row_number() over (partition by sym order by pos) - 1 as nth from v where pos >= 100 and pos < 900), q as (select range * 9 as k from range(100)) select q.k, o.sym, o.nth from q left join o using (k)")
def wm_quantile(s, d):
    return wavelet.quantile(wavelet.view(events(s, d), 100, 900), s.range(100).select((F.col("id") * 9).alias("k")))


@query("wm_size_count", V + " select sym, count(*) as cnt, (select count(*) from v) as size from v group by sym")
def wm_size_count(s, d):
    e = events(s, d)
    return wavelet.histogram(e).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("size"))))


@query("wmi_counts", COUNTS_SQL)
def wmi_counts(s, d):
    return wavelet_index.counts(wavelet_index.build(events(s, d)), counts_asked(s)).select("qid", "lo", "hi", "sym", "lt", "eq", "gt")


@query("wmi_quantile", V + ", q as (select range as qid, range * 3 as lo, range * 3 + range * 11 + 1 as hi, range as k from range(80)), o as (select q.qid, v.sym, row_number() over (partition by q.qid order by v.sym, v.pos) - 1 as k from q join v on v.pos >= q.lo and v.pos < q.hi) select q.qid, q.lo, q.hi, q.k, o.sym from q left join o on o.qid = q.qid and o.k = q.k")
def wmi_quantile(s, d):
    i = F.col("id")
    q = s.range(80).select(i.alias("qid"), (i * 3).alias("lo"), (i * 14 + 1).alias("hi"), i.alias("k"))
    return wavelet_index.quantile(wavelet_index.build(events(s, d)), q).select("qid", "lo", "hi", "k", "sym")


def views_asked(s):
    """Many views at once: the whole, empty ones, ones beyond the end, with and without bounds of symbols."""
    i, null = F.col("id"), F.lit(None).cast("long")
    return s.range(60).select(i.alias("qid"), (i * 7).alias("lo"), (i * 7 + i * 17).alias("hi"), F.when(i % 3 == 0, i % 40).otherwise(null).alias("low"), F.when(i % 4 == 0, i % 40 + 60).otherwise(null).alias("high"), (i % 9 + 1).alias("k"))


VIEWS_SQL = V + ", q as (select range as qid, range * 7 as lo, range * 24 as hi, case when range % 3 = 0 then range % 40 end as low, case when range % 4 = 0 then range % 40 + 60 end as high, range % 9 + 1 as k from range(60)), h as (select qid, k, sym, count(*) as cnt from q join v on v.pos >= q.lo and v.pos < q.hi and v.sym >= coalesce(low, 0) and (high is null or v.sym < high) group by all) select qid, sym, cnt from h qualify row_number() over (partition by qid order by {}) <= k"


@query("wmi_topk", VIEWS_SQL.format("cnt desc, sym desc"))
def wmi_topk(s, d):
    return wavelet_index.topk(wavelet_index.build(events(s, d)), views_asked(s))


@query("wmi_mink", VIEWS_SQL.format("sym"))
def wmi_mink(s, d):
    return wavelet_index.mink(wavelet_index.build(events(s, d)), views_asked(s))


@query("wmi_maxk", VIEWS_SQL.format("sym desc"))
def wmi_maxk(s, d):
    return wavelet_index.maxk(wavelet_index.build(events(s, d)), views_asked(s))


@query("wmi_select", V + ", q as (select range as qid, range * 3 as lo, range * 3 + range * 40 as hi, (range * 7) % 140 as sym, range % 5 as n from range(90)), o as (select q.qid, v.pos - q.lo as pos, row_number() over (partition by q.qid order by v.pos) - 1 as n from q join v on v.sym = q.sym and v.pos >= q.lo and v.pos < q.hi) select q.qid, q.lo, q.hi, q.sym, q.n, o.pos from q left join o using (qid, n)")
def wmi_select(s, d):
    i = F.col("id")
    q = s.range(90).select(i.alias("qid"), (i * 3).alias("lo"), (i * 43).alias("hi"), (i * 7 % 140).alias("sym"), (i % 5).alias("n"))
    return wavelet_index.select(wavelet_index.build(events(s, d)), q).select("qid", "lo", "hi", "sym", "n", "pos")


# bit sequences


@query("bits_access", B + ", q as (select set_id, range * 11 as i from sizes, range(100)) select q.set_id, q.i, b.pos is not null as bit from q left join b on b.set_id = q.set_id and b.pos = q.i")
def bits_access(s, d):
    return bits.access(sets(s, d), asked(s, d, 100, 11))


@query("bits_count", B + " select s.set_id, s.size, count(b.pos) as count1, s.size - count(b.pos) as count0, count(b.pos) = s.size as every, count(b.pos) > 0 as any from sizes s left join b using (set_id) group by s.set_id, s.size")
def bits_count(s, d):
    return bits.counts(sets(s, d), sizes(s, d))


@query("bits_rank", B + ", q as (select set_id, range * 17 as i from sizes, range(100)) select q.set_id, q.i, count(b.pos) as rank1, q.i - count(b.pos) as rank0 from q left join b on b.set_id = q.set_id and b.pos < q.i group by q.set_id, q.i")
def bits_rank(s, d):
    return bits.rank0(bits.directory(bits.blocks(sets(s, d))), asked(s, d, 100, 17))


@query("bits_excess", B + ", q as (select set_id, range * 5 as lo, range * 16 as hi from sizes, range(60)), r as (select q.set_id, q.lo, q.hi, count(b.pos) as r1 from q left join b on b.set_id = q.set_id and b.pos >= q.lo and b.pos < q.hi group by all) select set_id, lo, hi, r1 as rank1, hi - lo - r1 as rank0, abs(2 * r1 - (hi - lo)) as excess, case when 2 * r1 >= hi - lo then 2 * r1 - (hi - lo) end as excess1, case when 2 * r1 <= hi - lo then hi - lo - 2 * r1 end as excess0 from r")
def bits_excess(s, d):
    q = asked(s, d, 60, 5, "lo").withColumn("hi", F.floor(F.col("lo") / 5) * 16)
    return bits.rank_range(bits.directory(bits.blocks(sets(s, d))), q)


@query("bits_select1", B + ", o as (select set_id, pos, row_number() over (partition by set_id order by pos) - 1 as n from b), q as (select set_id, range * 29 as n from sizes, range(100)) select q.set_id, q.n, o.pos as select1 from q left join o using (set_id, n)")
def bits_select1(s, d):
    return bits.select1(bits.directory(bits.blocks(sets(s, d))), asked(s, d, 100, 29, "n"))


@query("bits_select0", B + ", z as (select s.set_id, v.pos from sizes s, v where v.event_type <> s.set_id), o as (select set_id, pos, row_number() over (partition by set_id order by pos) - 1 as n from z), q as (select set_id, range * 101 as n from sizes, range(100)) select q.set_id, q.n, o.pos as select0 from q left join o using (set_id, n)")
def bits_select0(s, d):
    return bits.select0(bits.blocks(sets(s, d)), sizes(s, d), asked(s, d, 100, 101, "n"))


@query("bits_select_from", B + ", o as (select set_id, pos, row_number() over (partition by set_id order by pos) - 1 as n from b), q as (select set_id, range * 40 as i, range % 7 as n from sizes, range(100)), r as (select q.set_id, q.i, q.n, count(b.pos) as r from q left join b on b.set_id = q.set_id and b.pos < q.i group by all) select r.set_id, r.i, r.n, o.pos - r.i as select1_from from r left join o on o.set_id = r.set_id and o.n = r.r + r.n")
def bits_select_from(s, d):
    q = asked(s, d, 100, 40).withColumn("n", F.floor(F.col("i") / 40) % 7)
    return bits.select_from(bits.directory(bits.blocks(sets(s, d))), q)


@query("bits_rank_bit", B + ", q as (select set_id, range % 2 = 0 as bit, range * 3 as lo, range * 19 as hi from sizes, range(60)), r as (select q.set_id, q.bit, q.lo, q.hi, count(b.pos) as r1 from q left join b on b.set_id = q.set_id and b.pos >= q.lo and b.pos < q.hi group by all) select set_id, bit, lo, hi, case when bit then r1 else hi - lo - r1 end as rank from r")
def bits_rank_bit(s, d):
    i = F.floor(F.col("lo") / 3)
    q = asked(s, d, 60, 3, "lo").withColumn("hi", i * 19).withColumn("bit", i % 2 == 0)
    return bits.rank(bits.directory(bits.blocks(sets(s, d))), q).select("set_id", "bit", "lo", "hi", "rank")


@query("bits_select_bit", B + ", z as (select s.set_id, v.pos, v.event_type = s.set_id as bit from sizes s, v), o as (select set_id, pos, bit, row_number() over (partition by set_id, bit order by pos) - 1 as n from z), q as (select set_id, range % 3 = 0 as bit, range * 23 as n from sizes, range(80)) select q.set_id, q.bit, q.n, o.pos as \"select\" from q left join o using (set_id, bit, n)")
def bits_select_bit(s, d):
    q = asked(s, d, 80, 23, "n").withColumn("bit", F.floor(F.col("n") / 23) % 3 == 0)
    return bits.select(bits.blocks(sets(s, d)), sizes(s, d), q).select("set_id", "bit", "n", "select")


@query("bits_select0_from", B + ", z as (select s.set_id, v.pos from sizes s, v where v.event_type <> s.set_id), o as (select set_id, pos, row_number() over (partition by set_id order by pos) - 1 as n from z), q as (select set_id, range * 11 as i, range % 7 as n from sizes, range(80)), r as (select q.set_id, q.i, q.n, count(z.pos) as r from q left join z on z.set_id = q.set_id and z.pos < q.i group by all) select r.set_id, r.i, r.n, o.pos - r.i as select0_from from r left join o on o.set_id = r.set_id and o.n = r.r + r.n")
def bits_select0_from(s, d):
    q = asked(s, d, 80, 11).withColumn("n", F.floor(F.col("i") / 11) % 7)
    return bits.select0_from(bits.blocks(sets(s, d)), sizes(s, d), q)


@query("bits_push_pop", B + ", c as (select set_id, size + range as pos from sizes, range(9) where range % 2 = 0) select set_id, pos from (select * from b union all select * from c) where pos < (select max(size) from sizes) + 4")
def bits_push_pop(s, d):
    """Nine bits, every other one set, are put behind each set, and the last five taken off again."""
    z = sizes(s, d)
    more = asked(s, d, 9, 1, "k").withColumn("bit", F.col("k") % 2 == 0)
    return bits.popped(*bits.pushed(sets(s, d), z, more), 5)[0]


@query("bits_of_words", "select distinct o_orderpriority as set_id, (o_orderkey % 40000) * 64 + i as pos from orders, range(13) t(i) where (o_orderkey >> cast(i as int)) & 1 = 1 and o_orderkey = (select max(p.o_orderkey) from orders p where p.o_orderpriority = orders.o_orderpriority and p.o_orderkey % 40000 = orders.o_orderkey % 40000)")
def bits_of_words(s, d):
    """The lowest 13 bits of order keys as words, the largest key of those that would be the same word."""
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    words = o.groupBy(F.col("o_orderpriority").alias("set_id"), (k % 40000).alias("w")).agg(F.max(k).alias("k"))
    return bits.of_words(words.select("set_id", "w", F.col("k").bitwiseAND(F.lit((1 << 13) - 1)).alias("word")))


@query("bits_word", B + ", q as (select set_id, range * 13 as i, range % 17 as len from sizes, range(60)) select q.set_id, q.i, q.len, cast(coalesce(sum(cast(1 as bigint) << cast(b.pos - q.i as int)), 0) as bigint) as word from q left join b on b.set_id = q.set_id and b.pos >= q.i and b.pos < q.i + q.len group by all")
def bits_word(s, d):
    return bits.words_at(sets(s, d), asked(s, d, 60, 13).withColumn("len", F.floor(F.col("i") / 13) % 17))


@query("bits_iterate", B + " select set_id, pos from b")
def bits_iterate(s, d):
    return bits.positions(bits.blocks(sets(s, d)))


@query("bits_put", B + ", c as (select set_id, range * 6 as pos, range % 2 = 0 as bit from sizes, range(80)) select set_id, pos from ((select set_id, pos from b except select set_id, pos from c) union (select set_id, pos from c where bit))")
def bits_put(s, d):
    changes = asked(s, d, 80, 6, "pos").withColumn("bit", F.floor(F.col("pos") / 6) % 2 == 0)
    return bits.put(sets(s, d), changes)[0]


@query("bits_put_before", B + ", c as (select set_id, range * 6 as pos, range % 2 = 0 as bit from sizes, range(80)) select c.set_id, c.pos, c.bit, b.pos is not null as was from c left join b using (set_id, pos)")
def bits_put_before(s, d):
    changes = asked(s, d, 80, 6, "pos").withColumn("bit", F.floor(F.col("pos") / 6) % 2 == 0)
    return bits.put(sets(s, d), changes)[1]


@query("bits_flip", B + ", c as (select set_id, range * 6 as pos from sizes, range(80)) select set_id, pos from (select * from b union all select * from c) group by all having count(*) % 2 = 1")
def bits_flip(s, d):
    return bits.flip(sets(s, d), asked(s, d, 80, 6, "pos"))


@query("bits_resize", B + " select set_id, pos from b where pos < 321")
def bits_resize(s, d):
    return bits.resized(sets(s, d), sizes(s, d).select("set_id", F.lit(321).alias("size")))


@query("bits_lsb_msb", "select o_orderkey, case when o_orderkey = 0 then 0 else cast(o_orderkey & -o_orderkey as bigint) end as lsb, case when o_orderkey = 0 then 0 else cast(1 as bigint) << (length(bin(o_orderkey)) - 1) end as msb, cast(bit_count(o_orderkey) as bigint) as ones from orders")
def bits_lsb_msb(s, d):
    x = F.col("o_orderkey")
    return table(s, d, "orders").select(x, bits.lsb(x).alias("lsb"), bits.msb(x).alias("msb"), F.bit_count(x).cast("long").alias("ones"))


@query("bits_chunks", "select c_custkey, unnest(range(c_custkey // 1000, (c_custkey + 2500) // 1000 + 1)) as chunk from customer")
def bits_chunks(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k, F.explode(bits.chunks_of(k, k + 2501, 1000)).alias("chunk"))


@query("bits_sliced", B + " select set_id, pos from b")
def bits_sliced(s, d):
    """There and back through the sliced form."""
    return slicing.unsliced(slicing.sliced(bits.blocks(sets(s, d))))


# set algebra: parts by return flag, users by event type


PARTS = "with a as (select distinct l_partkey as pos from lineitem where l_returnflag = 'A'), b as (select distinct l_partkey as pos from lineitem where l_returnflag = 'R' and l_quantity < 10)"


def two_sets(s, d):
    p = table(s, d, "lineitem").select(F.col("l_partkey").alias("pos"), "l_returnflag", "l_quantity")
    return p.where("l_returnflag = 'A'").select("pos"), p.where("l_returnflag = 'R' and l_quantity < 10").select("pos")


for how, word in (("and", "intersect"), ("or", "union"), ("not", "except")):
    fn = {"and": setops.intersection, "or": setops.union, "not": setops.difference}[how]
    query(f"set_{how}", f"{PARTS} select pos from a {word} select pos from b")(lambda s, d, fn=fn: fn(*two_sets(s, d)).distinct())
    query(f"set_block_{how}", f"{PARTS} select pos from a {word} select pos from b")(lambda s, d, how=how: by_blocks(s, d, how))
XOR_SQL = PARTS + " (select pos from a except select pos from b) union (select pos from b except select pos from a)"
query("set_xor", XOR_SQL)(lambda s, d: setops.symmetric_difference(*two_sets(s, d)))
query("set_block_xor", XOR_SQL)(lambda s, d: by_blocks(s, d, "xor"))


def by_blocks(s, d, how):
    a, b = (bits.blocks(x.withColumn("set_id", F.lit(0))).drop("set_id") for x in two_sets(s, d))
    return bits.positions(setops.block_op(a, b, how).withColumn("set_id", F.lit(0))).select("pos")


USERS = "with b as (select distinct event_type as set_id, user_id as pos from events where value < 60)"


def user_sets(s, d):
    return table(s, d, "events").where("value < 60").select(F.col("event_type").alias("set_id"), F.col("user_id").alias("pos"))


query("set_fold_and", USERS + " select pos from b group by pos having count(*) = (select count(distinct set_id) from b)")(lambda s, d: setops.folded(user_sets(s, d), "and"))
query("set_fold_or", USERS + " select distinct pos from b")(lambda s, d: setops.folded(user_sets(s, d), "or"))
query("set_fold_xor", USERS + " select pos from b group by pos having count(*) % 2 = 1")(lambda s, d: setops.folded(user_sets(s, d), "xor"))
query("set_fold_and_not", "with b as (select distinct l_returnflag as set_id, l_orderkey as pos from lineitem) select pos from b group by pos having count(*) = 1 and max(set_id) = 'N'")(
    lambda s, d: setops.folded(table(s, d, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_orderkey").alias("pos")), "and_not", "N")
)


@query("set_chain", PARTS + ", c as (select distinct l_suppkey as pos from lineitem) (select pos from a except select pos from b) intersect select pos from c")
def set_chain(s, d):
    """Two operators one after the other: parts of the first set and not the second that are suppliers' numbers too."""
    c = table(s, d, "lineitem").select(F.col("l_suppkey").alias("pos"))
    return setops.intersection(setops.difference(*two_sets(s, d)), c).distinct()


@query("set_compare", PARTS + ", n as (select (select count(*) from a) as ca, (select count(*) from b) as cb, (select count(*) from (select pos from a intersect select pos from b)) as x) select ca as count_a, cb as count_b, x as count_and, ca + cb - x as count_or, ca = x and cb = x as equal, x = 0 as disjoint, ca = x as subset, cb = x as superset, x / (ca + cb - x) as jaccard, x / sqrt(ca * cb) as cosine from n")
def set_compare(s, d):
    return setops.compared(*two_sets(s, d))


# prefix sums over order values


O = "with x as (select row_number() over (order by o_orderkey) - 1 as pos, cast(round(o_totalprice) as bigint) as x from orders), p as (select pos, x, cast(sum(x) over (order by pos) as bigint) as cum from x)"


def order_values(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("x"))
    return with_positions(o, ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096)).select("pos", "x")


@query("prefix_sum", O + ", q as (select range * 23 as i from range(80)) select q.i, coalesce(p.cum, case when q.i > 0 then (select max(cum) from p) else 0 end) as sum from q left join p on p.pos + 1 = q.i")
def prefix_sum(s, d):
    return prefix.sums(prefix.prefix(order_values(s, d)), s.range(80).select((F.col("id") * 23).alias("i")))


@query("prefix_all", O + " select pos, x, cum - x as before, cum from p")
def prefix_all(s, d):
    return prefix.prefix(order_values(s, d))


@query("prefix_sum_by", O + " select pos, cast(sum(x % 7) over (order by pos) as bigint) as cum from x")
def prefix_sum_by(s, d):
    return prefix.prefix(order_values(s, d), F.col("x") % 7).select("pos", "cum")


@query("prefix_reset", O + " select pos, x from x")
def prefix_reset(s, d):
    return prefix.values(prefix.prefix(order_values(s, d)))


@query("prefix_incr", O + ", y as (select pos, sum(x) as x from (select pos, x from x union all select range * 3, range from range(100)) group by pos) select pos, cast(x as bigint) as x, cast(sum(x) over (order by pos) as bigint) as cum from y")
def prefix_incr(s, d):
    deltas = s.range(100).select((F.col("id") * 3).alias("pos"), F.col("id").alias("delta"))
    return prefix.prefix(prefix.changed(order_values(s, d), deltas)).select("pos", "x", "cum")


BOUND_Q = ", q as (select range * 4000000 as w from range(120))"
BOUND_SQL = O + BOUND_Q + " select q.w, case when q.w <= 0 then 0 else coalesce((select min(pos) + 1 from p where cum >= q.w), (select count(*) + 1 from p)) end as lower_bound, case when q.w <= 0 then 0 else (select min(pos) from p where cum >= q.w) end as search from q"


@query("prefix_lower_bound", BOUND_SQL)
def prefix_lower_bound(s, d):
    return prefix.lower_bound(prefix.prefix(order_values(s, d)), s.range(120).select((F.col("id") * 4000000).alias("w")))


@query("prefix_complement", O + " select pos, cast(sum(1000000 - x) over (order by pos) as bigint) as cum from x")
def prefix_complement(s, d):
    return prefix.prefix(prefix.complement(order_values(s, d), 1000000)).select("pos", "cum")


@query("prefix_complement_bound", O.replace("cast(round(o_totalprice) as bigint) as x", "cast(1000000 - round(o_totalprice) as bigint) as x") + ", q as (select range * 7000000 as w from range(120)) select q.w, case when q.w <= 0 then 0 else coalesce((select min(pos) + 1 from p where cum >= q.w), (select count(*) + 1 from p)) end as lower_bound, case when q.w <= 0 then 0 else (select min(pos) from p where cum >= q.w) end as search from q")
def prefix_complement_bound(s, d):
    """Where what is missing to a million for each item has come to w."""
    sums = prefix.prefix(prefix.complement(order_values(s, d), 1000000))
    return prefix.lower_bound(sums, s.range(120).select((F.col("id") * 7000000).alias("w")))


@query("prefix_push_pop", O + ", y as (select pos, x from x union all select (select count(*) from x) + range, range * 10 from range(8)) select pos, cast(x as bigint) as x from y where pos < (select count(*) from x) + 5")
def prefix_push_pop(s, d):
    more = s.range(8).select(F.col("id").alias("n"), (F.col("id") * 10).alias("x"))
    return prefix.popped(prefix.pushed(order_values(s, d), more), 3)[0]


@query("prefix_fixed", "select range as pos, cast(coalesce(x, 0) as bigint) as x from range(2000) left join (select s_suppkey as pos, cast(round(s_acctbal) as bigint) as x from supplier) using (pos) union all select s_suppkey, cast(round(s_acctbal) as bigint) from supplier where s_suppkey >= 2000".replace("select range as pos", "select pos").replace("from range(2000)", "from (select range as pos from range(2000))"))
def prefix_fixed(s, d):
    return prefix.fixed(table(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.round("s_acctbal").cast("long").alias("x")), 2000)


@query("prefix_set", O + " select pos, case when pos % 50 = 0 and pos < 1000 then 1 else x end as x from x")
def prefix_set(s, d):
    return prefix.assigned(order_values(s, d), s.range(20).select((F.col("id") * 50).alias("pos"), F.lit(1).cast("long").alias("x")))


# signatures, codecs


@query("sign_no_false_negative", "select o_orderkey as row from orders where o_custkey = 77 and o_orderstatus = 'O'")
def sign_no_false_negative(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return signatures.holding(o, "o_orderkey", ["o_custkey", "o_orderstatus"], [F.lit(77).cast("long"), F.lit("O")])


@query("sign_candidates")
def sign_candidates(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return signatures.candidates(signatures.signed(o, "o_orderkey", ["o_custkey"]), [F.lit(77).cast("long")])


@query("sign_dump", "select o_orderkey as row, 128 as bits from orders")
def sign_dump(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return signatures.dumped(signatures.signed(o, "o_orderkey", ["o_custkey"]), 128).select("row", F.length("dump").alias("bits"))


@query("sign_optimal", "select n, fp, cast(ceil(-n * ln(fp) / (ln(2.0::double) * ln(2.0::double))) as bigint) as bits, cast(ceil(ln(2.0::double) * (-n * ln(fp) / (ln(2.0::double) * ln(2.0::double))) / n) as bigint) as hashes from (values (100, 0.05::double), (256, 0.06::double), (1000, 0.01::double)) t(n, fp)")
def sign_optimal(s, d):
    rows = [(n, fp, *signatures.optimal(n, fp)) for n, fp in ((100, 0.05), (256, 0.06), (1000, 0.01))]
    return s.createDataFrame(rows, "n int, fp double, bits bigint, hashes bigint")


BYTES = "list_transform(range(greatest(1, (length(bin(x)) + 6) // 7)), lambda i: (x >> (7 * i)) & 127)"


@query("varint", f"with t as (select distinct o_custkey * 1000 + o_orderkey as x from orders) select x, cast(greatest(1, (length(bin(x)) + 6) // 7) as bigint) as length, array_to_string(list_transform({BYTES}, lambda b, i: printf('%02x', case when i < greatest(1, (length(bin(x)) + 6) // 7) then b + 128 else b end)), '') as bytes, x as back from t")
def varint(s, d):
    t = table(s, d, "orders").select((F.col("o_custkey") * 1000 + F.col("o_orderkey")).alias("x")).distinct()
    x = F.col("x")
    return t.select(x, codecs.varint_length(x).alias("length"), codecs.varint(x).alias("bytes"), codecs.varint_decode(codecs.varint(x))["value"].alias("back"))


@query("zigzag", "select distinct k as x, case when k >= 0 then 2 * k else -2 * k - 1 end as z, k as back from (select o_orderkey - 2 * o_custkey as k from orders)")
def zigzag(s, d):
    t = table(s, d, "orders").select((F.col("o_orderkey") - 2 * F.col("o_custkey")).alias("x")).distinct()
    return t.select("x", codecs.zigzag(F.col("x")).alias("z"), codecs.unzigzag(codecs.zigzag(F.col("x"))).alias("back"))


@query("svb_scalar", "select distinct x, cast(greatest(1, (length(bin(x)) + 7) // 8) as bigint) as length, array_to_string(list_transform(range(greatest(1, (length(bin(x)) + 7) // 8)), lambda i: printf('%02x', (x >> (8 * i)) & 255)), '') as bytes from (select l_partkey * l_linenumber * 31 as x from lineitem)")
def svb_scalar(s, d):
    t = table(s, d, "lineitem").select((F.col("l_partkey") * F.col("l_linenumber") * 31).alias("x")).distinct()
    return t.select("x", codecs.scalar_length(F.col("x")).alias("length"), codecs.scalar(F.col("x")).alias("bytes"))


@query("svb_stream", "with t as (select l_suppkey as k, list(l_partkey * 17 order by l_orderkey, l_linenumber, l_partkey) as xs from lineitem group by 1) select k, len(xs) as n, cast(list_sum(list_transform(xs, lambda x: greatest(1, (length(bin(x)) + 7) // 8))) as bigint) as bytes, cast((len(xs) + 3) // 4 as bigint) as control_bytes, true as same from t")
def svb_stream(s, d):
    rows = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))).alias("r"))
    rows = rows.select("k", F.transform("r", lambda r: r["l_partkey"] * 17).alias("xs")).withColumn("e", codecs.stream_encode(F.col("xs")))
    back = codecs.stream_decode(F.col("e.data"), F.col("e.control"), F.size("xs"))
    return rows.select("k", F.size("xs").cast("long").alias("n"), (F.length("e.data") / 2).cast("long").alias("bytes"), (F.length("e.control") / 2).cast("long").alias("control_bytes"), (back == F.col("xs")).alias("same"))


@query("rrr15", "with t as (select distinct l_partkey * 37 % 32768 as x from lineitem) select x, cast(bit_count(x) as bigint) as class, x as back from t")
def rrr15(s, d):
    t = table(s, d, "lineitem").select((F.col("l_partkey") * 37 % 32768).alias("x")).distinct().withColumn("e", codecs.rrr_encode(F.col("x")))
    return t.select("x", F.col("e.class").alias("class"), codecs.rrr_decode(F.col("e.class"), F.col("e.offset")).alias("back"))


@query("rrr15_offset", "with t as (select distinct l_partkey * 37 % 32768 as x from lineitem), all15 as (select range as y, bit_count(range) as c, row_number() over (partition by bit_count(range) order by range) - 1 as o from range(32768)) select t.x, all15.o as \"offset\" from t join all15 on all15.y = t.x")
def rrr15_offset(s, d):
    t = table(s, d, "lineitem").select((F.col("l_partkey") * 37 % 32768).alias("x")).distinct()
    return t.select("x", codecs.rrr_encode(F.col("x"))["offset"].alias("offset"))


@query("reverse_bits", "select distinct x, cast(list_sum(list_transform(range(8), lambda i: ((x >> i) & 1) << (7 - i))) as bigint) as reversed from (select l_partkey % 256 as x from lineitem)")
def reverse_bits(s, d):
    return table(s, d, "lineitem").select((F.col("l_partkey") % 256).alias("x")).distinct().select("x", codecs.reverse_byte(F.col("x")).alias("reversed"))


@query("class_size", "select range as n, cast(ceil(log2(range + 1)) as int) as bits from range(1, 64)")
def class_size(s, d):
    """Bits that the class of a block of n bits takes."""
    return s.createDataFrame([(n, codecs.class_size(n)) for n in range(1, 64)], "n bigint, bits int")


# components


@query("uf_components", """with recursive e as (select distinct s_suppkey as a, s_nationkey + 1000000 as b from supplier),
 both_ways as (select a, b from e union select b, a from e),
 r(node, other) as (select a, a from both_ways union select r.node, w.b from r join both_ways w on w.a = r.other)
 select node, min(other) as component from r group by node""")
def uf_components(s, d):
    e = table(s, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 1000000).cast("long").alias("b"))
    return components(e)


@query("uf_same", "select s1.s_suppkey as a, s2.s_suppkey as b, s1.s_nationkey = s2.s_nationkey as same from supplier s1 join supplier s2 on s2.s_suppkey = s1.s_suppkey + 7")
def uf_same(s, d):
    sup = table(s, d, "supplier")
    label = components(sup.select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 1000000).cast("long").alias("b")))
    pairs = sup.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 7).alias("b"))
    return pairs.join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select("a", "b", (F.col("ca") == F.col("cb")).alias("same"))


# the content store


D = "sha256(unhex(printf('%016x', octet_length(encode(text)))) || encode(text))"


@query("cas_digest", f"select doc_id, {D} as digest from documents")
def cas_digest(s, d):
    return table(s, d, "documents").select("doc_id", digests.digest(F.col("text")).alias("digest"))


@query("cas_digest_parts", "select doc_id, sha256(unhex(printf('%016x', octet_length(encode(lang)))) || encode(lang) || unhex(printf('%016x', octet_length(encode(source)))) || encode(source)) as digest from documents")
def cas_digest_parts(s, d):
    return table(s, d, "documents").select("doc_id", digests.digest(F.col("lang"), F.col("source")).alias("digest"))


@query("cas_dedup", f"select {D} as chunk, min(octet_length(encode(text))) as size from documents group by 1")
def cas_dedup(s, d):
    made = store.put(table(s, d, "documents"), "doc_id", "text", sizes=(1 << 20, 1 << 21, 1 << 22))
    return made["payloads"].select("chunk", F.octet_length("payload").cast("long").alias("size"))


@query("cas_contains", f"with b as (select doc_id, {D} as digest from documents) select doc_id, digest, digest in (select digest from b where doc_id % 2 = 0) as found from b where doc_id % 2 = 1")
def cas_contains(s, d):
    b = table(s, d, "documents").select("doc_id", digests.digest(F.col("text")).alias("digest"))
    return store.contains(b.where("doc_id % 2 = 0"), b.where("doc_id % 2 = 1"))


@query("cas_verify", f"select distinct {D} as digest, doc_id % 5 <> 0 as valid from (select min(doc_id) as doc_id, text from documents group by text)")
def cas_verify(s, d):
    docs = table(s, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    rows = docs.select(digests.digest(F.col("text")).alias("chunk"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("payload"))
    return store.verified(rows).select(F.col("chunk").alias("digest"), "valid")


@query("cas_round_trip", "select doc_id, sha256(encode(text)) as content from documents")
def cas_round_trip(s, d):
    made = store.put(table(s, d, "documents"), "doc_id", "text", sizes=(256, 1024, 4096))
    got = store.get(made["addresses"], made["manifests"], made["payloads"])
    return made["addresses"].select(F.col("id").alias("doc_id"), "digest").join(got, "digest").select("doc_id", F.sha2("content", 256).alias("content"))


@query("cas_coded", "select doc_id, sha256(encode(text)) as content from documents")
def cas_coded(s, d):
    """The same with payloads that are compressed where that pays."""
    made = store.put(table(s, d, "documents"), "doc_id", "text", sizes=(1024, 4096, 16384), coded=True)
    got = store.get(made["addresses"], made["manifests"], made["payloads"], coded=True)
    return made["addresses"].select(F.col("id").alias("doc_id"), "digest").join(got, "digest").select("doc_id", F.sha2("content", 256).alias("content"))


@query("cas_chunks", "with t as (select doc_id, text, octet_length(encode(text)) as size from documents) select doc_id, size, true as dense, true as bounded, count(*) over (partition by text) as alike from t")
def cas_chunks(s, d):
    """Chunks by content: their sizes add up, their numbers are dense, none but the last is too small and none too large;
    and contents are cut alike just where they are equal."""
    least, most = 256, 4096
    c = store.chunked(table(s, d, "documents"), "doc_id", "text", (least, 1024, most)).drop("payload")
    each = c.groupBy("id").agg(F.sum("size").alias("size"), (F.max("seq") + 1 == F.count(F.lit(1))).alias("dense"), F.array_sort(F.collect_list(F.struct("seq", "size", "chunk"))).alias("cut"))
    fine = F.forall("cut", lambda x: (x["size"] <= most) & ((x["size"] >= least) | (x["seq"] == F.size("cut") - 1)))
    alike = each.groupBy("cut").agg(F.count(F.lit(1)).alias("alike"))
    return each.join(alike, "cut").select(F.col("id").alias("doc_id"), "size", "dense", fine.alias("bounded"), "alike")


@query("content_coded", "select doc_id, sha256(encode(text)) as back, true as smaller from documents")
def content_coded(s, d):
    """Bytes as they're stored, at most one longer than they were, and back."""
    docs = table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    kept = content.encoded(docs.withColumn("n", F.octet_length("data")), "data").withColumn("smaller", F.octet_length("data") <= F.col("n") + 1)
    return content.decoded(kept, "data").select("doc_id", F.sha2("data", 256).alias("back"), "smaller")


@query("cas_pack_index", f"with p as (select distinct {D} as chunk, octet_length(encode(text)) as length from documents) select chunk, cast(0 as bigint) as pack, cast(coalesce(sum(length) over (order by chunk rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", length from p")
def cas_pack_index(s, d):
    made = store.put(table(s, d, "documents"), "doc_id", "text", sizes=(1 << 20, 1 << 21, 1 << 22))
    return store.packed(made["payloads"], 1 << 30)[1]


@query("tree_build", "with l as (select c_nationkey as tree, c_mktsegment as name, max(c_custkey) as child from customer group by all) select tree, string_agg(name || '=' || child, ';' order by name) as entries from l group by tree")
def tree_build(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("tree"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"), F.lit("blob").alias("kind"), F.col("c_custkey").cast("string").alias("child"))
    return store.trees(c).select("tree", F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["name"], e["child"])), ";").alias("entries"))


@query("tree_resolve", """with recursive e as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union select 'n' || s_nationkey, 's' || s_suppkey from supplier),
 w(root, node, depth) as (select 'r' || r_regionkey, 'r' || r_regionkey, 0 from region union select w.root, e.child, w.depth + 1 from w join e on e.parent = w.node)
 select root, node, cast(min(depth) as int) as depth from w group by root, node""")
def tree_resolve(s, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(s, d, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"))
    e = e.union(table(s, d, "supplier").select(key("n", "s_nationkey"), key("s", "s_suppkey")))
    return store.resolved(e, table(s, d, "region").select(key("r", "r_regionkey").alias("root")))


FRAMED = "sha256(unhex(printf('%016x', octet_length(encode({0})))) || encode({0}))"
COMMAND = FRAMED.format("('{\"v\":{\"program\":\"python3\",\"args\":[\"main.py\",\"' || n_name || '\"],\"env\":[{\"key\":\"KEY\",\"value\":\"' || n_nationkey || '\"}]}}')")


@query("function_digest", "with c as (select n_nationkey, " + COMMAND + " as command from nation) select n_nationkey, command, " + FRAMED.format("('{\"v\":{\"kind\":\"action\",\"command\":\"' || command || '\",\"config\":\"' || command || '\"}}')") + " as action from c")
def function_digest(s, d):
    n = table(s, d, "nation")
    cmd = store.command(F.lit("python3"), F.array(F.lit("main.py"), F.col("n_name")), F.create_map(F.lit("KEY"), F.col("n_nationkey").cast("string")))
    return n.select("n_nationkey", store.struct_digest(cmd).alias("command")).withColumn("action", store.struct_digest(store.function("action", F.col("command"), F.col("command"))))


# logs, streams and parsers


@query("log_replay")
def log_replay(s, d):
    """Parts appended to a log of segments of 16 KB, then replayed."""
    base = f"{scratch_dir(s)}/log-{uuid.uuid4().hex}"
    segments.append(table(s, d, "part").select("p_partkey", "p_name"), base, "p_name", ["p_partkey"], most_bytes=1 << 14)
    return segments.replay(s, base).select("segment", F.col("value").cast("string").alias("value"))


LOG = "with n as (select p_partkey, p_name, octet_length(encode(p_name)) + 4 as n from part), c as (select *, sum(n) over (order by p_partkey) - n as before from n)"
SQL["log_replay"] = LOG + " select cast(before // 16384 as bigint) as segment, p_name as value from c"


@query("log_state", LOG + " select cast(before // 16384 as bigint) as segment, cast(sum(n) + 5 as bigint) as bytes, cast(sum(n) + 5 as bigint) as valid_bytes, count(*) as records, false as torn from c group by 1")
def log_state(s, d):
    base = f"{scratch_dir(s)}/log-{uuid.uuid4().hex}"
    segments.append(table(s, d, "part").select("p_partkey", "p_name"), base, "p_name", ["p_partkey"], most_bytes=1 << 14)
    return segments.segment_state(s, base)


@query("stream_ingest", f"select distinct {D} as chunk from documents")
def stream_ingest(s, d):
    """Documents as a stream, staged in micro-batches, packed, and read again."""
    base = f"{scratch_dir(s)}/ingest-{uuid.uuid4().hex}"
    docs = table(s, d, "documents")
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    # a stream reads folders
    reader = s.readStream.schema(docs.schema)
    stream = reader.parquet(f"{d}/documents.parquet") if status.isDirectory() else reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    ingest.start(stream, base, "text").awaitTermination()
    ingest.compact(s, base)
    return ingest.payloads(s, base).select("chunk")


@query("shtok_tokens", "select page_id, len(string_split_regex(trim(url), '[ \\t]+')) as n_tokens from pages")
def shtok_tokens(s, d):
    pages = table(s, d, "pages").select("page_id", "url")
    return parsers.tokens_table(pages, "page_id", "url").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tokens"))


@query("shtok_words", "select page_id, 'run|--id=' || page_id || '|a b|port 80|lit $X|' || url as tokens from pages")
def shtok_words(s, d):
    """Escaped newlines and blanks, both kinds of quotes, variables inside and outside of them."""
    line = F.concat(F.lit("run \\\n--id="), F.col("page_id").cast("string"), F.lit(' a\\ b "port $PORT" \'lit $X\' "'), F.col("url"), F.lit('"\n'))
    pages = table(s, d, "pages").select("page_id", line.alias("text"))
    got = parsers.tokens_table(pages, "page_id", "text", {"PORT": "80"})
    return got.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "tok_no", "token"))).alias("t")).select("page_id", F.array_join("t.token", "|").alias("tokens"))


@query("markdown_blocks")
def markdown_blocks(s, d):
    return parsers.blocks_table(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")
