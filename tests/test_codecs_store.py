"""Round trips of codecs, the store, parsers, segments and ingestion; tampered data."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from posetta.functions import codecs, digests
from posetta.functions.parsers import markdown_blocks, token_lines
from posetta.operators import signatures, store
from posetta.sources import segments
from posetta.streaming import ingest


def test_varint_and_zigzag(spark):
    rng = random.Random(1)
    xs = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1, -(2**63)] + [rng.randrange(2**63) >> rng.randrange(63) for _ in range(100)]
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in xs], "x bigint")
    got = df.select("x", codecs.varint(x).alias("h"), codecs.varint_decode(codecs.varint(x)).alias("d"), codecs.unzigzag(codecs.zigzag(x)).alias("z")).collect()
    for r in got:
        u, want = r.x % 2**64, ""
        while True:
            want += f"{u & 127 | (128 if u > 127 else 0):02x}"
            u >>= 7
            if not u:
                break
        assert (r.h, r.d.value, r.d.length, r.z) == (want, r.x, len(want) // 2, r.x)
    bad = spark.createDataFrame([("",), ("80",), ("ff" * 10,)], "h string").select("h", codecs.varint_decode(F.col("h")).alias("d")).collect()
    assert [(r.d.value, r.d.length) for r in bad] == [(None, 0), (None, 0), (None, 10)]


def test_stream_and_blocks(spark):
    rng = random.Random(2)
    arrays = [[], [0], [1, 255, 256, 65536, 2**32 - 1]] + [[rng.randrange(2**32) >> rng.randrange(32) for _ in range(rng.randrange(20))] for _ in range(20)]
    df = spark.createDataFrame([(a,) for a in arrays], "xs array<bigint>").withColumn("e", codecs.stream_encode(F.col("xs")))
    for r in df.select("xs", "e", codecs.stream_decode(F.col("e.data"), F.col("e.control"), F.size("xs")).alias("back")).collect():
        assert r.back == r.xs
        assert len(r.e.control) == 2 * -(-len(r.xs) // 4)
    # fixed values: offsets of the enumerative code of 15 bits
    rrr = spark.createDataFrame([(x,) for x in (0, 1, 2, 0x4000, 3, 0x6000, 0x7FFF, 0xFFFF)], "x int").withColumn("e", codecs.rrr_encode(F.col("x")))
    assert {r.x: (r["class"], r.offset) for r in rrr.select("x", "e.*").collect()} == {0: (0, 0), 1: (1, 0), 2: (1, 1), 0x4000: (1, 14), 3: (2, 0), 0x6000: (2, 104), 0x7FFF: (15, 0), 0xFFFF: (15, 0)}
    assert [codecs.class_size(n) for n in (4, 15, 31, 63)] == [3, 4, 5, 6]
    four = spark.range(16).withColumn("e", codecs.rrr_encode(F.col("id"), 4)).select("id", "e.*", codecs.rrr_decode(F.col("e.class"), F.col("e.offset"), 4).alias("back")).collect()
    assert all(r.back == r.id for r in four) and len({(r["class"], r.offset) for r in four}) == 16


def test_digests(spark):
    d = lambda *parts: spark.range(1).select(digests.digest(*[F.lit(p) for p in parts])).first()[0]
    # a fixed value of the framing
    assert d("hello") == "c6402d15196824a049ad87c371a5047a673535c2ac8607e2bfa483f7591cc27a"
    assert len({d("a", "b"), d("b", "a"), d("ab"), d()}) == 4
    assert d("é") == hashlib.sha256(struct.pack(">Q", 2) + "é".encode()).hexdigest()


def test_store_round_trip_and_tampering(spark):
    rng = random.Random(3)
    big = bytes(rng.randrange(256) for _ in range(60000))
    rows = [(1, big), (2, big + b"tail"), (3, b""), (4, b"small"), (5, b"small"), (6, None)]
    df = spark.createDataFrame(rows, "id int, content binary")
    made = store.put(df, "id", "content", sizes=(512, 2048, 8192))
    made = {k: v.cache() for k, v in made.items()}
    content = {r.digest: r.content for r in store.get(made["addresses"], made["manifests"], made["payloads"]).collect()}
    assert {r.id: bytes(content[r.digest]) for r in made["addresses"].collect()} == {i: c or b"" for i, c in rows}
    alone = store.put(df.where("id = 1"), "id", "content", sizes=(512, 2048, 8192))["payloads"]
    more = store.put(df.where("id = 2"), "id", "content", alone, sizes=(512, 2048, 8192))["payloads"]
    assert 0 < more.count() < alone.count()  # the shared prefix is stored once
    bad = made["payloads"].withColumn("payload", F.concat("payload", F.lit(b"x")))
    assert all(r.content is None for r in store.get(made["addresses"], made["manifests"], bad, strict=False).collect())
    with pytest.raises(Exception, match="invalid data"):
        store.get(made["addresses"], made["manifests"], bad).collect()
    missing = spark.createDataFrame([("0" * 64,)], "digest string")
    assert store.get(missing, made["manifests"], made["payloads"]).first().content is None
    assert not store.contains(made["addresses"], missing).first().found


def test_trees(spark):
    e = spark.createDataFrame([(1, 0, "b", "blob", "x"), (1, 1, "a", "blob", "y"), (1, 2, "b", "tree", "z")], "tree int, ord int, name string, kind string, child string")
    i = spark.createDataFrame([(1, "q"), (1, "p"), (1, "q"), (2, "r")], "tree int, digest string")
    got = {r.tree: r for r in store.trees(e, i).collect()}
    assert [(x.name, x.kind, x.child) for x in got[1].entries] == [("a", "blob", "y"), ("b", "tree", "z")]
    assert got[1].interns == ["p", "q"] and got[2].entries is None
    cmd = lambda args, env: spark.range(1).select(store.struct_digest(store.command(F.lit("p"), F.array(*map(F.lit, args)), F.create_map(*map(F.lit, env))))).first()[0]
    assert cmd(["a", "b"], ["K", "1", "L", "2"]) == cmd(["a", "b"], ["L", "2", "K", "1"]) != cmd(["b", "a"], ["K", "1", "L", "2"])


def test_signatures(spark):
    assert signatures.optimal(100, 0.05) == (624, 5) and signatures.optimal(256, 0.06) == (1500, 5)
    with pytest.raises(ValueError):
        signatures.optimal(0, 0.5)
    rng = random.Random(6)
    rows = [(i, "tags", rng.randrange(1000)) for i in range(100) for _ in range(4)] + [(i, "pref", rng.randrange(50)) for i in range(100)]
    df = spark.createDataFrame(rows, "row bigint, field string, value bigint")
    signs = signatures.signed(df, "row", ["field", "value"]).cache()
    for row, field, value in rows[::60]:
        item = [F.lit(field), F.lit(value).cast("long")]
        found = {r.row for r in signatures.candidates(signs, item).collect()}
        assert row in found
        exact = {r.row for r in signatures.holding(df, "row", ["field", "value"], item).collect()}
        assert exact == {a for a, f, v in rows if (f, v) == (field, value)}
    assert len(signatures.dumped(signs, 1500).first().dump) == 1504 and len(signatures.dumped(signs, 1500, True).first().dump) == 376


def test_tokens():
    t = lambda s, **v: token_lines(s.encode(), v)
    assert t("serve --at \\\n  $HOST:80\n\n\n  # not a comment\n", HOST="10.0.0.1") == [["serve", "--at", "10.0.0.1:80"], ["#", "not", "a", "comment"]]
    assert t("") == t("\t\n \r\n") == []
    assert t("x'y z'w") == [["xy zw"]] and t('"two\nlines" end') == [["two\nlines", "end"]] and t("ü \\\nß") == [["ü", "ß"]]
    assert t('say "a \\$B c"') == [["say", "a $B c"]] and t("a\\ b c\\\\d") == [["a b", "c\\d"]]
    assert t("one\r\ntwo") == [["one"], ["two"]] and t("k=$UNSET;") == [["k=;"]]
    assert t("'$K' \"$K\" $K", K="v w") == [["$K", "v w", "v w"]]
    with pytest.raises(ValueError):
        t("cost $ 5")


def test_canonical_maps(spark):
    from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

    inner = MapType(StringType(), StringType())
    kind = StructType([StructField("m", inner), StructField("l", ArrayType(inner))])
    rows = spark.createDataFrame([(({"a": "1", "b": "2"}, [{"x": "1", "y": "2"}]),), (({"b": "2", "a": "1"}, [{"y": "2", "x": "1"}]),), (({"b": "1", "a": "2"}, [{"y": "2", "x": "1"}]),), ((None, [None]),)], StructType([StructField("v", kind)]))
    got = [r[0] for r in rows.select(digests.canonical(F.col("v"), kind)).collect()]
    assert got[0] == got[1] != got[2] and "null" in got[3]


def test_product_of_the_least_long(spark):
    from posetta.operators import folds

    one = lambda *xs: folds.product(spark.createDataFrame([(x,) for x in xs], "x bigint")).first()[0]
    assert one(-(1 << 63)) == -(1 << 63) and one(-(1 << 62), 2) == -(1 << 63) and one(3, -1, 0) == 0 and one(-3, -5) == 15
    with pytest.raises(Exception, match="OVERFLOW|out of range"):
        one(1 << 62, 2)


def test_coded_store_and_its_checks(spark):
    rows = [(1, b"a" * 30000), (2, random.Random(9).randbytes(9000)), (3, b"")]
    made = {k: v.cache() for k, v in store.put(spark.createDataFrame(rows, "id int, content binary"), "id", "content", sizes=(512, 2048, 8192), coded=True).items()}
    got = {r.digest: bytes(r.content) for r in store.get(made["addresses"], made["manifests"], made["payloads"], coded=True).collect()}
    assert {r.id: got[r.digest] for r in made["addresses"].collect()} == dict(rows)
    assert made["payloads"].agg(F.sum(F.octet_length("payload"))).first()[0] < 15000
    longer = made["addresses"].withColumn("size", F.col("size") + 1)
    assert all(r.content is None for r in store.get(longer, made["manifests"], made["payloads"], strict=False, coded=True).collect())
    nested = made["manifests"].union(made["manifests"].select(F.col("chunk"), F.lit(0).cast("long"), "chunk", "size"))
    assert any(r.content is None for r in store.get(made["addresses"], nested, made["payloads"], strict=False, coded=True).collect())


def test_markdown():
    got = markdown_blocks("# One\n\ntext\nmore\n\n- a\n- b\n\n## Two\n```\n# no\n```\n> q\n\n---\n")
    kinds = [(d, k, a, b) for d, k, a, b, _ in got]
    assert kinds == [(0, "document", 0, 16), (1, "section", 0, 16), (2, "atx_heading", 0, 1), (2, "paragraph", 2, 4), (2, "list", 5, 7), (3, "list_item", 5, 6), (3, "list_item", 6, 7), (2, "section", 8, 16), (3, "atx_heading", 8, 9), (3, "fenced_code_block", 9, 12), (3, "block_quote", 12, 13), (3, "thematic_break", 14, 15)]


def test_segments(spark, tmp_path):
    whole = segments.encoded([b"one", b"", b"three"])
    (tmp_path / f"{1:020}.log").write_bytes(whole)
    (tmp_path / f"{2:020}.log").write_bytes(segments.encoded([b"kept", b"torn"])[:-2])
    (tmp_path / f"{3:020}.log").write_bytes(b"other")
    (tmp_path / "note.log").write_bytes(whole)
    got = sorted((r.segment, r.slot, bytes(r.value)) for r in segments.replay(spark, str(tmp_path)).collect())
    assert got == [(1, 0, b"one"), (1, 1, b""), (1, 2, b"three"), (2, 0, b"kept")]
    assert {r.segment: r.torn for r in segments.segment_state(spark, str(tmp_path)).collect()} == {1: False, 2: True}


def test_appending_to_a_log(spark, tmp_path):
    path, rng = str(tmp_path / "log"), random.Random(10)
    values = [rng.randbytes(rng.randrange(60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)) + [(200, None)], "n bigint, v binary")
    made = segments.append(df, path, "v", ["n"], most_bytes=1000)
    assert made == (sum(len(v) + 4 for v in values)) // 1000 + 1
    assert segments.append(df.where("n < 3"), path, "v", ["n"], most_bytes=1000) == 1
    got = [bytes(r.value) for r in segments.replay(spark, path).orderBy("segment", "slot").collect()]
    assert got == [*values, b"", *values[:3]]
    with pytest.raises(ValueError):
        segments.append(df, path, "v", ["n"], most_total=9000)
    assert segments.replay(spark, path).count() == 204 and not any(r.torn for r in segments.segment_state(spark, path).collect())


def test_appending_many_segments(spark, tmp_path, monkeypatch):
    """The number of jobs doesn't grow with the segments, and the pieces of a segment come in order."""
    monkeypatch.setattr(segments, "PIECE", 64, raising=False)
    path, rng = str(tmp_path / "log"), random.Random(12)
    values = [rng.randbytes(rng.choice((0, 5, 40, 300))) for _ in range(1500)]
    spark.sparkContext.setJobGroup("append", "")
    made = segments.append(spark.createDataFrame(list(enumerate(values)), "n bigint, v binary"), path, "v", ["n"], most_bytes=700)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert made > 150 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("append")) < 60
    got = [bytes(r.value) for r in segments.replay(spark, path).orderBy("segment", "slot").collect()]
    assert got == values


def test_ingestion(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "store")
    for k in range(3):
        spark.createDataFrame([(f"text {i}",) for i in range(k, k + 4)], "text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest.start(stream(), base, "text", most_pending=2).awaitTermination()
    assert ingest.payloads(spark, base).count() == 6
    assert ingest.compact(spark, base) > 0 and ingest.compact(spark, base) == 0
    ingest.forget(spark, base)
    assert sorted(bytes(r.payload).decode() for r in ingest.payloads(spark, base).collect()) == [f"text {i}" for i in range(6)]
    spark.createDataFrame([("text 0",), ("new",)], "text string").write.mode("append").parquet(str(source))
    query = ingest.start(stream(), base, "text")
    query.awaitTermination()
    assert ingest.payloads(spark, base).count() == 7 and not ingest.progress(query)["failed"]


def test_slicing(spark):
    from posetta.functions import slicing
    from posetta.operators import bits

    rng = random.Random(7)
    sets = {"full": range(65536, 131072), "dense": rng.sample(range(65536), 40000), "middle": rng.sample(range(65536), 9000), "few": [0, 255, 256, 65535, 3 << 16], "runs": [*range(300, 340), *range(70000, 70020)]}
    rows = spark.createDataFrame([(k, p) for k, v in sets.items() for p in v], "set_id string, pos bigint")
    chunks = slicing.sliced(bits.blocks(rows)).cache()
    assert sorted(slicing.unsliced(chunks).collect()) == sorted(rows.collect())
    kinds = {(r.set_id, r.block): (r.kind & 255, r.ones) for r in chunks.collect()}
    assert kinds["full", 1] == (slicing.FULL, 65536) and kinds["dense", 0][0] == slicing.DENSE and kinds["few", 3] == (slicing.SPARSE, 1)
    for r in slicing.serialised(chunks).collect():
        found = [int(p) + i * 65536 for i, ones, kind, data in slicing.parse(bytes(r.data)) for p in slicing.chunk_decode(ones, kind, data)]
        assert found == sorted(sets[r.set_id])
    assert slicing.assemble([]) == b"" and list(slicing.parse(b"")) == []


def test_content(spark):
    from posetta.functions import content

    rows = [(1, b""), (2, b"a" * 50000), (3, random.Random(8).randbytes(5000)), (4, None)]
    df = spark.createDataFrame(rows, "id int, data binary")
    kept = content.encoded(df, "data").cache()
    assert {r.id: None if r.data is None else r.data[-1] for r in kept.collect()} == {1: 0, 2: 1, 3: 0, 4: None}
    assert {r.id: r.data and bytes(r.data) for r in content.decoded(kept, "data").collect()} == {k: v for k, v in rows}
    for bad in (b"", b"junk\x01"):
        with pytest.raises(ValueError):
            content.decode(bad)


def test_closures(spark):
    from posetta.operators import folds

    df = spark.createDataFrame([("a", i, i) for i in range(10)] + [("b", 0, 5)], "k string, pos bigint, x bigint")
    got = folds.closure(df, ["k"], lambda s, x: (s + x, s + x >= 10), 0, "bigint", lambda s: s * 2)
    assert sorted(got.collect()) == [("a", 20), ("b", 10)]
