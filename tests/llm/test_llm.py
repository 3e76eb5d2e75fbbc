"""Operators of the training-data pipeline against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posetta.llm import bpe, exact_dedup, jaccard, lines, mixing, passages, pii, quality, secrets, shingles, spans, vectors

FOLD = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "_size int, _h string, c int, _id int, _t string, id int, slice int, part int, ka int, cuts string, copy int, h string, _posetta_score double, score double"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {ODD}"
NO_ID = "one row that has no id"


def docs(spark, texts, sources=None):
    """Rows with odd extra columns; ids from 0, the last row repeated and one row without an id."""
    odd = (1, "h", 1, 2, "t", 3, 4, 5, 6, "x", 7, "y", 0.5, 0.25)
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), *odd) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[-1:], (None, NO_ID, "en", (sources or ["s"])[0], len(NO_ID), *odd)], SCHEMA)


def text_of(texts, i):
    return NO_ID if i is None else texts[i] or ""


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def span_digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)).encode()).hexdigest()


SECRET_TEXTS = [None, "", 'é password = "hunter22" x', "PASSWD:abc token==abcdef api-key: 12345678, api_key='0123456'", "AKIA" + "A1" * 8 + " AKIASHORT xAKIA" + "B" * 20, "deadbeef" * 3 + " " + "0123456789abcdef" * 9000, "tokentoken:::aaaaaaa" * 3, "key q7Rk2LmP9xWv4TzB8nYc3DfG6hJs1 end", "123e4567-e89b-12d3-a456-426614174000 aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "example-q7Rk2LmP9xWv4TzB8nYc3"]


def test_secrets(spark, empty):
    df = docs(spark, SECRET_TEXTS)
    got = secrets.digest(secrets.scan_secrets(df)).collect()
    assert len(got) == len(SECRET_TEXTS) + 2 and secrets.scan_secrets(empty).count() == 0
    patterns = [("assign", re.compile(r"(?a)(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    for r in got:
        t = text_of(SECRET_TEXTS, r.doc_id)
        want = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(patterns) for m in p.finditer(t) if (k == 0 and len(m[2]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24)]
        assert r.base_sha256 == span_digest(want)
        assert (r.n_entropy > 0) == (r.doc_id == 7), r


def test_entropy_windows_by_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghijklmnop0123456789"[: rng.randint(2, 26)]) for _ in range(rng.randint(5, 60))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.entropy_windows(F.col("t"), 12, F.lit(2.9)).alias("w"))
    for r in df.collect():
        def bits(w):
            return -sum(c / 12 * np.log2(c / 12) for c in collections.Counter(w).values())

        hits = [i for i in range(len(r.t) - 11) if bits(r.t[i : i + 12]) >= 2.9 - 1e-12]
        assert (r.w and (r.w["from"], r.w["to"])) == ((hits[0], hits[-1] + 12) if hits else None)


def luhn(x):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0


PII_TEXTS = [None, "", "mail é a.b@c.de, a@b@c.d.e. x@y", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 1 2", "+1 (555) 555-1234 +12 +1 2345678901234567890", "9" * 50000, "a." * 40000 + "@", "x@" + "a." * 20000 + "b", "write to jo (at) host (dot) com or call 415-555-1234", "section 123-45-6789"]


def test_pii(spark, empty):
    got = pii.digest(pii.find_pii(docs(spark, PII_TEXTS))).collect()
    assert len(got) == len(PII_TEXTS) + 2 and pii.find_pii(empty).count() == 0
    rules = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m, d: True), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m, d: all(int(x) <= 255 for x in m.split("."))), ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m, d: 12 <= len(d) <= 19 and luhn(d)), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m, d: 9 <= len(d) <= 15)]
    for r in got:
        t = text_of(PII_TEXTS, r.doc_id) if r.doc_id != 7 else ""  # the pattern as it stands is quadratic on that one
        want = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(rules) for m in p.finditer(t) if ok(m[0], re.sub("[^0-9]", "", m[0]))]
        assert r.base_sha256 == span_digest(want), r.doc_id
        assert set(f"{n}:{a}:{b}" for a, _, n, b in want) <= set(r.spans.split(","))


def test_reliabilities_by_kind():
    """A labeler that agrees with the others is relied on, one that contradicts them isn't; drawn votes give back how they were drawn."""
    rng = np.random.default_rng(11)
    true = rng.random(20_000) < 0.6
    right = [0.9, 0.8, 0.7, 0.4]
    votes = np.stack([np.where(rng.random(len(true)) < r, np.where(true, 1, -1), np.where(true, -1, 1)) for r in right], 1)
    counts = collections.Counter(map(tuple, votes.tolist()))
    prior, like = pii.reliabilities(sorted((v, float(n)) for v, n in counts.items()), 300)
    assert abs(prior - 0.6) < 0.05 and all(abs(like[k][1][0] - right[k]) < 0.05 and abs(like[k][-1][1] - right[k]) < 0.05 for k in range(4))
    assert pii.posterior((1, 1, 1, -1), prior, like) > 0.95 > 0.05 > pii.posterior((-1, -1, -1, 1), prior, like)


def test_the_classifier_sees_what_votes_do_not():
    """Candidates with the same undecided votes are told apart by the words around them."""
    rng = np.random.default_rng(12)
    rows, post = [], []
    for _ in range(1500):
        true = rng.random() < 0.5
        votes = (1, 1 if rng.random() < (0.8 if true else 0.2) else -1, 1 if rng.random() < (0.8 if true else 0.2) else -1, 0)
        rows.append((5, votes, [3, 2, int(rng.integers(0, 8)) + 20 * true, int(rng.integers(0, 64)), int(rng.integers(0, 64))]))
        post.append({2: 0.94, 0: 0.5, -2: 0.06}[votes[1] + votes[2]])
    w = pii.classifier(rows, post, [1.0] * len(rows))
    for word in range(8):
        assert pii.probability(w, 5, (1, 1, -1, 0), [3, 2, 20 + word, 1, 1]) > pii.probability(w, 5, (1, 1, -1, 0), [3, 2, word, 1, 1])


def test_account_sums_and_chances(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432",), ("DE89370400440532013000",), ("DE89370400440532013001",)], "n string")
    assert [r[0] for r in df.select(pii.account_sum(F.col("n"))).collect()] == [True, True, False]
    w = np.random.default_rng(13).standard_normal(pii.layout()[1])
    x = spark.createDataFrame([((5,), [1, 0, -1, 1], [31, 7, 63, 0, 12]), ((0,), [1, -1, 1, 0], [0, 0, 1, 2, 3])], "s struct<kind:int>, v array<int>, f array<int>")
    for r in x.select("*", pii.chance(F.struct("s", "v", "f"), w).alias("p")).collect():
        assert r.p == pytest.approx(pii.probability(w, r.s.kind, tuple(r.v), r.f), abs=1e-6)


def test_added_spans(spark):
    """Looser kinds are found where context speaks for them, and left alone where it speaks against them."""
    rng = random.Random(14)
    texts = []
    for k in range(120):
        texts.append(f"{words(rng, 8)} call {rng.randint(2, 9)}{rng.randint(0, 8)}{rng.randint(0, 9)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} {words(rng, 5)}")
        texts.append(f"{words(rng, 8)} part no {rng.randint(990, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} {words(rng, 5)}")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    assert sum("national_phone" in got[i] for i in range(0, 240, 2)) >= 114 and not any("national_phone" in got[i] for i in range(1, 240, 2))


def test_exact_dedup(spark, empty):
    texts = ["Ab", "aB", None, "", "É", "é", *["copy"] * 300, "x" * 200000, "X" * 200000]
    df = docs(spark, texts)
    for keep, best in (("max", max), ("min", min)):
        got = exact_dedup.exact_dedup(df, keep=keep, chunk_rows=16).collect()
        groups = collections.defaultdict(list)
        for i, t in [*enumerate(texts), (len(texts) - 1, texts[-1])]:
            groups[(t or "").translate(FOLD)].append(i)
        want = sorted((i, best(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == want
        assert sorted(r.doc_id for r in got if r.kept and r.doc_id is not None) == sorted(best(g) for g in groups.values())
        assert [(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is None] == [(None, 1, True)]
    assert exact_dedup.exact_dedup(empty).count() == 0


def without_repeats(texts, words):
    """Lines that stand in a run of so many words that stands earlier, by trying every run of lines."""
    seen, gone = set(), []
    for t in texts:
        solid = [(k, x, len(WORD.findall(x))) for k, x in enumerate(t.split("\n")) if WORD.search(x)]
        out, new = set(), []
        for a in range(len(solid)):
            for b in range(a + 1, min(len(solid), a + 2 * words) + 1):
                run = tuple(x for _, x, _ in solid[a:b])
                if sum(n for _, _, n in solid[a:b]) >= words:
                    if run in seen:
                        out |= {k for k, _, _ in solid[a:b]}
                    seen.add(run)
        gone.append(out)
    return gone


def test_line_dedup(spark, empty):
    rng = random.Random(2)
    pool = [words(rng, rng.choice([1, 1, 2, 3, 4, 6])) for _ in range(14)]
    texts = [None, "", "\n\n", " \n a b c d e\n", *["\n".join([*rng.choices(pool, k=rng.randint(1, 4)), words(rng, 2), "", *rng.choices(pool, k=rng.randint(0, 5))]) for _ in range(60)], "{\n}\n" * 40]
    got = {r.doc_id: r for r in lines.line_dedup(docs(spark, texts)).collect()}
    want = without_repeats([NO_ID, *(t or "" for t in texts)], 5)
    for i, gone in zip([None, *range(len(texts))], want):
        t = text_of(texts, i)
        assert set(got[i].removed) == gone and got[i].n_lines == t.count("\n") + 1, i
        assert got[i].clean == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    assert sum(map(len, want)) > 100
    assert lines.line_dedup(empty).count() == 0 and lines.digest(lines.line_dedup(docs(spark, texts))).count() == len(texts) + 2


def test_runs_that_stood_apart_before(spark):
    """A run that stands whole in one document goes whole, though its lines stood elsewhere before."""
    rng = random.Random(21)
    texts, need = [], 0
    for k in range(60):
        run = [words(rng, 3) for _ in range(4 + 2 * (k % 2))]
        texts += ["\n".join([words(rng, 6), *run[i : i + 2], words(rng, 6)]) for i in range(0, len(run), 2)] + ["\n".join([words(rng, 7), *run, words(rng, 7)])] * 1
        texts.append("\n".join([words(rng, 5), *run]))
        need += len(run)
    got = {r.doc_id: r.removed for r in lines.line_dedup(docs(spark, texts)).collect()}
    at = 0
    for k in range(60):
        n = 4 + 2 * (k % 2)
        at += n // 2 + 2
        assert got[at - 1] == list(range(1, n + 1))


def test_long_texts(spark):
    """Work grows with the length, not with its square, with which these would take hours."""
    rng = random.Random(22)
    run, many = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300_000)), " ".join(f"token={k:09}x a{k}@b.de" for k in range(30_000))
    df = spark.createDataFrame([(0, run), (1, many)], "doc_id bigint, text string").repartition(2, "doc_id")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan_secrets(df)).collect()}
    kind, start, end = got[0].spans.split(":")
    assert kind == "entropy" and int(start) < 100 and int(end) > 299_900 and got[1].n_assign == 30_000 and got[1].n_entropy == 0
    found = {r.doc_id: r for r in pii.digest(pii.find_pii(df)).collect()}
    assert found[1].n_email == 30_000 and found[0].n_email == 0
    text = "\n".join(words(rng, rng.randint(1, 7)) for _ in range(40_000))
    got = {r.doc_id: r for r in lines.digest(lines.line_dedup(spark.createDataFrame([(0, text), (1, "x\n" + text)], "doc_id bigint, text string"))).collect()}
    assert got[0].n_removed < 1000 and got[1].n_removed >= 39_990


def test_words_are_no_secrets(spark):
    texts = ["getHttpServletRequestAttributeName", "configuration-and-installation-guide", "qKxRmPwTzBnYcDfGhJsLvQ", "kq" * 3 + "zxwvbnmtrplkjhgfdscq", "src/main/java/org/apache/Example1"]
    got = {r.doc_id: r.n_entropy for r in secrets.digest(secrets.scan_secrets(docs(spark, texts))).collect()}
    assert [got[i] for i in range(5)] == [0, 0, 1, 1, 0]


def test_passages(spark, empty):
    rng = random.Random(3)
    shared, texts = [words(rng, 60) for _ in range(6)], [None, "", "one two", "x " * 20000]
    for k in range(30):
        texts.append(" ".join([words(rng, rng.randint(0, 120)), shared[k % 7] if k % 7 < 6 else "", words(rng, 80)]))
    near = shared[0].split(" ")
    near[30] = "changed"
    texts += [words(rng, 50) + " " + " ".join(near), texts[10].upper(), words(rng, 300)]
    got = passages.repeated_passages(docs(spark, texts)).collect()
    split = [WORD.findall((t or "").translate(FOLD)) for t in texts]
    where = collections.defaultdict(set)
    for i, w in enumerate(split):
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    covered = collections.defaultdict(set)
    for r in got:
        assert r.similarity >= 0.8 and r.ref_doc_id < r.doc_id
        covered[r.doc_id].update(range(r.start_word, r.end_word))
        covered[r.ref_doc_id].update(range(r.ref_start, r.ref_end))
    for i, w in enumerate(split):
        need = {j for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for j in range(k, k + 50)}
        assert need <= covered[i], i
    assert len(covered[len(texts) - 3]) >= 60 and not covered[len(texts) - 1]
    assert passages.repeated_passages(empty).count() == 0


def covered_words(rows):
    out = collections.defaultdict(set)
    for r in rows:
        out[r.doc_id].update(range(r.start_word, r.end_word))
        out[r.ref_doc_id].update(range(r.ref_start, r.ref_end))
    return out


def test_passages_that_stand_twice_in_a_document(spark):
    rng = random.Random(31)
    texts = []
    for k in range(20):
        shared = words(rng, 55 + 5 * k)
        twice, once = [words(rng, 40), shared, words(rng, 60), shared, words(rng, 30)], [words(rng, 70), shared, words(rng, 20)]
        texts += [" ".join(t) for t in ((twice, once) if k % 2 else (once, twice))]
    covered = covered_words(passages.repeated_passages(docs(spark, texts)).collect())
    for k in range(20):
        n, both, one = 55 + 5 * k, 2 * k + 1 - k % 2, 2 * k + k % 2
        assert covered[both] >= {*range(40, 40 + n), *range(100 + n, 100 + 2 * n)}
        assert covered[one] >= set(range(70, 70 + n))


@pytest.mark.parametrize("common,own", [(40, 20), (45, 15)])
def test_passages_behind_boilerplate(spark, common, own):
    rng = random.Random(32)
    boilerplate, texts, need = words(rng, common), [], {}
    for k in range(240):
        shared = words(rng, own)
        for _ in range(2 if k % 2 else 1):
            before = rng.randint(60, 90)
            need[len(texts)] = set(range(before, before + common + own)) if k % 2 else set()
            texts.append(" ".join([words(rng, before), boilerplate, shared, words(rng, 60)]))
    order = rng.sample(range(len(texts)), len(texts))
    covered = covered_words(passages.repeated_passages(docs(spark, [texts[i] for i in order])).collect())
    assert [i for k, i in enumerate(order) if not need[i] <= covered[k]] == []


def test_near_passages_lose_no_pair(spark):
    """Each two of 24 texts with similar windows have a row, or 45 words in common and a way through rows."""
    rng = random.Random(33)
    base, texts = words(rng, 62).split(" "), []
    for k in range(24):
        own, at = list(base), (24, 29, 34)[k % 3]
        if k % 8:  # others have the whole passage
            own[at : at + (k % 7 != 0)] = [f"own{k}"] * (k % 5 != 0)
        texts.append(" ".join([words(rng, 9 + k % 4), *own, words(rng, 8)]))
    split = [t.split(" ") for t in texts]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    windows = [[frozenset(grams(w[i : i + 50], 5)) for i in range(len(w) - 49)] for w in split]
    alike = [(i, j) for i, j in itertools.combinations(range(24), 2) if any(5 * len(a & b) >= 4 * len(a | b) for a in windows[i] for b in windows[j])]
    got = passages.repeated_passages(docs(spark, texts)).collect()
    rows = {(r.ref_doc_id, r.doc_id) for r in got}
    near = [p for p in alike if not set(grams(split[p[0]], 45)) & set(grams(split[p[1]], 45))]
    assert len(near) > 40 and set(near) <= rows
    label = plain_components(24, rows)
    assert all(label[i] == label[j] for i, j in alike)
    for r in got:
        a, b = set(grams(split[r.doc_id][r.start_word : r.end_word], 5)), set(grams(split[r.ref_doc_id][r.ref_start : r.ref_end], 5))
        assert len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.end_word - r.start_word >= 50


def test_passage_classes(spark, empty):
    """Rows of the first documents and of copies too, as many as there are stretches; no pair's link or word is lost."""
    rng = random.Random(41)
    base, license_, texts = words(rng, 62).split(" "), words(rng, 70), [None, "", "one two", "x " * 20000]
    for k in range(40):  # variants, most of which have no run of 41 shingles in common
        own, at = list(base), 20 + k % 23
        own[at : at + 1] = [f"own{k}"] * (k % 5 != 0)
        texts.append(" ".join([words(rng, 9 + k % 4), *own, words(rng, 8)]))
    texts += [" ".join([words(rng, rng.randint(0, 60)), license_, words(rng, 70)]) for _ in range(30)]
    texts += [texts[-1].upper(), words(rng, 90)]
    df = docs(spark, texts)
    got, pairs = passages.passage_classes(df).collect(), passages.repeated_passages(df).collect()
    label = plain_components(len(texts), {(r.ref_doc_id, r.doc_id) for r in pairs})
    assert len({r.doc_id for r in got}) == len(got) > 60  # each has one stretch
    assert {r.doc_id: r.class_id for r in got} == {i: label[i] for r in pairs for i in (r.doc_id, r.ref_doc_id)}
    assert {(r.class_id, r.class_start) for r in got} == {(r.doc_id, r.start_word) for r in got if r.kept}
    mine = {r.doc_id: r for r in got}
    for r in pairs:
        for i, lo, hi in ((r.doc_id, r.start_word, r.end_word), (r.ref_doc_id, r.ref_start, r.ref_end)):
            assert mine[i].start_word <= lo and hi <= mine[i].end_word
    assert len(pairs) > 2 * len(got) and passages.passage_classes(empty).count() == 0


def around_words(texts, at):
    """(halves of the shingle hashes of each text, those around its position `at` as shared_reach() takes them)."""
    halves = [(h >> np.uint64(32)).astype(np.uint32) for _, _, h in passages.sequences(pa.array(texts), 5)]
    rows = np.zeros((len(texts), 2 * passages.AROUND + 1), np.uint32)
    for row, h, p in zip(rows, halves, at):
        lo, hi = max(0, p - passages.AROUND), min(len(h), p + passages.AROUND + 1)
        row[lo - p + passages.AROUND : hi - p + passages.AROUND] = h[lo:hi]
    return halves, rows


def edited_texts(n):
    """Texts with 64 words in common but for one or two that are changed, put in or left out, around their shingle `at`."""
    rng = random.Random(42)
    base, texts, at = words(rng, 64).split(" "), [], []
    for k in range(n):
        left, right = base[:30], base[36:]
        for own in rng.sample([left, right], 1 + k % 2):
            i = rng.randrange(len(own))
            own[i : i + rng.randint(0, 1)] = [f"own{k}x{i}"] * rng.randint(0, 1)
        before = 9 + k % 4
        texts.append(" ".join([words(rng, before), *left, *base[30:36], *right, words(rng, 12)]))
        at.append(before + len(left))
    return texts, np.array(at)


def test_reach_that_is_sure_is_reported():
    texts, at = edited_texts(40)
    halves, rows = around_words(texts, at)
    x, y = np.array(list(itertools.combinations(range(40), 2))).T
    reach, got, sure = passages.shared_reach(rows[x], rows[y], 41, 5, 46)
    assert sure.sum() > 100 and not (sure & ~got).any()
    for i, j, r, can, is_sure in zip(x, y, reach.tolist(), got, sure):
        found = passages.common_passages(halves[i], halves[j], np.array([at[i] - at[j]]), 46, 4, 5)
        assert can or not found
        if is_sure:  # on each side, what is reported around the position, as a stretch
            assert min(f[0] for f in found) <= at[i] - r[0] and max(f[1] for f in found) > at[i] + r[1]
            assert min(f[2] for f in found) <= at[j] - r[2] and max(f[3] for f in found) > at[j] + r[3]


def test_open_pairs_grow_with_the_entries():
    """Of each two of n entries with similar windows only as many are compared as their stretches need, and these do."""
    n = 120
    texts, at = edited_texts(n)
    _halves, rows = around_words(texts, at)
    x, y = np.array(list(itertools.combinations(range(n), 2))).T
    reach, got, sure = passages.shared_reach(rows[x], rows[y], 41, 5, 46)
    x, y, reach, sure = x[got], y[got], reach[got], sure[got]
    out = passages.missing(x, y, reach, sure, at, at, at, np.arange(n))
    assert sure.sum() > 15 * n > 5 * out[sure].sum()
    lo, hi = at.copy(), at.copy()
    for e, k in ((x[out], 0), (y[out], 2)):
        np.minimum.at(lo, e, at[e] - reach[out, k])
        np.maximum.at(hi, e, at[e] + reach[out, k + 1] + 1)
    label = plain_components(n, list(zip(x[out].tolist(), y[out].tolist())))
    assert all(c.all() for c in passages.covered(x, y, reach, at, lo, hi))
    assert all(label[i] == label[j] for i, j in zip(x.tolist(), y.tolist()))


def test_passages_of_two_texts_under_one_id(spark):
    """Two texts of one id aren't compared, and no other pair is left out for them."""
    texts, _at = edited_texts(40)
    rows = [(k // 2, f"{'own ' * (20 * (k % 2))}{t}") for k, t in enumerate(texts)]
    got = passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = passages.passage_classes(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id // 2, r.start_word, r.end_word) for r in alone) == sorted((r.doc_id, r.start_word, r.end_word) for r in got)


def plain_components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def brute_components(sets, ids):
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(sets))}


@pytest.mark.parametrize("small", [2, 32])
def test_jaccard(spark, empty, small):
    rng = random.Random(4)
    texts = [None, "", " \t", "one", "ONE", "one two", "one two three four five", "É a b c d", "é a b c d"]
    for n in (6, 7, 9, 12, 20, 40, 90, 300):
        base = words(rng, n).split(" ")
        for _ in range(14):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                edited[rng.randrange(len(edited))] = words(rng, 1)
            texts.append(" ".join(edited[: len(edited) - rng.randint(0, n // 8)]))
    texts += ["boiler plate text " * 3 + words(rng, 12) for _ in range(50)]
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    want = brute_components(sets, range(len(texts)))
    got = jaccard.jaccard_components(docs(spark, texts), small=small).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in want} | {None: (2, None)}
    if small == 2:
        assert jaccard.jaccard_components(empty).count() == 0


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        x, y = (np.frombuffer(jaccard.parity_sketch(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_shingle_hashes_know_words():
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "B", "é", "ab", "ba", "x" * 40], k=rng.randint(0, 12))) + rng.choice(["", "\t", "\n a"]) for _ in range(60)]
    hashes, at = shingles.word_hashes([t.encode() for t in texts])
    names = {}
    for i, t in enumerate(texts):
        found = WORD.findall(t.translate(FOLD))
        assert len(found) == at[i + 1] - at[i]
        for w, h in zip(found, hashes[at[i] : at[i + 1]]):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


@pytest.fixture(scope="module")
def tokenizer_files():
    return pytest.importorskip("public_tokenizers")


def test_bpe(spark, empty, tokenizer_files):
    path = tokenizer_files.path("byte_bpe_50k.json")
    tok = bpe.tokenizer(path)
    texts = [None, "", "plain text", "a" * 9000, "the" * 4000 + " <|endoftext|> é" + " " * 5000 + "x", "ＡＢ 漢字   \x85", "0123456789" * 900, "=-" * 5000, "'s 're é\n\n  b"]
    got = bpe.bpe(docs(spark, texts), path, tokenizer_files.PATTERN, leaf=64).collect()
    assert len(got) == len(texts) + 2 and bpe.bpe(empty, path, tokenizer_files.PATTERN).count() == 0
    for r in got:
        want = tok.encode(text_of(texts, r.doc_id), add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (want, tok.decode(want, skip_special_tokens=False))
    for r in bpe.bpe(docs(spark, texts), path, "", digests=True).collect():
        want = tok.encode(text_of(texts, r.doc_id), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


def test_both_engines_split_shared_characters_alike(tokenizer_files):
    path = tokenizer_files.path("byte_bpe_50k.json")
    tok, quick = bpe.tokenizer(path), bpe.fast(path, tokenizer_files.PATTERN)[0]
    for c in map(chr, range(0x250)):
        for s in (c, f"a{c}a", f" {c}", c + c, f"1{c}1", f"a {c} b", f"!{c}!", f"'{c}", f" {c}{c} ", f"{c}\n a"):
            assert quick._core_bpe.encode_ordinary(s) == tok.encode(s, add_special_tokens=False).ids, repr(s)


def test_tree_concatenation(tokenizer_files):
    path, rng = tokenizer_files.path("byte_bpe_50k.json"), random.Random(7)
    tok = bpe.tokenizer(path)
    alphabets = ["ab", "aeiounth", "0123456789", "=-", "é漢", "  \n\t", " a", "'stll re'", "\u3000 \x85x", "a b1  c!"]
    for _ in range(600):
        s = "".join(rng.choice(rng.choice(alphabets)) * rng.choice([1, 1, 3]) for _ in range(rng.randint(1, 300)))
        if rng.random() < 0.2:
            s = s[:40] + "<|endoftext|>" + s[40:]
        rows = [(i, n, None if x is None else bpe.encoded(x, path)) for i, n, x in bpe.pieces(s, path, rng.choice([1, 2, 5, 16, 50]))]
        assert bpe.assembled(rows, path) == tok.encode(s, add_special_tokens=False).ids, s


def test_quality(spark, empty):
    rng = random.Random(8)
    texts, marks = [None, ""], []
    for i in range(2, 302):
        good = rng.random() < 0.7
        text = ". ".join(words(rng, 12).capitalize() for _ in range(6)) if good else rng.choice([" ".join(w + "$$$" for w in words(rng, 40).split()), "SPAM NOW " * 30])
        texts.append(text)
        marks.append((i, int(good), 0))
    df, labels = docs(spark, texts), spark.createDataFrame([*marks, (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_report(df, labels, pairs=2000).collect()}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y, _ in marks if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    # held-out labels change nothing
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality_report(df, flipped, pairs=2000).collect()} == {i: r.score for i, r in got.items()}
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(df, labels.where("quality = 1")).first().score == 1.0
    kept = quality.good_documents(df, labels, pairs=2000)
    assert kept.columns == df.columns and sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(i) for r in quality.quality_report(df, labels, pairs=2000).where("predicted = 1").collect() for i in [r.doc_id])
    # a label that contradicts another: the larger counts
    assert {r.doc_id: r.score for r in quality.quality_report(df, labels.union(labels.withColumn("quality", F.lit(0))), pairs=2000).collect()} == {i: r.score for i, r in got.items()}


def test_features_by_brute_force():
    rng = random.Random(81)
    texts = [None, "", " \n", "Ab ab, é!", *(words(rng, rng.randint(1, 40)) + rng.choice(["", "\n x", "$$ é"]) for _ in range(20)), "ab", "z" * 5000]
    x = quality.features(texts)
    assert x.shape == (len(texts), quality.WIDTH) and (x[0] == 0).all() and (x[2, : quality.WIDTH - quality.GRAMS] == 0).all()
    first = len(quality.FEATURES) + 9
    for t, row in zip(texts, x):
        b = (t or "").encode()
        grams = collections.Counter((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1) % (1 << 32)) >> 25 for i in range(len(b) - 2))
        want = np.array([grams[k] for k in range(quality.GRAMS)], float)
        assert np.allclose(row[first + quality.WORDS :], np.sqrt(want / max(1, want.sum())))
        n = collections.Counter(w.translate(FOLD) for w in WORD.findall(t or ""))
        assert np.isclose((row[first : first + quality.WORDS] ** 2).sum(), 1 if n else 0)
    assert np.array_equal(quality.features(["one TWO", "x"])[0], quality.features(["one TWO"])[0])


def test_ranking_by_brute_force():
    """The weights are where the loss over the drawn pairs, added up pair by pair, is least."""
    rng = np.random.default_rng(82)
    x, true = rng.standard_normal((60, 3)), np.array([2.0, -1.0, 0.0])
    y = (x @ true + rng.standard_normal(60) > 0).astype(int)
    w = quality.bradley_terry(x, y, 500, 4, decay=0.01)
    draw = np.random.default_rng(4)
    good, poor = draw.choice(np.flatnonzero(y == 1), 500), draw.choice(np.flatnonzero(y == 0), 500)

    def loss(w):
        return sum(np.log1p(np.exp(-(x[i] - x[j]) @ w)) for i, j in zip(good, poor)) / 500 + 0.005 * w @ w

    assert all(loss(w) <= loss(w + step) for step in rng.standard_normal((40, 3)) * 0.05)
    assert w[0] > 0.5 and w[1] < -0.2 and abs(w[2]) < 0.5


def test_the_threshold_is_a_quantile_of_all_labelled_rows(spark):
    rows = [(i, float(i % 100)) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 100 >= 30)) for i, _ in rows] + [(7, 0), (None, 1)], "doc_id bigint, quality int")
    at, spread = quality.threshold(spark.createDataFrame(rows, "doc_id bigint, s double"), labels, {"flat": None}, "doc_id", "s")
    used = [(s, i % 100 >= 30) for i, s in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    low = sorted(s for s, _ in used)[sum(not y for _, y in used) - 1]
    assert abs(at - low) <= 1 and spread == pytest.approx(np.std([s for s, _ in used]), rel=1e-6)


def test_mixing_targets():
    t = mixing.targets([1000, 10, 500, 0], [5, 2, 1, 5], 1.5, 2)
    assert abs(sum(t) - 2265) < 1e-6 and t[1] == 20 and t[3] == 0 and all(x <= 2 * s for x, s in zip(t, [1000, 10, 500, 0]))
    assert mixing.targets([], [], 1.5, 2) == []
    # by hand: 150 of 100 words; a takes 5/8, above twice its 20 words; the rest, 110, is b's by 2 and c's by 1
    assert mixing.targets([20, 60, 20], [5, 2, 1], 1.5, 2) == pytest.approx([40, 220 / 3, 110 / 3])


def test_slots():
    assert [mixing.slots_for(s, t, 64, 2) for s, t in ((10, 20, ), (70, 140), (70, 70), (0, 0), (640, 100), (640, 1), (6400, 9600))] == [2, 4, 2, 0, 2, 1, 150]


def test_shard_counts_are_multinomial():
    """Sums are exact, any shard can be worked out alone, and means and variances are those of a multinomial draw."""
    slots, shards = [40_000, 7, 0, 1 << 40], 37
    known: dict = {}
    all_ = [mixing.shard_counts(slots, shards, k, 3, known) for k in range(shards)]
    assert (sum(c for _, c in all_) == slots).all()
    assert all((f == sum((c for _, c in all_[:k]), np.zeros(4, np.int64))).all() for k, (f, _) in enumerate(all_))
    assert all((mixing.shard_counts(slots, shards, k, 3, {})[1] == all_[k][1]).all() for k in (0, 17, 36))
    drawn = np.array([[mixing.shard_counts([400], 8, k, seed, {})[1][0] for k in range(8)] for seed in range(400)])
    assert abs(drawn.mean() - 50) < 1e-9 and abs(drawn.var(0).mean() - 400 / 8 * 7 / 8) < 3
    both = np.corrcoef(drawn[:, 0], drawn[:, 5])[0, 1]
    assert abs(both + 1 / 7) < 0.12


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_scattered_is_a_permutation(n):
    got = mixing.scattered(np.arange(n), n, 5)
    assert sorted(got.tolist()) == list(range(n))
    if n >= 1000:
        assert (got != mixing.scattered(np.arange(n), n, 6)).mean() > 0.9 and abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.1


def test_scattered_beyond_32_bits():
    n = (1 << 41) + 12345
    i = np.r_[np.arange(20_000), np.arange(n - 20_000, n), (np.arange(20_000) * 109_951_163) % n]
    i = np.unique(i)
    got = mixing.scattered(i, n, 9)
    assert len(np.unique(got)) == len(i) and got.min() >= 0 and got.max() < n and got.max() > n // 2


def test_mixing(spark, empty):
    rng = random.Random(9)
    texts = [None, "", *[words(rng, rng.choice([1, 30, 400])) for _ in range(200)], words(rng, 9000)]
    sources = [rng.choice(["b", "é", "a", None, "a", "a"]) for _ in texts]
    df = docs(spark, texts, sources)
    source = lambda i: sources[i or 0]
    got = mixing.mixed_report(df, block=16, shard_slots=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_report(df, block=16, shard_slots=64).collect())) and len(got) == len(texts) + 2
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = source(r.doc_id)
        assert r.size == len(WORD.findall(text_of(texts, r.doc_id))) and r.taken <= 2 * r.size and (r.taken > 0) == bool(r.shards)
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    assert len({x for r in got for x in (r.shards or "").split(",")}) > 10
    order = sorted(size, key=lambda s: (s is None, s or ""))
    left, open_, want = 1.5 * sum(size.values()), dict(zip(order, (5, 2, 1, 5))), {}
    while over := {s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * size[s]}:
        for s in over:
            want[s] = 2 * size[s]
            del open_[s]
        left = 1.5 * sum(size.values()) - sum(want.values())
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 16
    mixed = mixing.mixed_documents(df, block=16, shard_slots=64)
    assert mixed.columns == df.columns
    per = collections.Counter()
    for r in mixed.collect():
        per[r.doc_id] += len(WORD.findall(r.text))
        have = collections.Counter(WORD.findall(text_of(texts, r.doc_id)))
        assert not collections.Counter(WORD.findall(r.text)) - have and r.n_chars == len(r.text) and r._posetta_score == 0.5
    both = collections.Counter()
    for r in got:
        both[r.doc_id] += r.taken
    assert per == +both
    assert mixing.mixed_report(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_a_tiny_source_stays_in_the_mix(spark):
    rows = [(i, words(random.Random(i), 300), "big") for i in range(20)] + [(100, "a b c", "tiny"), (101, "d e", "wee"), (None, "f", None)]
    got = {r.doc_id: r for r in mixing.mixed_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert (got[100].taken, got[101].taken, got[None].taken) == (6, 4, 2)


@pytest.mark.parametrize("part_rows", [8, 2000])
def test_vectors(spark, part_rows):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((40, 16))
    rows = [base[k % 40] + rng.standard_normal(16) * 0.08 * (k % 3) for k in range(200)] + [base[0]] * 30 + [base[1] * 5]
    rows = [list(map(float, r)) for r in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, None], [1.0] * 3]
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>, label int")
    x = np.zeros((len(rows), 16))
    for i, r in enumerate(rows[:231]):
        x[i] = np.array(r, np.float32)
    norm = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / np.maximum(np.outer(norm, norm), 1e-300) >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in vectors.near_vectors(df, part_rows=part_rows).collect()}
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and all(r.n_links <= near[i].sum() for i, r in got.items()) and found >= 0.97 * near.sum()
    assert all(r.kept == (i == r.component_id) and r.component_id <= i for i, r in got.items())
    assert all(got[i].n_links == 0 and got[i].kept for i in range(231, len(rows)))
    assert vectors.near_vectors(df.where("false")).count() == 0
    assert len({got[i].component_id for i in range(200, 230)}) == 1


def test_spans_count_code_points(spark):
    df = spark.createDataFrame([("é𝄞ab xab", ), ("",), ("none",)], "t string").select(spans.matches("t", "ab", 0).alias("m"))
    assert [[(s.start, s.end) for s in r.m] for r in df.collect()] == [[(2, 4), (6, 8)], [], []]


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before, df = df, stage(spark, df, sf).cache()
        assert df.count() > 0
        if k < 4:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        old = before.toPandas()
        if name == "exact_dedup":
            keys = old.text.fillna("").map(lambda t: t.translate(FOLD))
            assert sorted(df.toPandas().doc_id) == sorted(old.groupby(keys).doc_id.max())
        if name == "near_dedup":
            kept = jaccard.jaccard_components(before).where("doc_id = component_id").toPandas()
            assert sorted(df.toPandas().doc_id) == sorted(kept.doc_id)
    assert sorted(pipeline.run(spark, sf).collect()) == sorted(df.collect())


def test_pipeline_stages_on_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf, schema = "/root/testdata/sf0.001", "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(None, "some plain words here", None, None, None), (900001, None, "en", "s", None), (900002, "", "en", None, 0), (900003, "Same words in one text.", "en", "s", 23), (900003, "Same words in one text.", "en", "s", 23), (900004, "same words IN one text.", "en", "s", 23)]
    for rows in ([], odd):
        df = spark.createDataFrame(rows, schema)
        for k, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, df, sf).collect()
            assert not rows or name == "bpe" or {r.text for r in out} <= {r[1] for r in rows} | {"some plain words here"}
            if name == "quality" and rows:
                alike = {t: sum(r.text == t for r in out) for t in ("Same words in one text.", None)}
                assert alike["Same words in one text."] in (0, 2)
            if name == "mixing" and rows:
                assert all(r.text for r in out) and max(collections.Counter(r.doc_id for r in out).values()) <= 4
            if name == "bpe" and rows:
                assert [(r.n_tokens, len(r.ids)) for r in out if r.doc_id == 900001] == [(0, 0)] and len(out) == len(rows)
            if name == "exact_dedup" and rows:
                assert [r.doc_id for r in out if r.text and r.text.lower().startswith("same")] == [900004] and len(out) == 3
            if name == "near_dedup" and rows:
                assert {r.doc_id for r in out} == {None, 900001, 900002, 900003}


def test_pipeline_hands_python_few_rows_at_once(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    name, schema = "spark.sql.execution.arrow.maxRecordsPerBatch", "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs, before = spark.createDataFrame([], schema), spark.conf.get(name)
    sizes = lambda batches: (b.select(["id"]) for b in batches if b.num_rows > 1024)
    try:
        for stage in (f for k, f in pipeline.STAGES if k != "exact_dedup"):
            spark.conf.set(name, "10000")
            stage(spark, docs, "/root/testdata/sf0.001")
            assert spark.range(0, 5000, 1, 1).mapInArrow(sizes, "id bigint").count() == 0
        spark.conf.set(name, "100")
        pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)


def test_released_gives_memory_back(spark):
    from posetta.llm.words import released

    def much(batches):
        kept = None
        for b in batches:
            parts = [bytearray(b"x" * 100_000) for _ in range(2000)]  # from the heap, as they're small, with a last one on top
            kept = bytearray(b"y" * 100_000)
            del parts
            yield b
        held.append(kept)

    held: list = []

    def resident(batches):
        yield from batches
        with open("/proc/self/statm") as f:
            assert int(f.read().split()[1]) * 4096 < 200e6

    both = lambda batches: resident(released(much)(batches))
    assert spark.range(0, 10, 1, 1).mapInArrow(both, "id bigint").count() == 10
