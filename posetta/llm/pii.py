"""Personal data by weak supervision (operator 10), DataFrame functions only.

Labelers vote on candidate spans; expectation-maximisation over the votes of the whole table estimates, for
each kind, how far each labeler can be relied on; and a logistic classifier of spans is trained on what
follows. It sees a span's shape, its length and the words around it beside the votes, so that it can tell
apart spans on which the votes are the same."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetta.llm.spans import SPAN, apart, bare, joined, matches, of_kind
from posetta.plans.session import stored

#: The first four are base kinds.
KINDS = ["email", "ip", "card", "phone", "hidden_email", "national_phone", "ssn", "iban"]
#: Leftmost matches begin where a run begins or where the last match ended, so a long run is read once; what
#: can't be given back is possessive, so no group recurses.
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z]{2,})++",
    r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
]
#: Gazetteers: top-level domains (countries have two letters), first digits of card issuers, calling codes, country codes of account numbers.
GAZETTEER = [
    r"(?i)\.(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|museum|coop|aero|jobs|mobi|travel|asia|cat|post|app|dev|online|site|shop|store|blog|cloud|tech|xyz)$",
    r"^(?!0\.)(?!127\.)(?!255\.)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    r"^\+(?:1|7|2[07]|3[0-69]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    r"(?i)(?:[^a-z][a-z]{2}|com|org|net|edu|gov|mil|info|biz|name|pro|app|dev|online|site|shop|blog|cloud|tech)$",
    r"^\(?[2-9][0-8][0-9]",
    r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
]
#: Words just before a span that speak for its kind.
CONTEXT = [
    r"(?i)mail|contact|write to|kontakt|correo|courriel",
    r"(?i)\bip\b|address|host|server|login",
    r"(?i)card|visa|master|karte|carte|tarjeta|payment",
    r"(?i)\btel|phone|call|fax|mobil|telefon|tél",
    r"(?i)mail|contact|write to|kontakt|correo|courriel",
    r"(?i)\btel|phone|call|fax|mobil|telefon|tél",
    r"(?i)\bssn\b|social security",
    r"(?i)\biban\b|account|konto|compte|cuenta",
]
#: Words just before a span that speak against personal data of any kind.
AGAINST = r"(?i)version|isbn|issn|\bdoi\b|\brev\b|section|chapter|figure|order|\bpage\b|part no|serial"
LABELERS = ["form", "check", "gazetteer", "context"]
#: Characters looked at on either side of a span.
AROUND = 40
#: The classifier's features beside kind and votes, and how many hashed values each has; those that are taken by kind.
FEATURES = {"shape": 32, "length": 8, "last": 64, "second": 64, "next": 64}
BY_KIND = ["shape", "length"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    back = F.reverse(number)
    d = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    two = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, two(d(i))).otherwise(d(i))) % 10 == 0


def passes(s: Column, kind: int) -> Column:
    """The rule of a base kind on a match."""
    n = F.char_length(digits(s["hit"]))
    if kind == 1:
        return F.forall(F.split(s["hit"], r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == 2:
        return F.when(n.between(12, 19), luhn(digits(s["hit"]))).otherwise(False)
    return n.between(9, 15) if kind == 3 else F.lit(True)


def passing(kind: int) -> Callable[[Column], Column]:
    return lambda s: passes(s, kind)


def account_sum(number: Column) -> Column:
    """Whether an account number without blanks leaves 1 when divided by 97, its first four characters moved
    to its end and its letters taken for 10 to 35."""
    moved = F.concat(F.substr(number, F.lit(5)), F.left(number, F.lit(4)))
    add = lambda r, c: F.when(c < 58, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97)
    return F.aggregate(F.transform(F.split(moved, ""), lambda c: F.ascii(c)), F.lit(0), add) == 1


def vote(s: Column) -> list[Column]:
    """What the labelers say of a candidate: 1 for, -1 against, 0 nothing."""
    by_kind = lambda cols: F.element_at(F.array(*cols), s["kind"] + 1)
    sign = lambda c: F.when(c, 1).otherwise(-1)
    n = F.char_length(digits(s["hit"]))
    plain = F.regexp_replace(s["hit"], r"\x20", "")
    form = by_kind([F.lit(1), F.lit(1), sign(n.between(12, 19)), sign(n.between(9, 15)), F.lit(1), F.lit(1), F.lit(1), sign(F.char_length(s["hit"]).between(15, 42))])
    check = F.when(s["kind"].isin(0, 4), 0).when(s["kind"] == 7, sign(account_sum(plain))).otherwise(by_kind([F.lit(0), sign(passes(s, 1)), sign(passes(s, 2)), sign(passes(s, 3)), F.lit(0), sign(n == 10), sign(n == 9), F.lit(0)]))
    known = F.when(by_kind([s["hit"].rlike(p) for p in GAZETTEER]), 1).otherwise(-1)
    context = F.when(by_kind([s["before"].rlike(p) for p in CONTEXT]), 1).when(s["before"].rlike(AGAINST), -1).otherwise(0)
    return [form, check, known, context]


def seen(s: Column) -> list[Column]:
    """The values of FEATURES of a candidate: its shape (runs of digits and letters are one each), its length, the
    two words before it and the one after it, each hashed to a few numbers."""
    hashed = lambda x, name: F.pmod(F.xxhash64(x), F.lit(FEATURES[name])).cast("int")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["hit"], "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    word = lambda k: F.lower(F.regexp_extract(s["before"], r"([^\x20\x09-\x0D]+)" + r"[\x20\x09-\x0D]+[^\x20\x09-\x0D]+" * k + r"[\x20\x09-\x0D]*$", 1))
    after = F.lower(F.regexp_extract(s["after"], r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    length = F.least(F.floor(F.char_length(s["hit"]) / 5), F.lit(FEATURES["length"] - 1)).cast("int")
    return [hashed(F.left(shape, F.lit(60)), "shape"), length, hashed(word(0), "last"), hashed(word(1), "second"), hashed(after, "next")]


def posterior(votes: tuple[int, ...], prior: float, like: list[dict[int, tuple[float, float]]]) -> float:
    a, b = math.log(prior), math.log(1 - prior)
    for k, v in enumerate(votes):
        a, b = a + math.log(like[k][v][0]), b + math.log(like[k][v][1])
    return 1 / (1 + math.exp(max(-700, min(700, b - a))))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over the vote patterns of one kind and their counts: the share of true spans, and
    for each labeler and vote the chance of it given a true and given a false span. Pseudo-counts hold what
    labelers are taken for at first: right in four of five votes."""
    start = {1: (0.6, 0.15), 0: (0.25, 0.25), -1: (0.15, 0.6)}
    width, total = len(patterns[0][0]), sum(n for _, n in patterns)
    prior, like = 0.5, [dict(start) for _ in range(width)]
    for _ in range(rounds):
        post = [posterior(votes, prior, like) for votes, _ in patterns]
        true = sum(p * n for p, (_, n) in zip(post, patterns))
        prior = (true + 10) / (total + 20)
        for k in range(width):
            for v in (1, 0, -1):
                right = sum(p * n for p, (votes, n) in zip(post, patterns) if votes[k] == v)
                wrong = sum((1 - p) * n for p, (votes, n) in zip(post, patterns) if votes[k] == v)
                like[k][v] = ((right + 20 * start[v][0]) / (true + 20), (wrong + 20 * start[v][1]) / (total - true + 20))
    return prior, like


def layout(kinds: int = len(KINDS)) -> tuple[dict[str, int], int]:
    """Where the weights of each feature begin, and how many there are: kind, votes for and against by kind, and
    FEATURES, some of them by kind."""
    at, n = {"kind": 0}, kinds
    for name, size in [*((f"vote{k}", 2 * kinds) for k in range(len(LABELERS))), *((f, v * (kinds if f in BY_KIND else 1)) for f, v in FEATURES.items())]:
        at[name], n = n, n + size
    return at, n


def columns(kind: int, votes: tuple[int, ...], values: list[int]) -> list[int]:
    """Numbers of the weights that a span adds up."""
    at, _ = layout()
    out = [at["kind"] + kind] + [at[f"vote{k}"] + 2 * kind + (v < 0) for k, v in enumerate(votes) if v]
    return out + [at[f] + (kind * size if f in BY_KIND else 0) + v for (f, size), v in zip(FEATURES.items(), values)]


def classifier(rows: list[tuple[int, tuple[int, ...], list[int]]], post: list[float], weight: list[float], decay: float = 0.5, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression of spans (kind, votes, values of FEATURES) on their posteriors, by Newton's
    method; weight says how many candidates a row stands for. The posteriors follow from the votes, so each
    row is learned from twice, once without them: else what is beside the votes would teach nothing."""
    at, n = layout()
    first, last = at["vote0"], at[next(iter(FEATURES))]
    y, m, w = np.array(post), np.array(weight) / 2, np.zeros(n)
    for _ in range(rounds):
        grad, hess = decay * w, decay * np.eye(n)
        for lo in range(0, len(rows), 2048):
            x = np.zeros((len(rows[lo : lo + 2048]), n))
            for i, r in enumerate(rows[lo : lo + 2048]):
                x[i, columns(*r)] = 1
            for votes in (True, False):
                if not votes:
                    x[:, first:last] = 0
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                mine = m[lo : lo + 2048]
                grad += x.T @ (mine * (p - y[lo : lo + 2048]))
                hess += (x * (mine * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def probability(w: np.ndarray, kind: int, votes: tuple[int, ...], values: list[int]) -> float:
    return 1 / (1 + math.exp(-max(-700, min(700, float(w[columns(kind, votes, values)].sum())))))


def chance(x: Column, w: np.ndarray) -> Column:
    """probability() of a candidate (kind, votes, values) as a column."""
    at, _ = layout()
    table = lambda lo, n: F.expr("array(" + ",".join(f"{v:.9g}D" for v in w[lo : lo + n]) + ")")
    kind = x["s"]["kind"]
    total = F.get(table(0, len(KINDS)), kind)
    for k in range(len(LABELERS)):
        v = F.get(x["v"], F.lit(k))
        total = total + F.when(v == 0, F.lit(0.0)).otherwise(F.get(table(at[f"vote{k}"], 2 * len(KINDS)), 2 * kind + F.when(v < 0, 1).otherwise(0)))
    for j, (f, size) in enumerate(FEATURES.items()):
        own = f in BY_KIND
        total = total + F.get(table(at[f], size * (len(KINDS) if own else 1)), F.get(x["f"], F.lit(j)) + (kind * size if own else F.lit(0)))
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, sample: int = 1000) -> DataFrame:
    """One row per row of docs: id, base and added (arrays of spans: start, end, kind as an index of KINDS,
    hit).

    base has the matches of the four base patterns that pass their rules. All matches, failing ones and
    those of four looser kinds too, are candidates on which four labelers vote: the form, a checksum or
    range, a gazetteer, and the words before. Votes of the whole table are counted by kind and pattern (8 * 3^4
    at most, so the counts have a fixed size); expectation-maximisation over a kind's counts estimates its
    labelers. The classifier is fit to the posteriors of about `sample` candidates of each kind, those whose
    hash is smallest; only their hashed features reach the driver. It scores all. added has the candidates
    of the looser kinds that it gives at least the probability least, that some labeler beside the form
    speaks for, and that overlap no base span; base candidates that fail their rule only serve to train.

    A null text counts as empty and has no spans; repeated rows and null ids each get their row; without any
    candidate nothing is trained or added; an empty table gives no rows; only the two named columns are
    read. Work is in proportion to a text's length and its matches."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    hits = docs.select(F.col(id_col).alias("_id"), t.alias("_t")).select("_id", F.array(*[matches("_t", p, k, around=AROUND) for k, p in enumerate(PATTERNS)]).alias("_kinds"))
    good = F.array(*[F.transform(F.filter(F.get("_kinds", F.lit(k)), passing(k)) if k else F.get("_kinds", F.lit(k)), bare).cast(SPAN) for k in range(4)])
    voted = F.transform(F.flatten("_kinds"), lambda s: F.struct(bare(s).alias("s"), F.array(*[v.cast("int") for v in vote(s)]).alias("v"), F.array(*seen(s)).alias("f")))
    none = F.forall("_kinds", lambda a: F.size(a) == 0)
    candidate = f"array<struct<s:{SPAN[6:-1]},v:array<int>,f:array<int>>>"
    rows = hits.select("_id", F.when(none, F.array_repeat(F.array().cast(SPAN), 4)).otherwise(good).alias("_base"), F.when(none, F.array().cast(candidate)).otherwise(voted).cast(candidate).alias("_votes"))
    rows = stored(rows, "votes")
    each = rows.select(F.explode("_votes").alias("x")).select(F.col("x.s.kind").alias("kind"), F.col("x.v").alias("v"), F.col("x.f").alias("f"), F.pmod(F.xxhash64("x.s.hit", "x.s.start", "x.f"), F.lit(1 << 30)).alias("h"))
    counts = each.groupBy("kind", "v").count().collect()
    added = F.array().cast(SPAN)
    if counts:
        patterns: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["kind"], r["v"])):
            patterns.setdefault(r["kind"], []).append((tuple(r["v"]), float(r["count"])))
        total = {k: sum(n for _, n in p) for k, p in patterns.items()}
        learned = {k: reliabilities(p) for k, p in patterns.items()}
        few = F.expr("array(" + ",".join(str(int(min(1.0, sample / total.get(k, 1.0)) * (1 << 30))) for k in range(len(KINDS))) + ")")
        drawn = each.where(F.col("h") < F.get(few, F.col("kind"))).groupBy("kind", "v", "f").count().orderBy("kind", "v", "f").limit(2 * sample * len(KINDS)).collect()
        if drawn:
            w = classifier([(r["kind"], tuple(r["v"]), list(r["f"])) for r in drawn], [posterior(tuple(r["v"]), *learned[r["kind"]]) for r in drawn], [float(r["count"]) for r in drawn])
            likely = lambda x: (x["s"]["kind"] >= 4) & F.exists(F.slice(x["v"], 2, len(LABELERS) - 1), lambda v: v == 1) & (chance(x, w) >= least)
            found = F.transform(F.filter("_votes", likely), lambda x: x["s"])
            rows = rows.withColumn("_found", F.when(F.exists("_votes", lambda x: x["s"]["kind"] >= 4), found).otherwise(added))
            added = apart("_found", "_base")
    return rows.select(F.col("_id").alias(id_col), F.flatten("_base").alias("base"), added.alias("added"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of find_pii()."""
    base, every = F.col("base"), F.concat(F.col("base"), F.col("added"))
    return found.select(
        id_col,
        *[of_kind(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(every, KINDS).alias("spans"),
    )
