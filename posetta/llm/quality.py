"""Quality classifier by Bradley-Terry ranking (operator 7).

A text's features are shares of kinds of bytes and words, and how often hashed words and runs of three bytes
stand in it. Weights are learned from pairs of a text labelled 1 and one labelled 0; a score is how far a
text is above the quantile of labelled texts that parts those labelled 0 from the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posetta.llm.shingles import U, mixed, runs, word_hashes
from posetta.llm.words import fresh, released
from posetta.plans.session import stored

FEATURES = ["log_chars", "symbols", "bars", "upper", "digits", "marks", "blanks", "distinct", "repeats", "word_chars", "line_words", "bang"]
#: Bytes deleted to count a class.
SYMBOLS, BARS, UPPER, DIGITS, MARKS, BLANKS, BANG = b"$%&*#@^~<>={}[]\\_+", b"|", bytes(range(65, 91)), b"0123456789", b".,;:", b" \t\n\r\x0b\x0c", b"!?"
#: Least mean of a word's bytes, of a line's words: beyond these the features no longer grow.
MOST_WORD, MOST_LINE = 40.0, 200.0
#: Hashed values of words, and of runs of three bytes.
WORDS, GRAMS = 128, 128
WIDTH = len(FEATURES) + 9 + WORDS + GRAMS


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def shares(text: bytes) -> list[float]:
    """Shares of byte classes, of distinct and of repeated words, and mean lengths, of the whole text. An empty
    text, or one of blanks, has zeros, as one without any sign of quality."""
    n, words = len(text), text.split()
    if not words:
        return [0.0] * len(FEATURES)
    share = lambda cls: (n - len(text.translate(None, cls))) / n
    m = len(words)
    repeats = sum(map(bytes.__eq__, words, words[1:])) / m
    return [
        float(np.log1p(n)), share(SYMBOLS), share(BARS), share(UPPER), share(DIGITS), share(MARKS), share(BLANKS),
        len(set(words)) / m, repeats, min(MOST_WORD, n / m), min(MOST_LINE, m / (text.count(b"\n") + 1)), share(BANG),
    ]


def hashed_shares(of: np.ndarray, value: np.ndarray, n: int, width: int) -> np.ndarray:
    """(n, width): roots of the shares that each hashed value has of a text's values; of: the text of each value."""
    count = np.bincount(of * width + value, minlength=n * width).reshape(n, width)
    return np.sqrt(count / np.maximum(count.sum(1), 1)[:, None])


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, WIDTH) of whole texts, null counting as empty: shares() and the roots of nine of them, so that small
    shares count, then hashed words (A-Z as a-z) and runs of three bytes."""
    data, out = [(t or "").encode("utf-8", "replace") for t in texts], np.zeros((len(texts), WIDTH))
    for lo, hi in runs(data):
        part, n = data[lo:hi], hi - lo
        x = np.array([shares(t) for t in part]).reshape(n, -1)
        words, at = word_hashes(part)
        of = np.repeat(np.arange(n), np.diff(at))
        buf = np.frombuffer(b"".join(part) + b"\0\0", np.uint8).astype(np.uint32)
        size = np.array([len(t) for t in part])
        inside = np.arange(len(buf) - 2) < np.repeat(np.cumsum(size) - 2, size)
        gram = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (GRAMS - 1).bit_length())
        owner = np.repeat(np.arange(n), size)
        out[lo:hi] = np.hstack([x, np.sqrt(np.maximum(x[:, 1:9], 0)), np.sqrt(np.maximum(x[:, 11:], 0)), hashed_shares(of, (mixed(words) % U(WORDS)).astype(np.int64), n, WORDS), hashed_shares(owner[inside], gram[inside].astype(np.int64), n, GRAMS)])
    return out


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int, seed: int, decay: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights w for which sigmoid(w (xi - xj)) fits that i is preferred, over drawn pairs of a row labelled 1
    and one labelled 0: Newton's method on the logistic loss of feature differences."""
    rng = np.random.default_rng(seed)
    good, poor = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        grad, hess = decay * w, decay * np.eye(len(w))
        for lo in range(0, pairs, 4096):
            d = x[good[lo : lo + 4096]].astype(np.float64) - x[poor[lo : lo + 4096]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = grad - d.T @ p / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y) of the rows outside the held-out third; of labels that contradict each other, the larger counts."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    return rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000, pairs: int = 20_000, seed: int = 5) -> dict:
    """Weights from at most most_rows labelled rows outside the held-out third, those whose hashed ids are
    smallest; they're the only rows that reach the driver, as features of a fixed width.

    With no row of one label, nothing is learned, and every score is the share of 1. A document that is there
    twice counts once; of texts under one id the one whose features come first."""
    # at most most_rows ids
    rows = F.broadcast(labelled(labels, id_col, label_col).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(most_rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(rows, "_id").select("_id", "_t", "_y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_y", "_x"])

    kind = dict(texts.dtypes)["_id"]
    got = texts.mapInArrow(released(measure), f"_id {kind}, _y double, _x binary").groupBy("_id").agg(F.min(F.struct("_x", "_y")).alias("r")).select("_id", "r._x", "r._y").collect()
    got.sort(key=lambda r: r["_id"])
    y = np.array([r["_y"] for r in got])
    if not len(y) or y.min() == y.max():
        return {"w": np.zeros(WIDTH), "mean": np.zeros(WIDTH), "sd": np.ones(WIDTH), "flat": float(y.mean()) if len(y) else 0.5}
    x = np.empty((len(got), WIDTH), np.float32)  # 22 MB at most
    for i in reversed(range(len(got))):
        x[i] = np.frombuffer(got.pop()["_x"], np.float32)
    mean, sd = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    sd = np.where(sd > 1e-9, sd, 1.0)
    x -= mean
    x /= sd
    return {"w": bradley_terry(x, y, pairs, seed), "mean": mean, "sd": sd, "flat": None}


def raw_score(docs: DataFrame, model: dict, text_col: str, out: str) -> DataFrame:
    """docs with the model's score of each text, not yet set against the threshold."""
    w, mean, sd = (model[k] for k in ("w", "mean", "sd"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [(features(b.column(at).slice(lo, 512).to_pylist()) - mean) / sd @ w for lo in range(0, b.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *s]))], [*b.schema.names, out])

    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(released(apply), f"{fields}, `{out}` double")


def threshold(scores: DataFrame, labels: DataFrame, model: dict, id_col: str, out: str, label_col: str = "quality") -> tuple[float, float]:
    """(score that parts the classes, spread), from all labelled rows outside the held-out third: the score's
    quantile at the share of rows labelled 0, halfway to the next score so that a gap between the
    classes is used. The quantile's rank is right to 1 in 10,000."""
    if model["flat"] is not None:
        return 0.0, 1.0
    rows = scores.select(F.col(id_col).alias("_id"), F.col(out).alias("_s")).join(labelled(labels, id_col, label_col), "_id")
    share, spread = rows.agg(F.avg(1 - F.col("_y")), F.stddev_pop("_s")).first()
    low = rows.agg(F.percentile_approx("_s", share, 10_000)).first()[0]
    below, above = rows.agg(F.max(F.when(F.col("_s") <= low, F.col("_s"))), F.min(F.when(F.col("_s") > low, F.col("_s")))).first()
    return (low if above is None else (below + above) / 2), spread + 1e-9


def scored(s: Column, model: dict, at: float, spread: float) -> Column:
    """From 0 to 1, 0.5 at the threshold."""
    return 1 / (1 + F.exp(-4 * (s - at) / spread)) if model["flat"] is None else F.lit(model["flat"])


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. Null texts count as empty, and these score like any
    other; a text of any length is read whole; repeated rows score alike; a null id isn't held out and trains
    nothing; an empty table gives no rows; other columns aren't read."""
    model = train(docs, labels, id_col, text_col, **more)
    raw = stored(raw_score(docs.select(id_col, text_col), model, text_col, "_s").select(id_col, "_s"), "scores")
    score = scored(F.col("_s"), model, *threshold(raw, labels, model, id_col, "_s"))
    return raw.select(id_col, held_out(F.col(id_col)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs that score at least 0.5, with all their columns; see quality_report(). Texts are scored twice,
    for the threshold and then for the rows that stay, so that none is written or shuffled."""
    model, s = train(docs, labels, id_col, text_col, **more), fresh(docs, "score")
    raw = raw_score(docs.select(id_col, text_col), model, text_col, "_s").select(id_col, "_s")
    at, spread = threshold(stored(raw, "scores"), labels, model, id_col, "_s") if model["flat"] is None else (0.0, 1.0)
    return raw_score(docs, model, text_col, s).where(scored(F.col(s), model, at, spread) >= 0.5).select(*docs.columns)
