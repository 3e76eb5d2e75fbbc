"""BPE encoding and decoding by tree concatenation (operator 5).

Texts are encoded as the tokenizers library does. A long text is cut into halves, again and again, down to
leaves, which are encoded in parallel as texts of their own; then the halves are put together up the tree.
Around each join a window of the last pretokens on the left and the first on the right is split anew, and it
grows until its first and its last pretoken are those that stand there already. Splitting goes from left to
right and looks one character ahead, so that nothing outside such a window can change. A pretoken that the
cut went through is put together from its halves' ids in the same way: in byte pair encoding, ids are the
encoding of their text if and only if each two neighbours are, so a window of ids around the join is encoded
anew until its first and its last are those that stand there."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetta.llm.words import released
from posetta.plans.session import stored

#: Characters of a leaf; texts with more are cut. Long enough that most texts stay whole, short enough that the parts of a
#: very long one keep many tasks busy.
LEAF = 1 << 15
#: Up to here, letters, numbers and white space are the same to both libraries' pattern engines (tested
#: character by character), so that the faster one may split.
SHARED = re.compile(r"[^\x00-ɏ]")
_LOADED: dict = {}


def tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def fast(path: str, pattern: str):
    """The same vocabulary in the faster library, or None if the file isn't plain byte-level BPE."""
    key = (path, pattern)
    if key not in _LOADED:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        plain = j["normalizer"] is None and j["pre_tokenizer"]["type"] == "ByteLevel" and not j["pre_tokenizer"]["add_prefix_space"] and j["pre_tokenizer"].get("use_regex", True) and j["model"]["type"] == "BPE" and not any(j["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        encoding = None
        if plain and pattern:
            byte = {c: b for b, c in byte_chars().items()}
            special = {a["content"]: a["id"] for a in j["added_tokens"]}
            ranks = {bytes(byte[c] for c in tok): i for tok, i in j["model"]["vocab"].items() if tok not in special}
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
            ids = [j["model"]["vocab"][a + b] for a, b in merges]
            if ids == sorted(ids):  # ranks are ids only if merges make ids in order
                encoding = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), re.compile("|".join(map(re.escape, special))) if special else None)
        _LOADED[key] = encoding
    return _LOADED[key]


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def encode_texts(texts: list[str], path: str, pattern: str) -> list[list[int]]:
    """Ids of each text; special tokens in a text are taken for such, none is added."""
    t, quick = tokenizer(path), fast(path, pattern)
    out: list = [None] * len(texts)
    slow = []
    for i, x in enumerate(texts):
        if quick is None or SHARED.search(x) or (quick[1] and quick[1].search(x)):
            slow.append(i)
        else:
            out[i] = quick[0]._core_bpe.encode_ordinary(x)
    for i, e in zip(slow, t.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
        out[i] = e.ids
    return out


def decode_ids(ids: list[list[int]], path: str) -> list[str]:
    return tokenizer(path).decode_batch(ids, skip_special_tokens=False)


@dataclass
class Part:
    """A text with its pretokens, by their lengths and numbers of ids, and its ids, all as those of a text of its own."""

    text: str
    lengths: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


def pieces(text: str, path: str, leaf: int = LEAF) -> list[tuple[int | None, int, str | None]]:
    """The text in order, as (special id, number of the stretch, leaf): special tokens, and the leaves of the
    stretches between them."""
    special = {v.content: k for k, v in tokenizer(path).get_added_tokens_decoder().items()}
    parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
    out: list = []
    for n, part in enumerate(parts):
        out += [(special[part], n, None)] if part in special else [(None, n, x) for x in halves(part, leaf)] if part else []
    return out


def halves(text: str, leaf: int) -> list[str]:
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def encoded(text: str, path: str) -> Part:
    """A leaf, without special tokens."""
    t = tokenizer(path)
    e = t.encode(text, add_special_tokens=False)
    lengths = np.array([hi - lo for _, (lo, hi) in t.pre_tokenizer.pre_tokenize_str(text)], np.int32)
    return Part(text, lengths, np.bincount(np.array(e.word_ids, np.int64), minlength=len(lengths)).astype(np.int32), np.array(e.ids, np.int32))


def put_together(left: Part, right: Part, path: str) -> Part:
    """Both texts as one."""
    t, k = tokenizer(path), 2
    while True:
        a, b = min(k, len(left.lengths)), min(k, len(right.lengths))
        from_left, from_right = int(left.lengths[-a:].sum()), int(right.lengths[:b].sum())
        found = t.pre_tokenizer.pre_tokenize_str(left.text[len(left.text) - from_left :] + right.text[:from_right])
        stays = from_left + from_right - int(right.lengths[b - 1])
        if (a == len(left.lengths) or found[0][1][1] == left.lengths[-a]) and (b == len(right.lengths) or found[-1][1][0] == stays):
            break
        k *= 2
    before, after = int(left.counts[-a:].sum()), int(right.counts[:b].sum())
    cut = from_left - int(left.lengths[-1]), from_left + int(right.lengths[0])
    new = []
    for token, span in found:
        if span == cut:  # the cut went through it
            new.append(concatenated(left.ids[-int(left.counts[-1]) :].tolist(), right.ids[: int(right.counts[0])].tolist(), path))
        else:
            new.append([x.id for x in t.model.tokenize(token)])
    return Part(
        left.text + right.text,
        np.concatenate([left.lengths[: len(left.lengths) - a], np.array([hi - lo for _, (lo, hi) in found], np.int32), right.lengths[b:]]),
        np.concatenate([left.counts[: len(left.counts) - a], np.array([len(x) for x in new], np.int32), right.counts[b:]]),
        np.concatenate([left.ids[: len(left.ids) - before], np.array([i for x in new for i in x], np.int32), right.ids[after:]]),
    )


def concatenated(left: list[int], right: list[int], path: str) -> list[int]:
    """Ids of the text of left and right together, both being the encodings of their texts."""
    t, k = tokenizer(path), 2
    while True:
        a, b = left[-k:], right[:k]
        window = [x.id for x in t.model.tokenize("".join(map(t.id_to_token, a + b)))]
        if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def tree(parts: list[Part], path: str) -> Part:
    """Neighbours are put together two by two, level by level."""
    while len(parts) > 1:
        parts = [put_together(parts[i], parts[i + 1], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def assembled(rows: list[tuple[int | None, int, Part | None]], path: str) -> list[int]:
    """Ids of a text from its pieces in order: (special id, number of the stretch, leaf)."""
    out: list[int] = []
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j][1] == rows[i][1]:
            j += 1
        out += [rows[i][0]] if rows[i][0] is not None else tree([r[2] for r in rows[i:j]], path).ids.tolist()
        i = j
    return out


def bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, ids_too: bool = False, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id, ids (array), decoded; or, with digests, id, n_tokens, ids_sha256 and
    decoded_sha256, and with ids_too also ids.

    path is the tokenizer's file, which every executor must have; pattern is its split pattern in the
    faster library's syntax, or empty to do without that. A null text counts as empty and has no ids;
    repeated rows and null ids each get their row; an empty table gives no rows; only the two named columns
    are read. Texts of up to `leaf` characters stay in one task and aren't shuffled; the leaves of the others
    are dealt to all tasks and come together by text."""
    strings = f"{id_col} {dict(docs.dtypes)[id_col]}, "
    schema = strings + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids_too if digests else "ids array<int>, decoded string")
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), t.alias("_t"), (F.char_length(t) > leaf).alias("_long"))

    def finished(keys: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
        decoded = decode_ids(ids, path)
        if not digests:
            return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])
        name = [str(i) for i in range(tokenizer(path).get_vocab_size())]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        texts = [",".join([name[i] for i in x]) for x in ids]
        out = [keys, pa.array([len(x) for x in ids], pa.int64()), pa.array(map(sha, texts), pa.string()), pa.array(map(sha, decoded), pa.string())]
        return pa.RecordBatch.from_arrays([*out, *[pa.array(ids, pa.list_(pa.int32()))] * ids_too], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids_too])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield finished(part.column(0), encode_texts(part.column(1).to_pylist(), path, pattern))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                got = pieces(one.column(1)[0].as_py(), path, leaf)
                key = os.urandom(12).hex()  # rows with the same id stay apart
                n = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array(range(n), pa.int64()), pa.concat_arrays([one.column(0)] * n), pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.string())], ["key", "seq", id_col, "special", "no", "leaf"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                made = [None if x is None else encoded(x, path) for x in b.column(5).to_pylist()]
                blobs = [pa.array([None if m is None else getattr(m, f).tobytes() for m in made], pa.binary()) for f in ("lengths", "counts", "ids")]
                yield pa.RecordBatch.from_arrays([*b.columns, *blobs], [*b.schema.names, "lengths", "counts", "ids"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        made = [None if x is None else Part(x, *(np.frombuffer(y, np.int32) for y in more)) for x, *more in zip(*(group[c].to_pylist() for c in ("leaf", "lengths", "counts", "ids")))]
        parts = list(zip(group["special"].to_pylist(), group["no"].to_pylist(), made))
        return pa.Table.from_batches([finished(group[id_col].combine_chunks().slice(0, 1), [assembled(parts, path)])])

    short = rows.where("not _long").select(id_col, "_t").mapInArrow(released(whole), schema)
    shape = f"key string, seq bigint, {strings} special int, no bigint, leaf string"
    parts = rows.where("_long").select(id_col, "_t").mapInArrow(released(cut), shape)
    # keys are drawn anew if a task runs again, so the pieces are written first
    parts = stored(parts, "pieces").repartition("key", "seq").mapInArrow(released(leaves), f"{shape}, lengths binary, counts binary, ids binary")
    return short.union(parts.groupBy("key").applyInArrow(join, schema))
