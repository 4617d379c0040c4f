"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word, hashed byte n-grams
score it, and a Viterbi path with a switching penalty labels the words; runs of
one label are spans. A text's language is that with most bytes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import extended, remainder

#: First code points of script ranges and their scripts.
SCRIPTS = ((0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "odia"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))
_NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([a for a, _ in SCRIPTS])
_KIND = np.array([_NAMES.index(s) for _, s in SCRIPTS])

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: A language is a candidate for a script from this share of its training words.
SCRIPT_SHARE = 0.005
SWITCH = 4.0
FLOOR = 6.0
#: Labelled rows that the classifier is fitted on, about.
MAX_TRAIN_ROWS = 20_000


def _words(column: pa.Array):
    data, offsets = B.raw(pc.utf8_lower(column))
    starts, ends, bound = B.spans(data, offsets, B.ALPHA)
    return data, offsets, starts, ends, bound


def _script(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first character."""
    at = lambda i: data[np.minimum(starts + i, len(data) - 1)].astype(np.int64)
    a, b, c, d = (at(i) for i in range(4))
    cp = np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63], (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)
    return _KIND[np.searchsorted(_FROM, cp, side="right") - 1]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between two marks, and for each the word's index; every word has some."""
    n = len(starts)
    length = ends - starts + 2
    off = np.concatenate([[0], np.cumsum(length)])
    flat = np.zeros(off[-1], np.uint64)
    inner = np.ones(off[-1], bool)
    inner[off[:-1]] = inner[off[1:] - 1] = False
    body, _ = B.cut(data, starts, ends)
    flat[inner] = body.astype(np.uint64) + np.uint64(1)
    left = np.repeat(off[1:], length) - np.arange(off[-1])
    word = np.repeat(np.arange(n), length)
    key, buckets, owners = np.zeros(off[-1], np.uint64), [], []
    for k in range(1, max(GRAMS) + 1):
        key[: len(flat) - k + 1] = key[: len(flat) - k + 1] * np.uint64(263) + flat[k - 1 :]
        if k in GRAMS:
            ok = left >= k
            buckets.append((B.mix(key[ok] + np.uint64(k << 56)) % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(word[ok])
    return np.concatenate(buckets), np.concatenate(owners)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS, held_out: tuple[int, int] = (5, 0)) -> dict:
    """Counts n-grams and scripts by language over a hashed sample of about max_rows labelled rows that are not held out.

    Rows with null text or language are not learned from. With no labelled row
    the model knows no language. The counts come to the driver: at most
    (BUCKETS + scripts) numbers for each language.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    rows = rows.where(remainder(F.col("k"), held_out[0]) != held_out[1])
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1_000_000)) < F.lit(int(1e6 * max_rows / n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in B.slices(batch, "t"):
                for l in pc.unique(part.column("l")).to_pylist():  # noqa: E741
                    own = part.filter(pc.equal(part.column("l"), l))
                    data, _, starts, ends, _ = _words(own.column("t"))
                    if not len(starts):
                        continue
                    codes, _, at = B.distinct(B.hashes(data, starts, ends))
                    weight = np.bincount(codes)
                    buckets, owner = _grams(data, starts[at], ends[at])
                    have = total.setdefault(l, np.zeros(BUCKETS + len(_NAMES)))
                    have[:BUCKETS] += np.bincount(buckets, weight[owner], BUCKETS)
                    have[BUCKETS:] += np.bincount(_script(data, starts[at]), weight, len(_NAMES))
        for l, have in total.items():  # noqa: E741
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at), pa.array(have[at])], names=["l", "b", "n"])

    got = rows.select("t", "l").mapInArrow(count, "l string, b long, n double").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["l"].unique())
    table = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    table[got["b"].to_numpy(np.int64), got["l"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = got["n"].to_numpy()
    grams, scripts = table[:BUCKETS] + 0.1, table[BUCKETS:]
    return {"langs": langs, "logp": np.log(grams / grams.sum(0)).astype(np.float32) if langs else grams, "scripts": (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))) if langs else scripts}


def word_scores(model: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log posterior of each language for each word, at least -FLOOR; languages without the word's script are at -2 FLOOR."""
    buckets, owner = _grams(data, starts, ends)
    n, m = len(starts), len(model["langs"])
    s = np.stack([np.bincount(owner, model["logp"][buckets, j], n) for j in range(m)], 1)
    s -= s.max(1, keepdims=True)
    s -= np.log(np.exp(s).sum(1, keepdims=True))
    s = np.maximum(s, -FLOOR)
    can = model["scripts"][_script(data, starts)]
    s[~can & can.any(1, keepdims=True)] = -2 * FLOOR
    s[~can.any(1)] = -np.log(m)  # no language has this script: no evidence
    return s.astype(np.float32)


def viterbi(scores: np.ndarray, bound: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; words of document d are bound[d] to bound[d + 1]. All documents advance together.

    Ties stay with the previous label, then with the first language.
    """
    n, m = scores.shape
    length = np.diff(bound)
    order = np.argsort(-length, kind="stable")
    first, length = bound[:-1][order], length[order]
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")
    back = np.empty((n, m), np.int8 if m < 128 else np.int32)
    own = np.arange(m)
    v, final = None, np.zeros((len(length), m), scores.dtype)
    for t, k in enumerate(active):
        at = first[:k] + t
        if v is None:
            v = scores[at].copy()
            back[at] = own
        else:
            v = v[:k]
            best = v.argmax(1)
            top = v[np.arange(k), best] - switch
            stay = v >= top[:, None]
            back[at] = np.where(stay, own, best[:, None])
            v = np.where(stay, v, top[:, None]) + scores[at]
        final[:k] = v
    path = np.zeros(n, np.int64)
    label = final.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        path[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return path


def predict(model: dict, column: pa.Array, switch: float = SWITCH):
    """Language, score (share of word bytes) and spans (array of lang, start, end in characters) of each text."""
    data, offsets, starts, ends, bound = _words(column)
    n, langs = len(column), model["langs"]
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if len(starts) and langs:
        codes, _, at = B.distinct(B.hashes(data, starts, ends))
        path = viterbi(word_scores(model, data, starts[at], ends[at])[codes], bound, switch)
    else:
        path, starts, ends, bound = np.zeros(0, np.int64), starts[:0], ends[:0], np.zeros(n + 1, np.int64)
    doc = np.repeat(np.arange(n), np.diff(bound))
    share = np.bincount(doc * max(1, len(langs)) + path, ends - starts, n * max(1, len(langs))).reshape(n, -1)
    best, total = share.argmax(1), share.sum(1)
    known = letters & (total > 0)
    names = np.array([*langs, "und"], object)
    score = np.where(known, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
    new = np.ones(len(path), bool)
    if len(path):
        new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(path)) - 1 if len(a) else a
    chars = B.char_index(data)
    zero = chars[offsets[:-1]]
    runs = pa.StructArray.from_arrays([pa.array(names[path[a]], pa.string()), pa.array(chars[starts[a]] - zero[doc[a]], pa.int64()), pa.array(chars[ends[z]] - zero[doc[a]], pa.int64())], names=["lang", "start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[a], np.arange(n + 1)).astype(np.int32)), runs)
    return pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(score), lists


def identify(docs: DataFrame, model: dict, text: str = "text", prefix: str = "lang_", switch: float = SWITCH) -> DataFrame:
    """The rows with three more columns: <prefix>pred, <prefix>score and <prefix>spans, which replace columns of these names.

    Null texts and texts without a letter are ``und`` with score 0 and no
    spans. Empty tables give empty tables.
    """
    names = [f"{prefix}{x}" for x in ("pred", "score", "spans")]
    keep = [c for c in docs.columns if c not in names]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *predict(shared.value, part.column(text), switch)], names=[*keep, *names])

    return rows.mapInArrow(run, extended(rows.schema, f"{names[0]} string, {names[1]} double, {names[2]} array<struct<lang:string,start:bigint,end:bigint>>"))
