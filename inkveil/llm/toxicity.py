"""A counterfactual-regularised toxicity classifier.

Logistic regression over the presence of selected words and stems (first bytes
of longer words, so that endings don't hide a word). For each labelled text with
identity terms, the same text with the terms swapped must get nearly the same
score: the squared change of the logit is part of the loss. A last step sets the
scale of the logits by smoothed labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import extended, remainder

#: Identity terms in groups; a swap takes the next of a group.
IDENTITIES = (
    ("he", "she", "they"), ("him", "her", "them"), ("man", "woman", "person"), ("men", "women", "people"), ("boy", "girl", "child"), ("male", "female", "nonbinary"), ("father", "mother", "parent"), ("husband", "wife", "spouse"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"), ("homosexual", "heterosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"), ("american", "mexican", "chinese", "indian", "arab", "german", "french", "spanish"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "blind", "deaf", "abled"), ("old", "young", "elderly"),
    ("mann", "frau"), ("männer", "frauen"), ("christen", "muslime", "juden"), ("homme", "femme"), ("hommes", "femmes"), ("chrétiens", "musulmans", "juifs"), ("hombre", "mujer"), ("hombres", "mujeres"), ("cristianos", "musulmanes", "judíos"),
)
#: Labelled rows that the classifier is fitted on at most; words that it may use at most besides identity terms.
MAX_TRAIN_ROWS, MAX_WORDS = 20_000, 1024
LEAST_DOCS = 4
#: Bytes of a stem.
STEM = 5
#: The least likelihood ratio statistic of a word.
LEAST_G = 18.0
THRESHOLD = 0.7


def _features(column: pa.Array, swap: tuple[np.ndarray, np.ndarray] | None = None):
    """Hashes of the words and stems of each text, and each one's document; with swap, of the text with its terms swapped."""
    data, offsets = B.raw(column)
    data = B.LOWER[data]
    starts, ends, bound = B.spans(data, offsets, B.ALNUM)
    h, doc = B.hashes(data, starts, ends), np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    long = ends - starts > STEM
    if swap is not None and len(h):
        old, new = swap
        to = np.minimum(np.searchsorted(old, h), len(old) - 1)
        hit = old[to] == h
        h, long = np.where(hit, new[to], h), long & ~hit
    stems = B.mix(B.hashes(data, starts[long], starts[long] + STEM) + np.uint64(1))
    return np.concatenate([h, stems]), np.concatenate([doc, doc[long]])


def _swaps() -> dict[int, int]:
    return {B.hash_of(a.encode()): B.hash_of(b.encode()) for group in IDENTITIES for a, b in zip(group, (*group[1:], group[0]), strict=True)}


def _presence(h: np.ndarray, doc: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, word) of each vocabulary word that a document has."""
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    to = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    ok = vocabulary[to] == h
    pair = np.unique(doc[ok] * len(vocabulary) + to[ok])
    return pair // len(vocabulary), pair % len(vocabulary)


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label_key: str, label: str, held_out: tuple[int, int], max_rows: int) -> DataFrame:
    """(t, y) of at most max_rows labelled rows that are not held out, by a hash of their key; that bound allows the broadcast.

    A key with several labels counts as 1 if one of them is; null labels and keys don't count.
    """
    some = labels.select(F.col(label_key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    some = some.where(remainder(F.col("k"), held_out[0]) != held_out[1]).groupBy("k").agg(F.max("y").alias("y"))
    some = some.orderBy(F.xxhash64("k", F.lit(5)), "k").limit(max_rows)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.join(F.broadcast(some), "k").select("k", "t", "y")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label_key: str = "doc_id", label: str = "toxic", held_out: tuple[int, int] = (3, 1), max_rows: int = MAX_TRAIN_ROWS, penalty: float = 5.0, ridge: float = 1e-5) -> dict:
    """The model: sorted word hashes, weights, bias. Words are chosen by the likelihood ratio of their document counts; one
    number for each of at most MAX_WORDS words and the features of at most max_rows texts come to the driver."""
    rows = training_rows(docs, labels, text, key, label_key, label, held_out, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "t"):
                h, doc = _features(part.column("t"))
                _, _, at = B.distinct(B.mix(h + B.mix(doc.astype(np.uint64) + np.uint64(1))))
                codes, values, _ = B.distinct(h[at])
                y = (part.column("y").to_numpy() > 0)[doc[at]].astype(float) if len(at) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64) if len(values) else np.zeros(0, np.int64)), pa.array(np.bincount(codes, y, len(values)).astype(np.int64)), pa.array(np.bincount(codes, minlength=len(values)).astype(np.int64))], names=["h", "p", "n"])

    p_all, n_all = rows.agg(F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    empty = {"words": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": float(np.log((p_all + 0.5) / (n_all - p_all + 0.5)))}
    if not p_all or p_all == n_all:
        return empty
    counts = rows.select("t", "y").mapInArrow(count, "h long, p long, n long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    rate = p_all / n_all
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    o, n = F.col("p").cast("double"), F.col("n").cast("double")
    g = 2 * (part(o, n * rate) + part(n - o, n * (1 - rate)))
    best = counts.select("h", g.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "h").limit(MAX_WORDS).toPandas()
    swap = _swaps()
    vocabulary = np.unique(np.concatenate([best["h"].to_numpy(np.int64).view(np.uint64), np.array([*swap], np.uint64)]))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, np.array([*swap], np.uint64), np.array([*swap.values()], np.uint64)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, old, new = shared.value
        order = np.argsort(old)
        old, new = old[order], new[order]
        for batch in batches:
            for part in B.slices(batch, "t"):
                lists = []
                for x, doc in (_features(part.column("t")), _features(part.column("t"), (old, new))):
                    d, w = _presence(x, doc, v)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(w)))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), *lists], names=["k", "y", "x", "z"])

    got = rows.mapInArrow(features, "k long, y int, x array<long>, z array<long>").toPandas().sort_values("k")
    x, y = [np.asarray(x, np.int64) for x in got["x"]], (got["y"].to_numpy() > 0).astype(float)
    weights, bias = fit(x, [np.asarray(z, np.int64) for z in got["z"]], y, len(vocabulary), penalty, ridge)
    a, b = scale(np.array([weights[i].sum() for i in x]) + bias, y)
    weights, bias = a * weights, a * bias + b
    return {"words": vocabulary, "weights": weights, "bias": bias}


def fit(x: list[np.ndarray], z: list[np.ndarray], y: np.ndarray, width: int, penalty: float, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows: log loss, ridge, and penalty times the squared logit change from x to z."""
    n = len(y)
    flat = lambda rows: (np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0)]).astype(np.int64))
    xi, xj = flat(x)
    moved = [np.setdiff1d(a, b) for a, b in zip(x, z, strict=True)], [np.setdiff1d(b, a) for a, b in zip(x, z, strict=True)]
    (ai, aj), (bi, bj) = flat(moved[0]), flat(moved[1])
    di, dj, ds = np.concatenate([ai, bi]), np.concatenate([aj, bj]), np.concatenate([np.ones(len(ai)), -np.ones(len(bi))])
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(xi, w[xj], n))))
        change = np.bincount(di, ds * w[dj], n)
        e = (p - y) / n
        grad = np.append(np.bincount(xj, e[xi], width) + 2 * penalty / n * np.bincount(dj, ds * change[di], width) + ridge * w, e.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def scale(logits: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's scale and shift of logits, by Newton's method on smoothed labels."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    design, w = np.stack([logits, np.ones(len(y))], 1), np.array([1.0, 0.0])
    loss = lambda w: float((np.logaddexp(0, design @ w) - target * (design @ w)).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (target - p))
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def score(docs: DataFrame, model: dict, text: str = "text", prefix: str = "toxic_", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with <prefix>score (0 to 1) and <prefix>predicted, which replace columns of these names. Null and empty texts
    get the score of a text without known words; empty tables give no rows."""
    names = [prefix + "score", prefix + "predicted"]
    keep = [c for c in docs.columns if c not in names]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in B.slices(batch, text):
                h, doc = _features(part.column(text))
                d, w = _presence(h, doc, m["words"])
                s = 1 / (1 + np.exp(-(m["bias"] + np.bincount(d, m["weights"][w], part.num_rows))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *names])

    return rows.mapInArrow(run, extended(rows.schema, f"{names[0]} double, {names[1]} int"))
