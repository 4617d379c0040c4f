"""Subword lattice likelihood: a text's probability over all its segmentations.

An existing vocabulary gives the pieces and, by its scores, first weights; these
are re-estimated on the counts of all training words by forward and backward
sums. A word is a word-start mark and its bytes; every byte is a piece, so every
text has a probability. After each token a text ends with the training texts'
rate, or else takes a word by its pieces. The forward recursion runs in log space,
for many words at once; a word's result is kept while its task's cache holds it.
A word of more than LONG bytes is taken alone, slab by slab.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import remainder, written
from .token_counts import MARK

ROUNDS = 3
#: Words of at least 1 / HEAVY of all training tokens, so at most HEAVY of them, are broadcast; the others are joined.
HEAVY = 1 << 19
_CACHE = 1 << 19
#: Words that a task counts before it passes them on.
_TABLE = 1 << 18
#: Bytes of words whose lattices are held at once; a lattice takes about 400 times as many.
_PART = 1 << 17
#: Longer words are swept node by node, _SLAB bytes of lattice at once.
LONG, _SLAB = 512, 1 << 15


def load_vocabulary(model_file: str) -> list[tuple[bytes, float]]:
    """Pieces and first log weights of a sentencepiece model whose scores are minus the pieces' ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).encode()
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) or MARK in p[1:]):
            out[p] = -np.log(100 - max(sp.get_score(i), -1e6))
    return list(out.items())


def _rolled(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of every substring follows: (total[j] - total[i]) * inverse[i], for short ones."""
    n = len(flat)
    part = B._LUT[flat] * B._pow(B._BASE, n + 1)[:n]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)]), B._pow(B._INV, n + 1)


def piece_hash(piece: bytes) -> int:
    return int(B.mix(_rolled(np.frombuffer(piece, np.uint8))[0][-1:])[0])


class Lattice:
    """The vocabulary as hash tables; ids: pieces at a word's start, pieces inside, the mark alone."""

    def __init__(self, vocabulary: list[tuple[bytes, float]]):
        least = min((w for _, w in vocabulary), default=0.0) - 3
        start = {p[len(MARK) :]: w for p, w in vocabulary if p.startswith(MARK) and p != MARK}
        inner = {bytes([i]): least for i in range(256)} | {p: w for p, w in vocabulary if not p.startswith(MARK)}
        bare = dict(vocabulary).get(MARK, least)
        self.n = len(start) + len(inner) + 1
        self.bare = self.n - 1
        self.longest = max(map(len, [*start, *inner]))
        self.sides, at = [], 0
        for side in (start, inner):
            sizes = {}
            for k in sorted({len(p) for p in side}):
                own = [(piece_hash(p), at + i) for i, p in enumerate(side) if len(p) == k]
                own.sort()
                keys = np.array([h for h, _ in own], np.uint64)
                bits = np.zeros(1 << 18, bool)
                bits[keys & np.uint64(len(bits) - 1)] = True
                sizes[k] = (keys, np.array([i for _, i in own]), bits)
            self.sides.append(sizes)
            at += len(side)
        w = np.array([*start.values(), *inner.values(), bare])
        self.logp = w - np.log(np.exp(w - w.max()).sum()) - w.max()

    def edges(self, flat: np.ndarray, off: np.ndarray, begins: bool = True, until: int | None = None):
        """Lattice edges of words (bytes one after another): from and to node, piece, whether the mark alone goes before.
        A word of n bytes has n + 1 nodes. begins: words begin at off, not before; until: edges from nodes before it."""
        n = len(flat)
        length = np.diff(off)
        word = np.repeat(np.arange(len(length)), length)
        left = np.repeat(off[1:], length) - np.arange(n)
        total, inverse = _rolled(flat)
        sizes = sorted({*self.sides[0], *self.sides[1]})
        at, first = np.arange(n if until is None else until), (left == length[word]) & begins
        out = []
        for k in sizes:
            at = at[left[at] >= k]
            if not len(at):
                break
            h = B.mix((total[at + k] - total[at]) * inverse[at])
            for s, side in enumerate(self.sides):
                if k not in side:
                    continue
                keys, ids, bits = side[k]
                ok = bits[h & np.uint64(len(bits) - 1)]
                if not s:
                    ok &= first[at]
                i, v = at[ok], h[ok]
                to = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
                ok = keys[to] == v
                i, to = i[ok], to[ok]
                out.append((i + word[i], i + word[i] + k, ids[to], first[i] & bool(s)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def forward(self, flat: np.ndarray, off: np.ndarray, logp: np.ndarray, counts: np.ndarray | None = None):
        """Log probability of each word; with counts of the words, also the expected uses of each piece."""
        size = np.diff(off)
        z, total = np.zeros(len(size)), np.zeros(self.n)
        for i in np.flatnonzero(size > LONG).tolist():
            z[i], use = self._long(flat[off[i] : off[i + 1]], logp, None if counts is None else counts[i])
            total += use
        short = np.flatnonzero(size <= LONG)
        if len(short) < len(size):
            flat, off = B.cut(flat, off[:-1][short], off[1:][short])
        cuts = np.unique(np.append(np.searchsorted(off, np.arange(0, off[-1], _PART)), len(off) - 1))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            z[short[i:j]], use = self._short(flat[off[i] : off[j]], off[i : j + 1] - off[i], logp, None if counts is None else counts[short[i:j]])
            total += use
        return z if counts is None else (z, total)

    def _short(self, flat: np.ndarray, off: np.ndarray, logp: np.ndarray, counts: np.ndarray | None):
        words = len(off) - 1
        node = off + np.arange(words + 1)
        src, dst, piece, bare = self.edges(flat, off)
        w = logp[piece] + np.where(bare, logp[self.bare], 0)
        own = np.repeat(node[:-1], np.diff(off) + 1)
        a = np.full(node[-1], -np.inf)
        a[node[:-1]] = 0
        _sweep(a, src, dst, w, dst - own[dst])
        z = a[node[1:] - 1]
        if counts is None:
            return z, 0
        b = np.full(node[-1], -np.inf)
        b[node[1:] - 1] = 0
        last = np.repeat(node[1:] - 1, np.diff(off) + 1)
        _sweep(b, dst, src, w, last[src] - src)
        which = np.repeat(np.arange(words), np.diff(off) + 1)[src]
        return z, self._uses(piece, bare, np.exp(a[src] + w + b[dst] - z[which]) * counts[which])

    def _uses(self, piece: np.ndarray, bare: np.ndarray, use: np.ndarray) -> np.ndarray:
        total = np.bincount(piece, use, self.n)
        total[self.bare] += use[bare].sum()
        return total

    def _long(self, word: np.ndarray, logp: np.ndarray, count: float | None):
        """One word, with the edges of one slab at once and a number for each node."""
        n, total = len(word), np.zeros(self.n)

        def slab(s: int):
            part = word[s : s + _SLAB + self.longest]
            src, dst, piece, bare = self.edges(part, np.array([0, len(part)]), s == 0, min(_SLAB, n - s))
            order = np.argsort(src, kind="stable")
            src, dst, piece, bare = src[order] + s, dst[order] + s, piece[order], bare[order]
            return src, dst, piece, bare, logp[piece] + np.where(bare, logp[self.bare], 0)

        def sweep(v: list[float], edges) -> None:
            for i, j, w in edges:
                x, y = v[i] + w, v[j]
                v[j] = x if y == -inf else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))

        a = [0.0, *[-inf] * n]
        for s in range(0, n, _SLAB):
            src, dst, _, _, w = slab(s)
            sweep(a, zip(src.tolist(), dst.tolist(), w.tolist(), strict=True))
        if count is None:
            return a[n], 0
        b = [*[-inf] * n, 0.0]
        for s in reversed(range(0, n, _SLAB)):
            src, dst, piece, bare, w = slab(s)
            sweep(b, zip(dst[::-1].tolist(), src[::-1].tolist(), w[::-1].tolist(), strict=True))
            x, y = np.array(a[s : s + _SLAB]), np.array(b[s : s + _SLAB + self.longest + 1])
            total += self._uses(piece, bare, np.exp(x[src - s] + w + y[dst - s] - a[n]) * count)
        return a[n], total


def _sweep(a: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, step: np.ndarray) -> None:
    """a[dst] = log of the sum of exp(a[src] + w), in the order of steps."""
    order = np.lexsort((dst, step))
    src, dst, w, step = src[order], dst[order], w[order], step[order]
    new = np.append(True, dst[1:] != dst[:-1]) if len(dst) else np.zeros(0, bool)
    cuts = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(dst) else []
    for i, j in zip(cuts, [*cuts[1:], len(dst)], strict=True):
        v = a[src[i:j]] + w[i:j]
        head = np.flatnonzero(new[i:j])
        top = np.maximum.reduceat(v, head)
        size = np.diff(np.append(head, j - i))
        a[dst[i:j][head]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size)), head))


def _tokens(column: pa.Array):
    data, offsets = B.raw(column)
    data = B.LOWER[data]
    return (data, *B.spans(data, offsets, B.SOLID))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word binary, c) of all words of column t; counts meet in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for part in B.slices(batch, "t"):
                data, starts, ends, _ = _tokens(part.column("t"))
                codes, _, at = B.distinct_runs(data, starts, ends)
                whole = data.tobytes()
                for a, z, n in zip(starts[at].tolist(), ends[at].tolist(), np.bincount(codes, minlength=len(at)).tolist(), strict=True):
                    w = whole[a:z]
                    held[w] = held.get(w, 0) + n
                if len(held) > _TABLE:
                    yield _counted(held)
                    held = {}
        yield _counted(held)

    return rows.select("t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])


def _join(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return B.raw(words.cast(pa.large_binary()))


def fit(counts: DataFrame, vocabulary: list[tuple[bytes, float]], rounds: int = ROUNDS) -> tuple[Lattice, np.ndarray]:
    """Log weights of the pieces from the counts of all words. Each round sends one number a piece."""
    lattice = Lattice(vocabulary)
    context = counts.sparkSession.sparkContext
    logp = lattice.logp
    for _ in range(rounds):
        shared = context.broadcast((lattice, logp))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lat, p = shared.value
            total = np.zeros(lat.n)
            for batch in batches:
                for part in B.slices(batch, "word", _PART):
                    flat, off = _join(part.column("word"))
                    if len(flat):
                        total += lat.forward(flat, off, p, part.column("c").to_numpy().astype(float))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

        got = counts.select("word", "c").mapInArrow(expect, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(lattice.n, 0.01)
        total[got["i"].to_numpy(np.int64)] += got["n"].to_numpy(float)
        logp = np.log(total / total.sum())
        shared.unpersist()
    return lattice, logp


class Known:
    """Counts of some words, found by hash and told apart by bytes."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.data = np.frombuffer(b"".join(words), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        h = B.hashes(self.data, off[:-1], off[1:])
        order = np.argsort(h, kind="stable")
        self.h, self.c, self.a, self.z = h[order], np.array(counts, np.int64)[order], off[:-1][order], off[1:][order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The count of each run of bytes with hash h; 0 if it is none of the words."""
        if not len(self.h) or not len(h):
            return np.zeros(len(h), np.int64)
        to = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero(self.h[to] == h)
        c = np.zeros(len(h), np.int64)
        while len(hit):
            ok = B.same_runs(data, starts[hit], ends[hit], self.data, self.a[to[hit]], self.z[to[hit]])
            c[hit[ok]] = self.c[to[hit[ok]]]
            hit = hit[~ok]  # another word with this hash may follow
            to[hit] += 1
            hit = hit[to[hit] < len(self.h)]
            hit = hit[self.h[to[hit]] == h[hit]]
        return c


def score(docs: DataFrame, vocabulary: list[tuple[bytes, float]], text: str = "text", key: str = "doc_id", held_out: tuple[int, int] = (5, 1), rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """One row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learns from the rows whose key's crc32 does not leave the held-out remainder.
    Tokens: runs of bytes other than ASCII white space after A-Z are lower-cased,
    and one end for each text; null counts as empty. base_score is that of single
    tokens with counts plus a half; score the lattice's. Repeated rows and null
    keys are scored like any, and rows of one text alike; a very long text or word
    is scored whole. Other columns are not read; without rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), (remainder(F.col(key), held_out[0]) == held_out[1]).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    texts = train.count()
    counts = written(word_counts(train), "words")
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, types = words + texts, types + (texts > 0)
    lattice, logp = fit(counts, vocabulary, rounds)
    often = counts.where(F.col("c") * heavy >= n).toPandas()
    shared = spark.sparkContext.broadcast((lattice, logp, Known([bytes(w) for w in often["word"]], often["c"].tolist())))
    bottom = float(np.log10(n + 0.5 * (types + 1)))
    stop = (texts + 0.5) / (n + 1)
    go, end = float(np.log10(1 - stop)), float(np.log10(stop))
    base = lambda c: np.log10(c + 0.5) - bottom

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, p, known = shared.value
        cache: dict[bytes, float] = {}
        for batch in batches:
            for part in B.slices(batch, "t"):
                data, starts, ends, bound = _tokens(part.column("t"))
                codes, h, at = B.distinct_runs(data, starts, ends)
                starts, ends, whole = starts[at], ends[at], data.tobytes()
                if len(cache) > _CACHE:
                    cache.clear()
                listed = [whole[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                new = np.array([i for i, w in enumerate(listed) if w not in cache], np.int64)
                if len(new):
                    flat, off = B.cut(data, starts[new], ends[new])
                    cache.update(zip([listed[i] for i in new.tolist()], (lat.forward(flat, off, p) / np.log(10)).tolist(), strict=True))
                logs = np.fromiter(map(cache.__getitem__, listed), float, len(listed))
                c = known.find(data, starts, ends, h)
                m, size = part.num_rows, np.diff(bound)
                doc = np.repeat(np.arange(m), size)
                add = lambda v, doc=doc, m=m: np.bincount(doc, v, m)
                hit, uid = c > 0, part.column("uid").to_numpy()
                heads = [part.column("doc_id"), part.column("uid"), part.column("held_out"), pa.array(size + 1), pa.array((add(hit[codes].astype(float)) + (texts > 0)).astype(np.int64)), pa.array(add(np.where(hit, base(c), 0.0)[codes]) + base(texts)), pa.array(add(logs[codes]) + size * go + end)]
                own = [b" " + u.tobytes() for u in uid]  # no word has a space: it meets no count, and is dealt evenly
                yield pa.RecordBatch.from_arrays([*heads, pa.array(own, pa.binary()), pa.nulls(m, pa.int64())], names=names)
                rare = ~hit[codes]
                pair, keys = np.unique(doc[rare] * max(1, len(listed)) + codes[rare], return_counts=True)
                d, w = pair // max(1, len(listed)), pair % max(1, len(listed))
                k = len(pair)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, part.schema.field("doc_id").type), pa.array(uid[d]), pa.nulls(k, pa.bool_()), *(pa.nulls(k, pa.int64()) for _ in range(2)), *(pa.nulls(k, pa.float64()) for _ in range(2)), pa.array(np.array(listed, object)[w] if k else [], pa.binary()), pa.array(keys)], names=names)

    names = ["doc_id", "uid", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "tf"]
    kind = dict(rows.dtypes)["doc_id"]
    parts = rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, f"doc_id {kind}, uid long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, tf long")
    tail = counts.where(F.col("c") * heavy < n)
    c = F.coalesce("c", F.lit(0))
    each = parts.join(tail, "word", "left").withColumn("n_known", F.coalesce("n_known", F.when(c > 0, F.col("tf")).otherwise(0))).withColumn("base_score", F.coalesce("base_score", F.col("tf") * (F.log10(c + 0.5) - F.lit(bottom))))
    one = lambda c: F.max(c).alias(c)
    done = each.groupBy("uid").agg(one("doc_id"), one("held_out"), one("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), one("score"))
    return done.drop("uid")
