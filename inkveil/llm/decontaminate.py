"""Benchmark decontamination: a prefix-filtered set join for exact containment.

A window is item_words consecutive words of an item. Its set of shingles is
ordered by rarity in the documents; for exact containment the necessary prefix
is the rarest shingle alone. Documents meet windows on that shingle; its place
in the window then gives the only possible start, which must lie in the document
(positional and length bound), and the bytes of all words are compared.

A benchmark of up to BROADCAST_BYTES goes to all tasks as an index; a larger one
stays distributed, and shingles of documents that pass a sieve of fixed size are
joined with it. Both read the documents twice, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import extended, written
from .exact_dedup import numbered

WINDOW = 10
SHINGLE = 5
#: Bytes of item text that are broadcast at most.
BROADCAST_BYTES = 2 << 20
#: Places of the sieve in the join.
SIEVE = 1 << 22


def _tokens(column: pa.Array):
    """Lower-cased bytes, hashes, starts and ends of the words, and each text's bounds."""
    data, offsets = B.raw(column)
    data = B.LOWER[data]
    starts, ends, bound = B.spans(data, offsets, B.ALNUM)
    return data, B.hashes(data, starts, ends), starts, ends, bound


class Windows:
    """The windows of one block of items: words, items, shingles."""

    def __init__(self, items: pd.DataFrame, window: int, shingle: int):
        self.data, h, self.starts, self.ends, bound = _tokens(pa.array(items["text"], pa.string()))
        self.items = ["" if x is None else str(x) for x in items["item"]]
        whole = self.data.tobytes()
        text = [whole[a:z] for a, z in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        seen: dict[tuple, int] = {}
        words, owners, first = [], [], []
        for i, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)):
            k = min(window, b - a)
            for s in range(a, b - k + 1) if k else ():
                at = seen.setdefault(tuple(text[s : s + k]), len(words))
                if at == len(words):
                    words.append(h[s : s + k])
                    owners.append(set())
                    first.append(s)
                owners[at].add(i)
        self.words, self.owners, self.first = words, [np.array(sorted(o)) for o in owners], np.array(first, np.int64)
        self.length = np.array([len(w) for w in words], np.int64)
        self.shingles = [(min(shingle, len(w)), B.window_hashes(w, min(shingle, len(w)))) for w in words]

    def sizes(self) -> list[int]:
        return sorted({k for k, _ in self.shingles})

    def keys(self, k: int) -> np.ndarray:
        return np.unique(np.concatenate([s for n, s in self.shingles if n == k]))

    def prefix(self, counts: dict[int, dict[int, int]]) -> dict:
        """For each shingle size: sorted keys, and for each key its windows and the place of the shingle in them."""
        self.by_size = {}
        for k in self.sizes():
            rows = []
            for i, (n, s) in enumerate(self.shingles):
                if n == k:
                    place = min(range(len(s)), key=lambda j: (counts.get(k, {}).get(int(s[j]), 0), j))
                    rows.append((int(s[place]), i, place))
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            keys, first, n = np.unique(key, return_index=True, return_counts=True)
            self.by_size[k] = (keys, first, n, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), _sieve(keys))
        self.shingles = None
        return self.by_size


def _sieve(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[keys & np.uint64(len(bits) - 1)] = True
    return bits


def _found(values: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that are keys, and which."""
    at = np.flatnonzero(sieve[values & np.uint64(len(sieve) - 1)])
    to = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    ok = keys[to] == values[at]
    return at[ok], to[ok]


def _starts(h: np.ndarray, bound: np.ndarray, k: int, keys: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in the words of a chunk keys are met, which, and in what document; runs over a document's end don't count."""
    at, key = _found(B.window_hashes(h, k), keys, sieve)
    doc = np.searchsorted(bound, at, side="right") - 1
    ok = at + k <= bound[doc + 1]
    return at[ok], key[ok], doc[ok]


def matches(index: Windows, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and window of each occurrence."""
    out = []
    for k, (keys, first, n, window, place, sieve) in index.by_size.items():
        at, key, doc = _starts(h, bound, k, keys, sieve)
        if not len(at):
            continue
        reps = n[key]
        row = np.repeat(first[key], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        start, doc, w = np.repeat(at, reps) - place[row], np.repeat(doc, reps), window[row]
        ok = np.flatnonzero((start >= bound[doc]) & (start + index.length[w] <= bound[doc + 1]))
        for j in range(int(index.length[w[ok]].max(initial=0))):
            a, o = start[ok] + j, index.first[w[ok]] + j
            over = j >= index.length[w[ok]]
            a, o = np.where(over, start[ok], a), np.where(over, index.first[w[ok]], o)
            ok = ok[B.same_runs(data, starts[a], ends[a], index.data, index.starts[o], index.ends[o])]
        out.append((doc[ok], start[ok], w[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def contaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", prefix: str = "", window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with <prefix>n_words, n_hit, n_items, items_sha256 and contaminated, which replace columns of these names.

    Words: runs of letters, digits and non-ASCII characters after A-Z are
    lower-cased. An item of fewer than window words, but not none, is one
    window. Null texts and items have no words; a null item_id reads as the
    empty text; an empty benchmark or table gives no hits or no rows. Repeated
    items count once by their id, repeated rows each for itself; of shingles
    equally rare the first of a window counts. Very long texts are taken whole.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = [prefix + c for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    if size > broadcast_bytes:
        return _joined(rows, items, text, names, window, shingle)
    index = Windows(items.toPandas(), window, shingle)
    index.prefix(_rarity(docs.select(F.col(text).alias("t")), index))
    ddl = f"{names[0]} long, {names[1]} long, {names[2]} long, {names[3]} string, {names[4]} boolean"
    return rows.mapInArrow(_marker(spark.sparkContext.broadcast(index), text, rows.columns, names), extended(rows.schema, ddl))


def _rarity(texts: DataFrame, index: Windows) -> dict[int, dict[int, int]]:
    """How often each shingle of the block occurs in the documents; one number for each shingle comes to the driver."""
    keys = {k: index.keys(k) for k in index.sizes()}
    if not keys:
        return {}
    shared = texts.sparkSession.sparkContext.broadcast({k: (v, _sieve(v)) for k, v in keys.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v[0]), np.int64) for k, v in shared.value.items()}
        for batch in batches:
            for part in B.slices(batch, "t"):
                _, h, _, _, bound = _tokens(part.column("t"))
                for k, (v, sieve) in shared.value.items():
                    total[k] += np.bincount(_starts(h, bound, k, v, sieve)[1], minlength=len(v))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], names=["k", "i", "n"])

    got = texts.mapInArrow(count, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toPandas()
    return {k: dict(zip(v[got["i"][got["k"] == k]].tolist(), got["n"][got["k"] == k].tolist(), strict=True)) for k, v in keys.items()}


def _marker(shared, text: str, keep: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in B.slices(batch, text):
                data, h, starts, ends, bound = _tokens(part.column(text))
                doc, start, w = matches(index, data, h, starts, ends, bound) if index.words else (np.zeros(0, np.int64),) * 3
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[w] if len(w) else start, -1)
                found: dict[int, set] = {}
                pair = np.unique(np.stack([doc, w], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                for d, x in pair.tolist():
                    found.setdefault(d, set()).update(index.items[i] for i in index.owners[x])
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                n_hit = hit[bound[1:]] - hit[bound[:-1]]
                sha = [hashlib.sha256(",".join(sorted(found[d])).encode()).hexdigest() if d in found else none for d in range(part.num_rows)]
                n_items = np.array([len(found.get(d, ())) for d in range(part.num_rows)], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bound)), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(n_hit > 0)], names=[*keep, *names])

    return run


def _windows(window: int, shingle: int):
    """(item, words, n, k, keys) of each window of each item: its words joined by spaces, their number, its shingles' size
    and hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text", B.CHUNK // 8):
                data, h, starts, ends, bound = _tokens(part.column("text"))
                whole, out = data.tobytes(), []
                word = [whole[a:z].decode() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                for name, a, b in zip(part.column("item").to_pylist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    n = min(window, b - a)
                    k = min(shingle, n)
                    keys = B.window_hashes(h[a:b], k).view(np.int64).tolist() if n else []
                    out += [(name, " ".join(word[s : s + n]), n, k, keys[s - a : s - a + n - k + 1]) for s in (range(a, b - n + 1) if n else ())]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["item", "words", "n", "k", "keys"])

    return run


def _sieved(table: DataFrame, key: str = "key") -> np.ndarray:
    """The fixed-size sieve of a column of hashes; at most SIEVE numbers come to the driver."""
    bits = np.zeros(SIEVE, bool)
    bits[table.select(F.pmod(F.col(key), F.lit(SIEVE)).alias("i")).distinct().toPandas()["i"].to_numpy(np.int64)] = True
    return bits


def _met(shared, sizes: list[int], window: int, whole: bool):
    """Of documents (uid, t), their shingles that pass the sieve: (k, key, n) counts; or, whole, (uid, at, k, key, words, place): where it
    begins, the words around it that a window may cover, and its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for batch in batches:
            for part in B.slices(batch, "t", B.CHUNK // 2):
                data, h, starts, ends, bound = _tokens(part.column("t"))
                text, uid = data.tobytes(), part.column("uid").to_numpy()
                for k in sizes:
                    key = B.window_hashes(h, k)
                    at = np.flatnonzero(sieve[(key & np.uint64(SIEVE - 1)).astype(np.int64)])
                    doc = np.searchsorted(bound, at, side="right") - 1
                    ok = at + k <= bound[doc + 1]
                    at, doc = at[ok], doc[ok]
                    key = key[at].view(np.int64)
                    if not whole:
                        values, n = np.unique(key, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k)), pa.array(values), pa.array(n)], names=["k", "key", "n"])
                        continue
                    a, z = np.maximum(bound[doc], at - window + 1), np.minimum(bound[doc + 1], at + window)
                    words = [[text[i:j].decode() for i, j in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(uid[doc]), pa.array(at - bound[doc]), pa.array(np.full(len(at), k)), pa.array(key), pa.array(words, pa.list_(pa.string())), pa.array(at - a)], names=["uid", "at", "k", "key", "words", "place"])

    return run


def _n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in B.slices(batch, "t"):
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(np.diff(_tokens(part.column("t"))[4]))], names=["uid", "n_words"])


def _joined(rows: DataFrame, items: DataFrame, text: str, names: list[str], window: int, shingle: int) -> DataFrame:
    """The same by joins: nothing that grows with the benchmark or the documents is broadcast."""
    context = rows.sparkSession.sparkContext
    table = numbered(rows)
    docs = table.select("uid", F.coalesce(F.col("row")[text], F.lit("")).alias("t"))
    every = written(items.mapInArrow(_windows(window, shingle), "item string, words string, n long, k long, keys array<long>"), "windows")
    distinct = every.groupBy("words", "n", "k").agg(F.first("keys").alias("keys"))
    shingles = distinct.select("words", "n", "k", F.posexplode("keys").alias("place", "key"))
    sizes = [r.k for r in every.select("k").distinct().collect()]
    sieve = context.broadcast(_sieved(shingles))
    counts = docs.mapInArrow(_met(sieve, sizes, window, False), "k long, key long, n long").groupBy("k", "key").agg(F.sum("n").alias("often"))
    rarest = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "place", "key")).alias("m")
    prefix = written(shingles.join(counts, ["k", "key"], "left").groupBy("words", "n", "k").agg(rarest).select("words", "n", "k", F.col("m.place").alias("own"), F.col("m.key").alias("key")), "prefixes")
    met = docs.mapInArrow(_met(context.broadcast(_sieved(prefix)), sizes, window, True), "uid long, at long, k long, key long, words array<string>, place long")
    start = (F.col("place") - F.col("own")).cast("int")
    same = F.array_join(F.slice(F.col("d.words"), F.greatest(start, F.lit(0)) + 1, F.col("n").cast("int")), " ") == F.col("p.words")
    hits = met.alias("d").join(prefix.alias("p"), ["k", "key"]).where((start >= 0) & (start + F.col("n") <= F.size("d.words")) & same)
    hits = written(hits.select("uid", (F.col("at") - F.col("own")).alias("first"), "n", F.col("p.words").alias("words")).distinct(), "hits")
    n_hit = hits.select("uid", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("i")).distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    found = hits.select("uid", "words").distinct().join(every.select("item", "words").distinct(), "words").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = table.join(docs.mapInArrow(_n_words, "uid long, n_words long"), "uid").join(n_hit, "uid", "left").join(found, "uid", "left")
    own = [F.col("n_words"), F.coalesce("n_hit", F.lit(0)), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256), F.col("n_hit").isNotNull()]
    return out.select("row.*", *(c.alias(n) for c, n in zip(own, names, strict=True)))
