"""Near-dedup by ProbMinHash of weighted word shingles, banding and exact verification.

A document is the bag of its five-word shingles; the similarity of two is the
probability Jaccard of their counts (plain Jaccard where no shingle repeats).
Each shingle sends exponential arrivals at the rate of its weight to random
registers, until an arrival is later than every register of its document. Bands
of registers give buckets. Documents of equal words are one class beforehand.
Classes of a bucket meet its centre, not each other; links are verified exactly
and joined to components, in two waves of bands. Classes that share a bucket with
another component even then are compared whole and exactly: by the rarest of their
shingles, of which two similar texts must share one. Small groups meet by a join,
large ones in blocks, where an exact bound prunes, texts decide, and only links
that join components come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import free, mark, since, written
from .exact_dedup import numbered

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, 0.9998.
BANDS, ROWS = 28, 6
#: Bands of the first and of the second wave of buckets.
WAVES = ((0, 8), (8, BANDS))
#: Buckets of up to SMALL classes are compared by a join, larger ones in blocks; both compare all.
SMALL = 12
#: Bytes of text of either side of a block.
BLOCK_BYTES = 1 << 18
#: Bytes of all blocks that are dealt at once, at least; more where the words' bytes, by four a word, are more.
SHARE_BYTES = 1 << 28
#: Shingles are ordered by rarity: by counts of their hashes' remainders, at least and at most so many, by one for each
#: RARITY_BYTES of text between. Where many rare shingles share a count, texts meet that share nothing rare. Counts are summed
#: in segments of SEGMENT.
RARITY = (1 << 18, 1 << 24)
RARITY_BYTES = 16
SEGMENT = 1 << 16
_OTHER = 0xD6E8FEB86659FD93


def shingles(column: pa.Array, k: int = SHINGLE):
    """Of each text: (document, shingle, count) of its distinct shingles, a 128-bit print of its words, and its number of
    words. A text of fewer than k words, but not none, is one shingle."""
    data, offsets = B.raw(column)
    data = B.LOWER[data]
    starts, ends, bound = B.spans(data, offsets, B.ALNUM)
    h = B.hashes(data, starts, ends)
    n = np.diff(bound)
    prints = B.prints(h, bound)
    w = B.window_hashes(h, k)
    doc = np.repeat(np.arange(len(n)), n)[: len(w)]
    whole = np.arange(len(w)) + k <= bound[1:][doc]
    short = np.flatnonzero((n > 0) & (n < k))
    doc, w = np.concatenate([doc[whole], short]), np.concatenate([w[whole], prints[0][short]])
    codes, _, at = B.distinct(B.mix(w + B.mix(doc.astype(np.uint64) + np.uint64(1))))
    doc, w, count = doc[at], w[at], np.bincount(codes, minlength=len(at))
    return doc, w, count, prints, n


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The n x m registers: of each, the arrival (high half) and the element (low half) that came first."""
    q = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
    flat, low = q.reshape(-1), key & np.uint64(0xFFFFFFFF)
    x, alive, r = np.zeros(len(key)), np.arange(len(key)), 0
    while len(alive):
        r += 1
        u = B.mix(key[alive] + np.uint64(r * B._BASE % (1 << 64)))
        x[alive] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[alive]
        register = (B.mix(u + np.uint64(_OTHER)) % np.uint64(m)).astype(np.int64)
        code = x[alive].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | low[alive]
        d = doc[alive]
        np.minimum.at(flat, d * m + register, code)
        some = np.unique(d) if r > 2 else np.arange(n)
        latest = np.zeros(n, np.uint64)
        latest[some] = q[some].max(1)
        alive = alive[code <= latest[d]]
    return q


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in B.slices(batch, "t"):
            doc, w, count, prints, n = shingles(part.column("t"))
            q = signatures(doc, w, count.astype(np.float64), len(n), BANDS * ROWS)
            band = B.mix(q & np.uint64(0xFFFFFFFF)).reshape(len(n), BANDS, ROWS)
            key = np.zeros((len(n), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(ROWS):
                key = B.mix(key * np.uint64(B._BASE) + band[:, :, i])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("uid"), *(pa.array(p.view(np.int64)) for p in prints), pa.array(n), lists], names=["id", "uid", "p", "q", "n", "bands"])


def similarity(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """The probability Jaccard of two bags (distinct keys and counts)."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(both) and u.max() == 1 and v.max() == 1:
        return len(both) / (len(a) + len(b) - len(both))
    if not len(both):
        return 0.0
    x = np.concatenate([u[i], np.delete(u, i), np.zeros(len(b) - len(j))]).astype(float)
    y = np.concatenate([v[j], np.zeros(len(a) - len(i)), np.delete(v, j)]).astype(float)
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    rank = np.searchsorted(ratio[order], ratio[: len(both)], side="left")
    above = np.append(np.cumsum(x[order][::-1])[::-1], 0)[rank]
    below = np.concatenate([[0], np.cumsum(y[order])])[rank]
    return float((1 / (above / x[: len(both)] + below / y[: len(both)])).sum())


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "tx", B.CHUNK // 2, "ty"):
                sides = []
                for c in ("tx", "ty"):
                    doc, w, count, _, n = shingles(part.column(c))
                    order = np.argsort(doc, kind="stable")
                    sides.append((w[order], count[order], np.searchsorted(doc[order], np.arange(len(n) + 1))))
                (w, u, a), (z, v, b) = sides
                got = np.array([similarity(w[a[k] : a[k + 1]], u[a[k] : a[k + 1]], z[b[k] : b[k + 1]], v[b[k] : b[k + 1]]) for k in range(part.num_rows)])
                ok = pa.array(got >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("x").filter(ok), part.column("y").filter(ok), pa.array(got).filter(ok)], names=["x", "y", "s"])

    return run


def _meet(least: float):
    """Of one block, a left and a right side (side 0 and 1; 2 is both): links between components, as many as join them. A
    pair of one component by then, or whose shared shingles cannot give least, is not looked at.

    Of two sets that is their Jaccard similarity itself. The bound for bags is exact: a term of the probability Jaccard,
    1 / sum of max(x / x_i, y / y_i), is at most the less of x_i and y_i as shares of their bags."""

    def run(table: pa.Table) -> pa.Table:
        c, side = table.column("c").to_numpy(), table.column("side").to_numpy()
        _, k = np.unique(table.column("k").to_numpy(), return_inverse=True)
        if k.max(initial=0) == 0:
            return pa.table({"x": np.zeros(0, np.int64), "y": np.zeros(0, np.int64), "s": np.zeros(0)})
        doc, w, count, _, n = shingles(table.column("t").combine_chunks())
        order = np.lexsort((w, doc))
        w, count, at = w[order], count[order], np.searchsorted(doc[order], np.arange(len(n) + 1))
        doc = np.repeat(np.arange(len(n)), np.diff(at))
        share = count / np.bincount(doc, count, len(n))[doc]
        size = np.diff(at)
        plain = np.bincount(doc, count, len(n)) == size
        _, code = np.unique(w, return_inverse=True)
        right = side[doc] > 0
        sets, bags = np.flatnonzero(right & plain[doc]), np.flatnonzero(right & ~plain[doc])
        mine = np.zeros(code.max(initial=-1) + 1)
        out, there = [], np.flatnonzero(side > 0)
        for a in np.flatnonzero(side != 1):
            near = there[k[there] != k[a]]
            if not len(near):
                continue
            own = slice(at[a], at[a + 1])
            mine[code[own]] = share[own]
            most = np.zeros(len(n))
            if plain[a]:
                both = np.rint(np.bincount(doc[sets], mine[code[sets]], len(n)) * size[a])
                most = both / (size[a] + size - both)
            bounded = bags if plain[a] else np.flatnonzero(right)
            if len(bounded):
                most += np.bincount(doc[bounded], np.minimum(mine[code[bounded]], share[bounded]), len(n))
            most = most[near]
            mine[code[own]] = 0
            near = near[np.argsort(-most, kind="stable")[: (most >= least - 1e-9).sum()]]
            for b in near:
                if k[a] == k[b]:
                    continue
                s = similarity(w[at[a] : at[a + 1]], count[at[a] : at[a + 1]], w[at[b] : at[b + 1]], count[at[b] : at[b + 1]])
                if s >= least - 1e-12:
                    out.append((c[a], c[b], s))
                    k[k == k[b]] = k[a]
        x, y, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "s": pa.array(s, pa.float64())})

    return run


def _rarity(slots: int):
    """(g, i, n): of each slice of texts the counts n of its shingles' remainders, by segment g and place i there, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "t"):
                at, n = np.unique(shingles(part.column("t"))[1] & np.uint64(slots - 1), return_counts=True)
                at, n = at.astype(np.int64), np.minimum(n, 255).astype(np.uint8)
                cuts = np.searchsorted(at, np.arange(0, slots + 1, SEGMENT))
                held = np.flatnonzero(np.diff(cuts))
                i, n = ([x[cuts[g] : cuts[g + 1]].tobytes() for g in held] for x in ((at % SEGMENT).astype("<u2"), n))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(i, pa.binary()), pa.array(n, pa.binary())], names=["g", "i", "n"])

    return run


def _ranks(table: pa.Table) -> pa.Table:
    """Of one segment: a rank for each place, its count up to 127, and eight ranks a power of two beyond. The order alone
    matters, and only that all texts share it."""
    total = np.zeros(SEGMENT, np.int64)
    for i, n in zip(table.column("i").to_pylist(), table.column("n").to_pylist(), strict=True):
        total[np.frombuffer(i, "<u2")] += np.frombuffer(n, np.uint8)
    rank = np.where(total < 128, total, np.minimum(255, 128 + 8 * (np.log2(np.maximum(total, 1)) - 7))).astype(np.uint8)
    return pa.table({"g": table.column("g")[:1], "r": pa.array([rank.tobytes()], pa.binary())})


def _ranked(texts: DataFrame) -> np.ndarray:
    """A rank for each remainder of the hashes of all shingles of texts (t)."""
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slots = min(max(RARITY[0], 1 << (size // RARITY_BYTES).bit_length()), RARITY[1])
    ranks = np.zeros(slots, np.uint8)
    for g, r in written(texts.select("t").mapInArrow(_rarity(slots), "g int, i binary, n binary").groupBy("g").applyInArrow(_ranks, "g int, r binary"), "ranks").collect():
        ranks[g * SEGMENT : (g + 1) * SEGMENT] = np.frombuffer(r, np.uint8)
    return ranks


def _prefixes(shared, least: float):
    """(b, c, k): of each text the necessary prefix of its shingles b in the shared order.

    Shares of two bags that are similar enough overlap by least. So what either has before their first common shingle,
    in whatever order all texts share, is at most 1 - least: that shingle is in both prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "t"):
                doc, w, count, _, n = shingles(part.column("t"))
                order = np.lexsort((w, shared.value[(w & np.uint64(len(shared.value) - 1)).astype(np.int64)], doc))
                doc, w, count = doc[order], w[order], count[order].astype(float)
                share = count / np.bincount(doc, count, len(n))[doc]
                before = np.cumsum(share) - share
                ok = before - before[np.searchsorted(doc, doc)] <= 1 - least + 1e-6
                c, k = (part.column(x).to_numpy()[doc[ok]] for x in "ck")
                yield pa.RecordBatch.from_arrays([pa.array(w[ok].view(np.int64)), pa.array(c), pa.array(k)], names=["b", "c", "k"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, comp): for each end of an edge (x, y) the smallest vertex that it reaches. Labels go to neighbours and jump to
    their label's label until none changes; each round is written, and the one before it removed."""
    before = mark()
    both = written(edges.select("x", "y").union(edges.select("y", "x")), "edges")
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("comp")), name)
    while True:
        near = both.join(labels, both.y == labels.v).groupBy("x").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.v == near.x, "left").select("v", F.least("comp", F.coalesce("m", "comp")).alias("c"), F.col("comp").alias("was"))
        jump = labels.select(F.col("v").alias("c"), F.col("comp").alias("far"))
        new = written(step.join(jump, "c", "left").select("v", F.least("c", F.coalesce("far", "c")).alias("comp"), "was"), name)
        if new.where("comp <> was").isEmpty():
            free(since(before), new)
            return new.select("v", "comp")
        free(since(before), both, new)
        labels = new.select("v", "comp")


def centred(members: DataFrame) -> DataFrame:
    """Pairs (x, y) of classes: in each bucket b that holds several components k, every member c of another component meets
    the bucket's centre, one of its members by a hash."""
    centre = F.min(F.struct(F.xxhash64("c").alias("r"), "c", "k")).alias("m")
    centres = members.groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), centre).where("lo <> hi").select("b", "m")
    return members.join(centres, "b").where("k <> m.k").select(F.col("c").alias("x"), F.col("m.c").alias("y")).distinct()


def _blocks(members: DataFrame, block_bytes: int) -> DataFrame:
    """Members (u, c, k, t) of clusters u with their blocks o (kind, i, j, side), in which each two members of different
    components meet. The largest component's members meet the others alone, and block_bytes of either side at once.

    Members are written once, with the numbers of their cluster's parts; the blocks, as many as those, are listed when a
    row is read: thousands of rows with their lists at once would not fit the memory of a task."""
    sizes = members.groupBy("u", "k").agg(F.sum(F.octet_length("t") + 64).alias("bytes"))
    sizes = sizes.groupBy("u").agg(F.max(F.struct("bytes", "k")).alias("main"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where("n > 1")
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / block_bytes)).cast("int")
    sizes = sizes.select("u", F.col("main.k").alias("main"), parts(F.col("main.bytes")).alias("n_main"), parts(F.col("bytes") - F.col("main.bytes")).alias("n_rest"))
    m = members.join(sizes, "u").withColumn("is_main", F.col("k") == F.col("main"))
    m = m.withColumn("at", F.pmod(F.xxhash64("c", F.lit(99)), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    m = written(m.select("u", "c", "k", "t", "is_main", "at", "n_main", "n_rest"), "members")
    block = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    rest, main = F.sequence(F.lit(0), F.col("n_rest") - 1), F.sequence(F.lit(0), F.col("n_main") - 1)
    of_main = F.transform(rest, lambda o: block(1, F.col("at"), o, F.lit(0)))
    among = F.transform(rest, lambda o: block(0, F.least("at", o), F.greatest("at", o), F.when(F.col("at") == o, 2).when(F.col("at") < o, 0).otherwise(1)))
    of_rest = F.concat(among, F.transform(main, lambda o: block(1, o, F.col("at"), F.lit(1))))
    return m.select("u", "c", "k", "t", F.when(F.col("is_main"), of_main).otherwise(of_rest).alias("o"))


def _shares(placed: DataFrame, most: int) -> list[DataFrame]:
    """The blocks (u, kind, i, j, side, c, k, t) of all placed members, each whole in one of as many shares as keep a share's
    bytes near most: what blocks repeat of their texts grows with the square of a cluster, and must not lie on disk at once."""
    total = placed.agg(F.sum((F.octet_length("t") + 64) * F.size("o"))).first()[0] or 0
    n = max(1, -(-total // most))
    own = lambda i: F.filter("o", lambda b: F.pmod(F.xxhash64("u", b["kind"], b["i"], b["j"]), F.lit(n)) == i)
    return [placed.select("u", "c", "k", "t", F.explode(own(i)).alias("o")).select("u", "o.*", "c", "k", "t") for i in range(n)]


def groups(rows: DataFrame, least: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """See near_groups; rows (id, t, uid) must be a written table."""
    sketch = written(rows.mapInArrow(_sketch, "id long, uid long, p long, q long, n long, bands array<long>"), "sketch")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    words = sketch.where("n > 0")
    classes = written(words.groupBy("p", "q").agg(F.min(order).alias("first"), F.first("bands").alias("bands")).select("p", "q", F.col("first.uid").alias("c"), F.col("first.id").alias("id"), "bands"), "classes")
    links = classes.select(F.col("c").alias("x"), F.col("c").alias("y")).where("1 = 0")
    comp = links.toDF("v", "comp")

    def named(table: DataFrame) -> DataFrame:
        return table.join(comp.withColumnRenamed("v", "c"), "c", "left").withColumn("k", F.coalesce("comp", "c")).drop("comp")

    def several(table: DataFrame) -> DataFrame:
        """The buckets that hold several components, and the number of their members."""
        return table.groupBy("b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("b", "n")

    def unite(found: DataFrame) -> None:
        nonlocal links, comp
        links = links.unionByName(found.select("x", "y"))
        comp = components(links)

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("c").alias("x"), F.col("t").alias("tx")), texts.select(F.col("c").alias("y"), F.col("t").alias("ty"))
        return written(pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty").mapInArrow(_verify(least), "x long, y long, s double"), "links")

    # The buckets of more than one class, and the texts of their members: all that is looked at from here on
    bands = classes.select("c", F.posexplode("bands").alias("band", "b"))
    common = bands.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    buckets = written(bands.join(common, "b").select("band", "b", "c"), "buckets")
    texts = written(rows.select(F.col("uid").alias("c"), "t").join(buckets.select("c").distinct(), "c"), "texts")
    # Members of a bucket meet its centre; in the second wave, where the first has not joined them
    for first, last in WAVES:
        own = named(buckets.where((F.col("band") >= first) & (F.col("band") < last)))
        unite(verify(written(centred(own), "pairs")))
    # What still shares a bucket with another component, compared whole
    held = named(buckets)
    apart = written(held.join(several(held).select("b"), "b").select("c", "k").distinct(), "apart")
    apart = written(apart.join(texts, "c"), "apart")
    rare = written(apart.mapInArrow(_prefixes(rows.sparkSession.sparkContext.broadcast(_ranked(apart)), least), "b long, c long, k long"), "rare")
    rare = written(rare.join(several(rare), "b"), "shared")
    few = rare.where(F.col("n") <= SMALL)
    pairs = few.select("b", F.col("c").alias("x"), "k").join(few.select("b", F.col("c").alias("y"), F.col("k").alias("ky")), "b").where("k < ky").select("x", "y").distinct()
    many = rare.where(F.col("n") > SMALL).select("b", "c")
    clusters = components(many.join(many.groupBy("b").agg(F.min("c").alias("y")), "b").where("c <> y").select(F.col("c").alias("x"), "y").distinct())
    members = clusters.select(F.col("comp").alias("u"), F.col("v").alias("c")).join(apart, "c")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    found = verify(written(pairs, "pairs"))
    n_words = words.agg(F.sum("n")).first()[0] or 0
    for share in _shares(_blocks(members, block_bytes), max(SHARE_BYTES, 4 * n_words)):
        met = share.repartition(tasks, "u", "kind", "i", "j").groupBy("u", "kind", "i", "j").applyInArrow(_meet(least), "x long, y long, s double")
        found = found.unionByName(written(met, "met"))
    unite(found)

    degree = links.select("x").union(links.select("y")).groupBy("x").agg(F.count("*").alias("n_links")).withColumnRenamed("x", "c")
    label = named(classes.select("p", "q", "c", "id")).join(degree, "c", "left")
    head = label.groupBy("k").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("c").alias("uid"))).alias("h"))
    label = label.join(head, "k").select("p", "q", "n_links", F.col("h.id").alias("class_id"), F.col("h.uid").alias("stays"))
    joined = words.select("id", "uid", "p", "q").join(label, ["p", "q"]).select(F.col("id").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("uid") == F.col("stays")).alias("kept"), "uid")
    alone = sketch.where("n = 0").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "uid")
    return joined.unionByName(alone)


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest id of its component; the row's own if alone), n_links
    (verified links of its words' class among those that were needed to find the component), kept (one row of each
    component: the one with the smallest id, then the first).

    Null texts and texts without words are never linked and always kept. Null ids
    come last. Repeated rows and rows of equal words are one class; ties go to the
    first row. A very long text is taken alone and whole. Other columns are not
    read; an empty table gives no rows.
    """
    rows = numbered(docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    return groups(rows.select("row.*", "uid"), least).drop("uid")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with all their columns: those that near_groups keeps."""
    rows = numbered(docs)
    gone = groups(rows.select(F.col("row")[key].cast("long").alias("id"), F.coalesce(F.col("row")[text], F.lit("")).alias("t"), "uid"), least).where(~F.col("kept")).select("uid")
    return rows.join(gone, "uid", "left_anti").select("row.*")
