"""Exact dedup: owners of equal texts in Patricia tries.

Texts are dealt by length and content hash; each task inserts whole byte strings
into a compressed radix trie whose terminal nodes keep the owner and the number
of rows. Copies inside a map task meet in a trie there, so a group that holds a
third of all rows sends one string from each task. When a trie holds too many
bytes, its largest subtree goes to a temporary file and is finished later alone.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _bytes as B
from ._shared import written

#: Bytes of keys that one trie keeps in memory.
TRIE_BYTES = 48 << 20
#: Groups of at least 1 / HEAVY of all rows are broadcast.
HEAVY = 1000


class _Node:
    __slots__ = ("edges", "owner", "rows", "label")

    def __init__(self, label: bytes):
        self.label, self.edges, self.owner, self.rows = label, {}, None, 0


class PatriciaTrie:
    """A compressed radix trie over byte strings; first(owner) decides which of two owners stays.

    Branches of the root go to temporary files by first byte when more than
    limit bytes of labels are held, and come back as tries of their own.
    """

    def __init__(self, first=max, limit: int = TRIE_BYTES, depth: int = 0, prefix: bytes = b""):
        self.first, self.limit, self.depth, self.prefix = first, limit, depth, prefix
        self.root, self.size, self.by_branch, self.spilled = _Node(b""), 0, {}, {}

    def insert(self, key: bytes, owner, rows: int = 1) -> None:
        branch = key[self.depth] if len(key) > self.depth else None
        if branch in self.spilled:
            pickle.dump((key, owner, rows), self.spilled[branch])
            return
        node, at = self.root, self.depth
        while at < len(key):
            child = node.edges.get(key[at])
            if child is None:
                child = _Node(key[at:])
                node.edges[key[at]] = child
                self._grow(branch, len(key) - at)
                node, at = child, len(key)
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            rest = key[at : at + len(label)]
            same = next((i for i, (a, b) in enumerate(zip(label, rest, strict=False)) if a != b), len(rest)) if len(label) < 64 else _common(label, rest)
            upper = _Node(label[:same])
            node.edges[key[at]] = upper
            child.label = label[same:]
            upper.edges[child.label[0]] = child
            node, at = upper, at + same
        node.owner = owner if not node.rows else self.first(node.owner, owner)
        node.rows += rows
        if self.size > self.limit:
            self._spill()

    def _grow(self, branch, n: int) -> None:
        self.size += n + 200
        self.by_branch[branch] = self.by_branch.get(branch, 0) + n + 200

    def _spill(self) -> None:
        branch = max((b for b in self.by_branch if b is not None), key=self.by_branch.get, default=None)
        if branch is None:
            return
        f = tempfile.TemporaryFile()  # noqa: SIM115
        for item in self._walk(self.root.edges.pop(branch), self.prefix):
            pickle.dump(item, f)
        self.spilled[branch] = f
        self.size -= self.by_branch.pop(branch)

    def _walk(self, node: _Node, before: bytes) -> Iterator[tuple]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.rows:
                yield key, node.owner, node.rows
            stack.extend((x, key) for x in node.edges.values())

    def items(self) -> Iterator[tuple]:
        """(key, owner, rows) of every distinct key; may be read once. A subtree in a file goes on below what all its keys
        begin with, so it has several branches or is one key."""
        yield from self._walk(self.root, self.prefix)
        self.root = _Node(b"")
        for f in self.spilled.values():
            prefix = None
            for key, _, _ in _loaded(f):
                prefix = key if prefix is None else key[: _common(prefix, key)]
            sub = PatriciaTrie(self.first, self.limit, len(prefix), prefix)
            for item in _loaded(f):
                sub.insert(*item)
            f.close()
            yield from sub.items()


def _loaded(f) -> Iterator[tuple]:
    f.seek(0, os.SEEK_SET)
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    d = x != y
    return int(d.argmax()) if d.any() else n


def _normal(column: pa.Array) -> list[bytes]:
    data, off = B.raw(column)
    whole = B.LOWER[data].tobytes()
    return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _owner(key, uid: int) -> tuple:
    return (key is not None, key if key is not None else 0, uid)


_STRINGS = "h long, len long, t binary, id long, uid long, n long"
_OWNERS = "text_sha256 string, keep_id long, keep_uid long, group_size long"


def owners(rows: DataFrame, keep: str = "max") -> DataFrame:
    """One row for each distinct text of rows (t, id, uid): text_sha256, keep_id, keep_uid, group_size.

    Each task inserts its texts into a trie, and what that holds is dealt by
    length and hash: equal texts meet once more, one string from each task's trie.
    """
    first = max if keep == "max" else min
    strings, found = (pa.schema([(f.name, {"binary": pa.binary(), "string": pa.string()}.get(f.dataType.simpleString(), pa.int64())) for f in StructType.fromDDL(x)]) for x in (_STRINGS, _OWNERS))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for t, o, n in trie.items():
                rows.append({"h": int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big", signed=True), "len": len(t), "t": t, "id": o[1] if o[0] else None, "uid": o[2], "n": n})
                size += len(t)
                if size > B.CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=strings)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=strings)

        trie = PatriciaTrie(first, 1 << 62)
        for batch in batches:
            for part in B.slices(batch, "t"):
                for t, d, u in zip(_normal(part.column("t")), part.column("id").to_pylist(), part.column("uid").to_pylist(), strict=True):
                    trie.insert(t, _owner(d, u))
                if trie.size > TRIE_BYTES // 2:  # what is kept so far goes on; the rest of the task starts anew
                    yield from flush(trie)
                    trie = PatriciaTrie(first, 1 << 62)
        yield from flush(trie)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(first)
        for batch in batches:
            for t, d, u, n in zip(batch.column("t"), batch.column("id").to_pylist(), batch.column("uid").to_pylist(), batch.column("n").to_pylist(), strict=True):
                trie.insert(t.as_py(), _owner(d, u), n)
        rows = []
        for t, o, n in trie.items():
            rows.append({"text_sha256": hashlib.sha256(t).hexdigest(), "keep_id": o[1] if o[0] else None, "keep_uid": o[2], "group_size": n})
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema=found)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=found)

    return rows.select("t", "id", "uid").mapInArrow(local, _STRINGS).repartition("len", "h").mapInArrow(final, _OWNERS)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows as (row, uid), written once: a struct of all columns and a number that stays with it, however often, by
    whatever plan and on whatever executors the table is read again."""
    return written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(t).hexdigest() for part in B.slices(batch, "t") for t in _normal(part.column("t"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sha, pa.string()), batch.column("uid")], names=["doc_id", "text_sha256", "uid"])


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "max") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after A-Z are lower-cased; null counts as
    empty. Of equal texts the largest (keep="min": smallest) id stays; a null id
    is smaller than all; of rows with equal ids too, one stays. A very long text
    is one string of a trie, whole. Other columns are not read. Empty tables give
    no rows.

    Groups of at least 1 / HEAVY of all rows, so at most HEAVY of them, find
    their rows by a broadcast; the others by a join in which no key is hot.
    """
    docs = numbered(docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(key).cast("long").alias("id")))
    rows = docs.select("row.*", "uid")
    heads = written(rows.mapInArrow(_digests, "doc_id long, text_sha256 string, uid long"), "heads")
    own = written(owners(rows, keep), "owners")
    n = heads.count()
    heavy = F.broadcast(own.where(F.col("group_size") * HEAVY >= n))
    many = heads.join(heavy, "text_sha256")
    few = heads.join(heavy.select("text_sha256"), "text_sha256", "left_anti").join(own.where(F.col("group_size") * HEAVY < n), "text_sha256")
    return many.unionByName(few).select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns: those that exact_groups keeps."""
    docs = numbered(docs)
    rows = docs.select(F.coalesce(F.col("row")[text], F.lit("")).alias("t"), F.col("row")[key].cast("long").alias("id"), "uid")
    return docs.join(owners(rows, keep).select(F.col("keep_uid").alias("uid")), "uid", "left_semi").select("row.*")
