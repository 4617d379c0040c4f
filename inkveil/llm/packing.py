"""Hierarchical multi-length packing.

A document's ids are cut into whole windows; what remains is routed to the
smallest context-size tier that holds it. Windows of the longest tier are filled
up from shorter tiers (best fit, then a cut), then each shorter tier is packed
alike; a rest of a task becomes power-of-two sequences. Every task packs what it
scans. Step groups hold sequences of one padded size; what is left of each size
when a task ends is mixed. As sizes are powers of two, every group has exactly
step_tokens padded tokens, but for the last of each task.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

TIERS = (256, 512, 1024, 2048)
#: The least power of two that a task's last tokens are cut into.
LEAST = 32
END_ID = 1
#: Padded tokens of one step.
STEP_TOKENS = 32_768
#: Tokens of short remainders that a task keeps for gaps before it packs them by themselves.
POOL_TOKENS = 1 << 20
_CACHE = 1 << 20

_classes: np.ndarray | None = None


def _char_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for each code point."""
    global _classes
    if _classes is None:
        kind = {"L": 1, "N": 2}
        _classes = np.array([kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)
        _classes[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return _classes


def pretokens(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a pre-token of the byte-level BPE begins at each code point: contractions, runs of letters, numbers or
    others with one space before them, and white space, of which the last character before a run stands apart."""
    n = len(cp)
    kind = _char_classes()[cp]
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    edge = begin[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    out = edge.copy()
    space = cp == 32
    joined = np.flatnonzero(edge[1:] & ~begin[1:n] & space[:-1] & (kind[1:] != 3)) + 1  # a run takes the space before it
    out[joined] = False
    last = np.flatnonzero(edge[1:] & ~begin[1:n] & (kind[:-1] == 3))  # white space before a run of the same text
    out[last] = True
    p = np.flatnonzero((cp[:-1] == 39) & out[:-1] & (kind[1:] == 1) & ~begin[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(p):
        one, two = cp[p + 1], np.where((p + 2 < n) & ~begin[np.minimum(p + 2, n)], cp[np.minimum(p + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(p), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        ok = short | long
        out[p[ok] + 1] = False
        after = p[ok] + np.where(short, 2, 3)[ok]
        out[after[after < n]] = True
    return out


class Encoder:
    """Ids of whole texts; each distinct pre-token is encoded once for as long as the cache holds it."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _learn(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[w] = len(self.ends) - 1
            self.ids.extend(e.ids)
            self.ends.append(len(self.ids))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the texts' n + 1 offsets."""
        odd = np.zeros(len(column), bool)
        for s in self.specials:
            odd |= pc.fill_null(pc.match_substring(column, s), False).to_numpy(zero_copy_only=False)
        if odd.any():  # control strings inside a text: the library's own way, text by text
            column = pc.fill_null(column, "")
            rows = [self.tokenizer.encode(t, add_special_tokens=False).ids if o else None for t, o in zip(column.to_pylist(), odd, strict=True)]
            ids, off = self.encode(pc.if_else(pa.array(odd), "", column))
            parts = [ids[off[i] : off[i + 1]] if r is None else np.array(r, np.uint32) for i, r in enumerate(rows)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        data, offsets = B.raw(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        head = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.flatnonzero(pretokens(cp, np.searchsorted(head, offsets)))
        starts = head[at]
        ends = np.append(starts[1:], len(data))
        codes, _, first = B.distinct_runs(data, starts, ends)
        if len(self.known) > _CACHE:
            self._reset()
        whole = data.tobytes()
        words = [whole[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self._learn([w for w in words if w not in self.known])
        row = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        pool, bounds = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        a, z = bounds[row][codes], bounds[row + 1][codes]
        ids, off = B.cut(pool, a, z)
        out = ids.copy()
        del pool, bounds, ids
        return out, off[np.searchsorted(starts, offsets)]


class _Packer:
    """Packs pieces (document's row, start, ids) into sequences; rows() gives and forgets what is done."""

    def __init__(self, tiers: tuple[int, ...], partition: int, least: int = LEAST, step_tokens: int = STEP_TOKENS):
        self.tiers, self.window, self.least, self.step_tokens = tiers, tiers[-1], least, step_tokens
        if any(t & (t - 1) for t in tiers) or step_tokens % tiers[-1]:
            raise ValueError("tiers must be powers of two, and step_tokens a multiple of the last")
        self.next, self.next_group = partition << 33, partition << 33
        self.open: dict[int, list[list[tuple]]] = {}
        self.pools = {t: ([], []) for t in tiers}  # sorted lengths; pieces beside them
        self.held = 0
        self.out: list[tuple] = []

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        lengths, pieces = self.pools[self.tier(n)]
        i = bisect.bisect_left(lengths, n)
        lengths.insert(i, n)
        pieces.insert(i, piece)
        self.held += n

    def take(self, tier: int, i: int) -> tuple:
        lengths, pieces = self.pools[tier]
        self.held -= lengths.pop(i)
        return pieces.pop(i)

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for s in range(0, whole, self.window):
            self.emit([(doc, s, ids[s : s + self.window])])
        if whole < len(ids):
            self.put((doc, whole, ids[whole:].copy()))

    def emit(self, pieces: list[tuple]) -> None:
        n, at = sum(len(p[2]) for p in pieces), 0
        padded = n if n & (n - 1) == 0 else self.window
        rows = []
        for doc, start, ids in pieces:
            rows.append((*doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), self.next, at, padded, ids))
            at += len(ids)
        self.next += 1
        group = self.open.setdefault(padded, [])
        group.append(rows)
        if len(group) * padded == self.step_tokens:
            self.close(self.open.pop(padded))

    def close(self, group: list[list[tuple]]) -> None:
        """A step group is full, or the last."""
        self.out += [(*r[:-1], self.next_group, r[-1]) for rows in group for r in rows]
        self.next_group += 1

    def mix(self) -> None:
        """The open groups as mixed ones: sizes in falling order fill each other up."""
        group, filled = [], 0
        for padded in sorted(self.open, reverse=True):
            for rows in self.open[padded]:
                group.append(rows)
                filled += padded
                if filled == self.step_tokens:
                    self.close(group)
                    group, filled = [], 0
        if group:
            self.close(group)
        self.open = {}

    def fill(self, pieces: list[tuple], gap: int, own: int) -> int:
        """Fills a gap from shorter tiers by best fit, then by cutting the longest short piece; what is left of it."""
        while gap:
            best = None
            for t in reversed([t for t in self.tiers if t <= own]):
                i = bisect.bisect_right(self.pools[t][0], gap) - 1
                if i >= 0:
                    best = (t, i)
                    break
            if best:
                pieces.append(self.take(*best))
                gap -= len(pieces[-1][2])
                continue
            t = next((t for t in self.tiers if t <= own and self.pools[t][0]), None)
            if t is None:
                return gap
            doc, start, ids = self.take(t, len(self.pools[t][0]) - 1)
            pieces.append((doc, start, ids[:gap]))
            self.put((doc, start + gap, ids[gap:]))
            gap = 0
        return 0

    def pack(self, last: bool) -> None:
        for t in reversed(self.tiers):
            if t != self.window and not last and self.held < POOL_TOKENS:
                break
            while self.pools[t][0]:
                pieces = [self.take(t, len(self.pools[t][0]) - 1)]
                left = self.fill(pieces, t - len(pieces[0][2]), t)
                if not left:
                    self.emit(pieces)
                elif not last:
                    for p in pieces:
                        self.put(p)
                    return
                else:  # these are the last tokens of all tiers up to t
                    self.rest(pieces)
        if last:
            self.mix()

    def rest(self, pieces: list[tuple]) -> None:
        n = sum(len(p[2]) for p in pieces)
        while n:
            size = 1 << (n.bit_length() - 1)
            size = n if size < self.least else size
            own, need = [], size
            while need:
                doc, start, ids = pieces.pop(0)
                own.append((doc, start, ids[:need]))
                if len(ids) > need:
                    pieces.insert(0, (doc, start + need, ids[need:]))
                need -= len(own[-1][2])
            self.emit(own)
            n -= size

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


_COLUMNS = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "sequence_length", "step_group"]


def pack(docs: DataFrame, tokenizer_json: str, text: str = "text", key: str = "doc_id", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, doc_tokens, start, length, ids_crc32, sequence_id, offset, sequence_length
    (padded), step_group and the ids.

    tokenizer_json is the text of a tokenizer file. Null texts count as empty
    and have the end id alone. Rows with equal or null ids and repeated rows are
    packed like any; of remainders of one length the later one is taken first. A
    very long text is encoded alone and cut into whole windows. Empty tables give
    no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    arrow = pa.schema([*((c, pa.int64()) for c in _COLUMNS), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        partition = TaskContext.get().partitionId()
        encoder, packer = _encoder(shared), _Packer(tiers, partition)

        def done() -> pa.RecordBatch:
            columns = list(zip(*packer.rows(), strict=True)) or [()] * 10
            ids = pa.array(np.concatenate(columns[9]).astype(np.int32) if columns[9] else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[3], dtype=np.int64)]).astype(np.int32)), ids)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:9]), lists], schema=arrow)

        for batch in batches:
            for part in B.slices(batch, "t"):
                ids, off = encoder.encode(part.column("t"))
                for i, d in enumerate(part.column("id").to_pylist()):
                    packer.add((d, int(off[i + 1] - off[i]) + 1), np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)))
                packer.pack(False)
                yield done()
        packer.pack(True)
        yield done()

    rows = docs.select(F.col(text).alias("t"), F.col(key).cast("long").alias("id"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS) + ", ids array<int>")


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One for each worker process and tokenizer; later tasks find its cache filled."""
    value = shared.value
    k = hash(value)
    if k not in _encoders:
        _encoders.clear()
        _encoders[k] = Encoder(value)
    return _encoders[k]
