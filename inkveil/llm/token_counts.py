"""Greedy word-piece counts by a linear longest-match automaton.

A trie over the vocabulary's bytes has failure links, and each link the number
of pieces it pops; a word is read once, byte by byte, and only counts are kept.
A word is U+2581 and its bytes; every byte is a piece, so a match never fails.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import extended

MARK = "▁".encode()
_CACHE = 1 << 20


def load_pieces(model_file: str) -> list[bytes]:
    """The pieces of a sentencepiece model: no control and no unknown ones, none of white space alone; byte pieces as single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    out = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in keep]
    return [p for p in out if MARK not in p[1:] or not p.startswith(MARK)] if out else out


class Automaton:
    """Counts greedy longest matches in linear time."""

    def __init__(self, pieces: list[bytes]):
        self.child: dict[int, int] = {}  # node << 8 | byte
        whole, parent, byte = [False], [0], [0]
        for p in [*{*pieces, *(bytes([i]) for i in range(256))}]:
            node = 0
            for c in p:
                to = self.child.get(node << 8 | c)
                if to is None:
                    to = self.child[node << 8 | c] = len(whole)
                    whole.append(False)
                    parent.append(node)
                    byte.append(c)
                node = to
            whole[node] = True
        kids: dict[int, list[int]] = {}
        for i in range(1, len(whole)):
            kids.setdefault(parent[i], []).append(i)
        self.link, self.pops = [0] * len(whole), [0] * len(whole)
        todo = deque(kids.get(0, ()))
        while todo:
            v = todo.popleft()
            todo.extend(kids.get(v, ()))
            if whole[v]:
                self.link[v], self.pops[v] = 0, 1
                continue
            z, n = self.link[parent[v]], self.pops[parent[v]]
            while (to := self.child.get(z << 8 | byte[v])) is None:
                n += self.pops[z]
                z = self.link[z]
            self.link[v], self.pops[v] = to, n

    def count(self, word: bytes) -> int:
        """The number of pieces of a string of bytes; at the root every byte has a child."""
        child, link, pops = self.child, self.link, self.pops
        node = n = 0
        for c in word:
            while (to := child.get(node << 8 | c)) is None:
                n += pops[node]
                node = link[node]
            node = to
        while node:
            n += pops[node]
            node = link[node]
        return n


_automata: dict[int, tuple[Automaton, dict]] = {}


def _automaton(shared) -> tuple[Automaton, dict]:
    pieces = shared.value
    k = hash(tuple(pieces))
    if k not in _automata:
        _automata.clear()
        _automata[k] = (Automaton(pieces), {})
    return _automata[k]


def count_tokens(docs: DataFrame, pieces: list[bytes], text: str = "text", prefix: str = "") -> DataFrame:
    """The rows with <prefix>n_words, n_pieces and n_bytes, which replace columns of these names.

    Words are runs of bytes other than ASCII white space. Null texts have none; of
    a very long text every word is counted, in time linear in its bytes. Repeated
    rows, ties and other columns don't matter; empty tables give no rows.
    """
    names = [prefix + c for c in ("n_words", "n_pieces", "n_bytes")]
    keep = [c for c in docs.columns if c not in names]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(shared)
        for batch in batches:
            for part in B.slices(batch, text):
                data, offsets = B.raw(part.column(text))
                starts, ends, bound = B.spans(data, offsets, B.SOLID)
                codes, _, first = B.distinct_runs(data, starts, ends)
                if len(known) > _CACHE:
                    known.clear()
                whole = data.tobytes()
                words = [whole[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                for w in words:
                    if w not in known:
                        known[w] = automaton.count(MARK + w)
                own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[codes] if len(codes) else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(own)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bound)), pa.array(total[bound[1:]] - total[bound[:-1]]), pa.array(np.diff(offsets))], names=[*keep, *names])

    return rows.mapInArrow(run, extended(rows.schema, ", ".join(f"{c} long" for c in names)))
