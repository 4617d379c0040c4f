"""Byte-level kernels: words and their hashes, straight from Arrow buffers.

All functions work on one slice of a text column as a uint8 array with
document offsets, so that no Python object is made per word. Hashes find equal
words; where words must be the same, bytes decide (distinct_runs, same_runs).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; numpy's temporaries are about 30 times as large.
CHUNK = 2 << 20
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return x ^ (x >> 31)


#: A random 64-bit value for each byte.
_LUT = np.array([_mix_int(i + 1) for i in range(256)], np.uint64)

#: LOWER maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits and all bytes of non-ASCII characters (after LOWER).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Letters a-z and all bytes of non-ASCII characters.
ALPHA = ALNUM.copy()
ALPHA[48:58] = False

#: Everything but the six ASCII white-space bytes.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 8 * _BLOCK:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: workers stay between stages, and what they hold on to adds up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK, *more: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batch that hold about limit bytes of the text columns; a longer text is a slice of its own. What the
    work on a slice has freed is given back before the next."""
    n = batch.num_rows
    if not n:
        return
    lengths = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (column, *more))
    ends, at, freed = np.cumsum(lengths), 0, 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        freed = max(freed, ends[to - 1] - done)
        at = to
        if at == n or freed > limit:
            release()
            freed = 0


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes, and for each document the index of its first run (n + 1 bounds)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = keep[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = m[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = m[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Runs of more bytes are hashed one by one.
_LONG = 512


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes: its length, then 8 bytes a round, mixed in one after another."""
    n = ends - starts
    out = mix(n.astype(np.uint64) * np.uint64(_BASE) + np.uint64(_mix_int(seed + 1)))
    if not len(n):
        return out
    far = np.flatnonzero(n > _LONG)
    for i in far.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "big")).digest(), "little")
    eight, at = _words8(data), None
    for k in range(0, min(_LONG, int(n.max())), 8):
        if k == 0 and not len(far):
            out = mix((out ^ (eight[starts] & _MASK[np.minimum(n, 8)])) * np.uint64(_BASE))
            continue
        at = np.flatnonzero((n > k) & (n <= _LONG)) if at is None else at[n[at] > k]
        out[at] = mix((out[at] ^ (eight[starts[at] + k] & _MASK[np.minimum(n[at] - k, 8)])) * np.uint64(_BASE))
    return out


def same_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether each run of data has the bytes of the run of other beside it."""
    n = ends - starts
    ok = n == z - a
    x, y, at = _words8(data), _words8(other), np.flatnonzero(ok)
    for k in range(0, int(n.max(initial=0)), 8):
        at = at[n[at] > k]
        if k >= _LONG:  # few and long
            for i in at.tolist():
                ok[i] = np.array_equal(data[starts[i] + k : ends[i]], other[a[i] + k : z[i]])
            break
        bad = (x[starts[at] + k] ^ y[a[at] + k]) & _MASK[np.minimum(n[at] - k, 8)] != 0
        ok[at[bad]] = False
        at = at[~bad]
    return ok


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct runs by their bytes, the hash of each, and where each is seen first. Runs of one length up to 8
    bytes have hashes of their own (each step is a bijection); longer ones are compared."""
    seed, n = 0, ends - starts
    long = np.flatnonzero(n > 8)
    while True:
        codes, values, at = distinct(hashes(data, starts, ends, seed))
        first = at[codes[long]]
        if (n == n[at][codes]).all() and same_runs(data, starts[long], ends[long], data, starts[first], ends[first]).all():
            return codes, hashes(data, starts[at], ends[at]) if seed else values, at
        seed += 1  # two runs with one hash


def hash_of(word: bytes) -> int:
    """The same hash of one string of bytes."""
    data = np.frombuffer(word, np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def prints(h: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit print of each document's hashes in their order, as two numbers."""
    whole, cuts = h.tobytes(), (8 * bound).tolist()
    found = b"".join([hashlib.blake2b(whole[a:z], digest_size=16).digest() for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
    both = np.frombuffer(found, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes (n - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(_BASE)
        out += h[i : i + n]
    return mix(out)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the values, the distinct values, and where each is seen first."""
    codes, values = pd.factorize(h)
    at = np.empty(len(values), np.int64)
    at[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, values, at


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given runs one after another, and their offsets."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    where = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[where], offsets


def char_index(data: np.ndarray) -> np.ndarray:
    """The number of characters that begin before each byte (n + 1 values)."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
