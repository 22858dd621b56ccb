"""Vectorised text kernels over the buffers of Arrow string columns.

Everything here works on one bounded chunk of documents inside one task: a byte
buffer, the documents' offsets in it, and arrays with one entry per word. Spark
decides which documents meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_K0, _K1, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

#: Bytes that are not ASCII white space: words `[^\x20\x09-\x0D]+`.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, lower-case ASCII letters and all bytes of other characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values, in place on its own copy."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text (one row at least): first row, end row, bytes, offsets.

    Null texts count as empty.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def parts(buf: np.ndarray, offs: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A chunk as :func:`chunks` gives it, but a single text of more than ``limit`` bytes in parts, each up to and with the last
    byte of ``ends`` before the limit, or the first one after it: bytes and offsets."""
    if len(offs) > 2 or len(buf) <= limit:
        yield buf, offs
        return
    a = 0
    while a < len(buf):
        b = len(buf)
        if a + limit < b:
            near = np.flatnonzero(ends[buf[a : a + limit]])
            b = a + int(near[-1]) + 1 if len(near) else 0
            at = a + limit
            while not b:  # no end so far: look on
                near = np.flatnonzero(ends[buf[at : at + limit]])
                b = at + int(near[0]) + 1 if len(near) else len(buf) if at + limit >= len(buf) else 0
                at += limit
        yield buf[a:b], np.array([0, b - a])
        a = b


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf`` and, per document, the number of the first word (one more entry at the end)."""
    if not len(buf):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offs), np.int64)
    w = table[buf]
    edge = np.empty(len(w), dtype=bool)
    edge[0] = True
    np.logical_not(w[:-1], out=edge[1:])
    inner = offs[:-1][offs[:-1] < len(buf)]
    edge[inner] = True
    starts = np.flatnonzero(w & edge)
    edge[-1] = True
    np.logical_not(w[1:], out=edge[:-1])
    edge[offs[1:][offs[1:] > 0] - 1] = True
    ends = np.flatnonzero(w & edge) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    lens = ends - starts
    h = mix((lens.astype(np.uint64) + U64(seed)) * _K0 ^ (view[starts] & _MASK[np.minimum(lens, 8)]))
    act, k = np.flatnonzero(lens > 8), 8
    while act.size:
        left = lens[act] - k
        h[act] = mix((h[act] * _K1) ^ (view[starts[act] + k] & _MASK[np.minimum(left, 8)]))
        k += 8
        act = act[left > 8]
    return h


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive entries of ``h``, whatever document they are in."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= _K1
        out += h[j : j + n]
    return mix(out)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` words that lie in one document; ``first`` as from :func:`words`."""
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)
    return np.flatnonzero(np.arange(int(first[0]), int(first[-1])) + size <= last)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(n: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + size, -1)
    return np.cumsum(d[:-1]) > 0


def per_document(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte or word) in each document's range."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]
