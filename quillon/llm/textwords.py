"""Words of whole texts as numpy arrays: one pass over the Arrow buffers, no Python object a word.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII bytes of the
lower-cased UTF-8 text; all else separates. Of the scripts of East Asia that are written without spaces (code points
U+3000 to U+9FFF) each character is a word. Null and empty texts have no words. Hashes are
64-bit polynomial hashes of a word's bytes, finished with a mixer, so they depend on content
alone: equal on every executor, in every batch and in every run.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once: the arrays below then stay near the CPU caches.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def give_back() -> None:
    """Lets this process give the room of large arrays back as soon as they are freed.

    Workers stay for later tasks, and several share an executor's memory, so what one keeps to itself others lack. Where
    the C library has no such settings nothing changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    # Blocks from 1 MB on are maps of their own; the heap's free end is trimmed; threads share one heap.
    _allocate((-3, 1 << 20), (-1, 1 << 20), (-8, 1))


def _allocate(*settings: tuple[int, int]) -> None:
    try:
        mallopt = ctypes.CDLL(None).mallopt
        for what, value in settings:
            mallopt(what, value)
    except (OSError, AttributeError):
        pass


give_back()


@contextlib.contextmanager
def at_hand() -> Iterator[None]:
    """Meanwhile this process keeps up to 32 MB of what it frees: loops that make the same arrays again and again get no new pages each time."""
    _allocate((-3, 1 << 25), (-1, 1 << 25))
    try:
        yield
    finally:
        give_back()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse modulo 2**64, grown to the longest chunk seen."""

    def __init__(self) -> None:
        self.n = 0

    def need(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, CHUNK_BYTES + 2)
            self.up = _powers(_BASE, self.n)
            self.down = _powers(pow(_BASE, -1, 1 << 64), self.n)


_tables = _Tables()


class Words:
    """Words of some documents: ``hash`` of each, ``first`` (n + 1 offsets of the documents' words), byte spans."""

    __slots__ = ("hash", "first", "start", "end", "data")

    def __init__(self, hash_: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        self.hash, self.first, self.start, self.end, self.data = hash_, first, start, end, data

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array | pa.ChunkedArray, lower: bool = True, kind: pa.DataType = pa.large_string()) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) column and the offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, most: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes together; a longer document is a range of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Splits the documents at ``offsets`` of ``data`` (lower-cased UTF-8) and hashes their words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(offsets), np.int64), none, none, data)
    _tables.need(n + 1)
    inside = _IS_WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    # Lead bytes of U+3000 to U+9FFF: such a character opens a word, and what follows it opens one too.
    alone = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    if len(alone):
        opens[alone] = True
        closes[np.minimum(alone + 2, n - 1)] = True
        next_ = alone[alone + 3 < n] + 3
        opens[next_[inside[next_]]] = True
        before = alone[alone > 0] - 1
        closes[before[inside[before]]] = True
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * _tables.up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * _tables.down[start])
    return Words(hashes, np.searchsorted(start, offsets), start, end, data)


def split(column: pa.Array | pa.ChunkedArray):
    """Yields (first row, Words) for runs of rows of a string column."""
    data, offsets = buffers(column)
    for i, j in groups(offsets):
        yield i, words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_MULTIPLIERS = _powers(0xD6E8FEB86659FD93, 4097)[1:]


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on; positions run over document borders, so mask them. Shorter by n - 1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    if n <= 12:
        out = hashes[:m] * _MULTIPLIERS[0]
        for k in range(1, n):
            out = out + hashes[k : k + m] * _MULTIPLIERS[k]
        return mix(out)
    _tables.need(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * _tables.up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * _tables.down[:m])


def room(first: np.ndarray) -> np.ndarray:
    """For each word, how many words its document has from it on."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a two-dimensional uint8 array."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The inverse of :func:`binary`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[0] + len(column) * width].reshape(-1, width)
