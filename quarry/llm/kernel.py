"""Vectorised text kernels: words, lines and n-word windows of whole Arrow text columns.

A block of texts is one UTF-8 byte buffer with offsets. Words are found by byte class and
hashed by a polynomial over random byte values (mod 2^64, then mixed), windows by the same
rolling scheme over word hashes, all with numpy over the buffer and no loop per text.
Bytes are walked in slices of about ``SLICE`` bytes cut at separators, so the working set
does not depend on the length of a text, only its word arrays do (about 4 bytes per byte).
"""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20          # bytes hashed at a time
BLOCK_BYTES = 4 << 20   # bytes of text that a task treats as one block
BLOCK_ROWS = 2048        # rows of a block at most
SMALL = {"rows": 1024, "size": 2 << 20}     # of blocks whose work needs many arrays, and whose results don't depend on the block


def _give_back() -> None:
    """glibc keeps freed arrays of up to 32 MB in the process, so a worker that serves several
    operators would hold the largest of each. Arrays of 2 MB and more go back to the system instead,
    and so do Arrow's, which its own pool would keep."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 2 << 20)      # M_MMAP_THRESHOLD
    except (AttributeError, OSError):               # another C library
        pass


_give_back()

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)  # odd, so invertible mod 2^64
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

SPACE = np.zeros(256, bool)          # separators of the rule [^\x20\x09-\x0D]+
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.ones(256, bool)       # separators of the rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower case
NON_ALNUM[0x80:] = False
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x41:0x5B] = False
NON_ALNUM[0x61:0x7B] = False
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_FOLDED_VALUE = _BYTE_VALUE[_LOWER]  # A-Z count as a-z


def _inverse(a: np.uint64) -> np.uint64:
    return _U(pow(int(a), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept for the process and grown on demand."""
    got = _POWERS.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = _POWERS[int(base)] = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Texts:
    """Texts of a block: bytes, byte offsets (n + 1) and which were null."""

    buf: np.ndarray
    off: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


@dataclass
class Words:
    """Words of a block in text order: hash, text number, first byte; ``first`` is the word
    number at which each text begins (n + 1); ``end`` is the byte after the word, on demand."""

    h: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    first: np.ndarray
    end: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """View of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    null = np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), bool)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if offsets is not None else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(buf[off[0]:off[-1]], off - off[0], null)


def _cuts(sep_at: Callable[[int, int], np.ndarray], size: int) -> Iterator[tuple[int, int]]:
    """Slices of the buffer that begin at 0 or at a separator."""
    lo = 0
    while lo < size:
        hi, step = min(lo + SLICE, size), SLICE
        while hi < size:
            found = np.flatnonzero(sep_at(max(lo + 1, hi - step), hi))
            if len(found):
                hi = max(lo + 1, hi - step) + int(found[-1])
                break
            hi, step = min(hi + SLICE, size), SLICE  # a word longer than a slice: look further on
        yield lo, hi
        lo = hi


def words(t: Texts, separator: np.ndarray = SPACE, fold: bool = False, ends: bool = False) -> Words:
    """Words of every text: maximal runs of bytes that are no separator. ``fold`` hashes A-Z
    as a-z. Equal words have equal hashes."""
    value = (_FOLDED_VALUE if fold else _BYTE_VALUE).copy()
    value[separator] = 0
    n, size = len(t), len(t.buf)
    begins = np.zeros(size + 1, bool)
    begins[t.off[:-1]] = True
    hs, starts, stops = [], [], []
    for lo, hi in _cuts(lambda a, b: separator[t.buf[a:b]] | begins[a:b], size):
        part = t.buf[lo:hi]
        solid = ~separator[part]
        is_start = solid.copy()
        is_start[1:] &= ~solid[:-1] | begins[lo + 1:hi]
        at = np.flatnonzero(is_start)
        if len(at):
            v = value[part]
            v *= powers(_BASE, len(part))
            h = np.add.reduceat(v, at)
            h *= powers(_inverse(_BASE), len(part))[at]
            hs.append(mix(h))
            starts.append(at + lo)
            if ends:
                is_end = solid.copy()
                is_end[:-1] &= ~solid[1:] | begins[lo + 1:hi]
                stops.append(np.flatnonzero(is_end) + lo + 1)
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.searchsorted(start, t.off)
    end = (np.concatenate(stops) if stops else np.zeros(0, np.int64)) if ends else None
    return Words(h, np.repeat(np.arange(n), np.diff(first)), start, first, end)


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray, sep: int = 0x0A) -> np.ndarray:
    """The byte ranges one after another, each followed by `sep`."""
    size = end - start + 1
    last = np.cumsum(size)
    at = np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - size), size)
    out = buf[np.minimum(at, len(buf) - 1)] if len(at) else np.zeros(0, np.uint8)
    out[last - 1] = sep
    return out


def lines(t: Texts) -> Words:
    """The \\n-split lines that have at least one byte, as hashes of all their bytes (spaces
    included)."""
    return words(t, NEWLINE)


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) hashes of every ``n`` consecutive words of one text: the positions
    of their first words in ``h`` and the hashes, in order."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_STEP, len(h)), out=total[1:])
    at = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1])
    roll = total[n:] - total[:-n]
    roll *= powers(_inverse(_STEP), len(roll))
    return at, mix(roll[at])


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each word, or byte) over the ranges first[i]:first[i+1]."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def covered(at: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Mask of ``size`` positions that lie in any of the ranges at[i] : at[i] + length."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which beats numpy's hashing here)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.diff(np.concatenate([at, [len(sorted_keys)]]))


def blocks(batches: Iterable[pa.RecordBatch], text: str,
           rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup a task's Arrow batches into tables of at most ``rows`` rows and about ``size``
    bytes of ``text`` (one longer text makes a block of its own)."""
    held: list[pa.Table] = []
    n = b = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        length = pc.fill_null(pc.binary_length(table.column(text)), 0).to_numpy()
        total = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        lo = 0
        while lo < len(length):
            room = int(np.searchsorted(total, total[lo] + max(0, size - b), "right")) - 1
            hi = min(max(room, lo + (n == 0)), lo + rows - n, len(length))
            if hi > lo:
                held.append(table.slice(lo, hi - lo))
                n, b, lo = n + hi - lo, b + int(total[hi] - total[lo]), hi
            if lo < len(length) or n >= rows:
                yield pa.concat_tables(held).combine_chunks()
                held, n, b = [], 0, 0
    if n:
        yield pa.concat_tables(held).combine_chunks()
