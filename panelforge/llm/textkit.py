"""Vectorised text primitives on UTF-8 bytes, shared by the operators of this subpackage.

Everything works on one flat byte buffer plus document offsets, so a batch of documents is cut into
words, hashed and windowed by a few numpy passes instead of a Python loop over words.  Names of words and
windows are 64-bit and made by steps of multiplication, addition and shifts that don't commute, so that no
pattern of letters or words makes two of them alike; of n different strings two share a name with a
probability of about n*n / 2**65.  rolled() alone is a polynomial, for which such patterns exist: what it finds
must be compared byte by byte.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Python workers are kept between tasks; blocks of 2 MB or more go back to the system as soon as they are free
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):
    _LIBC = ctypes.CDLL(None)
    _LIBC.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD of glibc
    _LIBC.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD: smaller blocks are not given back and faulted in again each time

U64 = np.uint64
#: Bytes that part words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part words where punctuation counts as white space: all ASCII but letters and digits.
MARKS = np.ones(256, bool)
MARKS[128:] = MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
#: A random odd number for each byte value, and the base of the rolling names with its inverse modulo 2**64.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
#: Multipliers of the names of strings, and masks for the first 0 to 8 bytes of a word of the machine.
_SIZE, _FIRST, _SECOND = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
#: Documents are handled about so many bytes at a time, as the arrays of a piece should fit the cache of a core
#: (512 KB took three times as long); strings beyond LONG bytes are named one by one.
PIECE, LONG = 1 << 17, 1024


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, PIECE + PIECE // 8)
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, U64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    off = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `limit` bytes (PIECE): first, last + 1, their bytes, their offsets."""
    at, n, limit = 0, len(off) - 1, limit or PIECE
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each document (one more at the end); space: the bytes that part words."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters of Latin-1, which UTF-8 writes as 0xC3 and a byte; lengths stay."""
    low = LOWER[buf]
    if len(buf) > 1:
        cap = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][cap] += 32
    return low


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running sums from which rolled() takes the name of any span."""
    c = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * powers(len(buf))[0], out=c[1:])
    return c


def rolled(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial names of the spans, from prefix(); equal names must be checked."""
    return mix((c[ends] - c[starts]) * powers(len(c))[1][starts] + (ends - starts).astype(U64))


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer (zeros beyond the end), one position more than bytes."""
    x = np.zeros(len(buf) + 8, np.uint8)
    x[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", x, 0, (1,)).astype(U64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs; the order counts."""
    h = a ^ (a >> U64(32))
    h *= _FIRST
    h += b
    h *= _SECOND
    return h


def name(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """64-bit names of the spans; equal bytes have equal names.  eight: eights(buf), if it is there already."""
    eight = eights(buf) if eight is None else eight
    size = ends - starts
    h = mix(size.astype(U64) * _SIZE ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    rest, step = np.flatnonzero(size > 8), 8
    while len(rest) and step < LONG:
        at = starts[rest] + step
        h[rest] = mix(joined(h[rest], eight[at] & _MASK[np.minimum(ends[rest] - at, 8)]))
        step += 8
        rest = rest[size[rest] > step]
    for k in rest.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def every(buf: np.ndarray, width: int) -> np.ndarray:
    """Names of the `width` bytes from each position on, by doubling; fewer bytes than `width`: none."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = eights(buf)[: max(n, len(buf) - 7)]
    if width < 8:
        return mix(h[:n] & _MASK[width])
    size = 8
    while size < width:
        step = min(size, width - size)
        h = joined(h[: len(h) - step], h[step:])
        size += step
    return mix(h)


def sequence(names: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1) -> np.ndarray:
    """Names of runs of names: `sizes` of them from each start on; step: every so many, and the last one in any case."""
    h = sizes.astype(U64) * _SIZE
    rows, k = np.flatnonzero(sizes > 0), 0
    while len(rows):
        at = np.minimum(k, sizes[rows] - 1)
        h[rows] = joined(h[rows], names[starts[rows] + at])
        rows = rows[at < sizes[rows] - 1]
        k += step
    return mix(h)


def grams(names: np.ndarray, n: int) -> np.ndarray:
    """Name of each run of n consecutive names; shorter than n: none."""
    m = max(0, len(names) - n + 1)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= U64(0xD6E8FEB86659FD93)
        out += names[k : k + m]
    return mix(out)


def in_document(first: np.ndarray, n: int) -> np.ndarray:
    """Of the runs of n items at each position, those that stay in one document; first: items before each document."""
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int32)
    lo, hi = first[:-1], np.maximum(first[1:] - n + 1, first[:-1])
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.cumsum(ok)[: max(0, total - n + 1)] > 0


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    m, size = a, 1
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the length at the end."""
    if len(values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length as one binary value."""
    n = len(next(iter(arrays.values())))
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def unpack(data, kinds: list) -> list[np.ndarray]:
    """The arrays of pack(), given their types in the same order."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [], 8
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def unpack_all(column, kinds: list) -> list[np.ndarray]:
    """unpack() of every value of a binary column, each array put together."""
    parts = [unpack(x.as_buffer(), kinds) for x in column]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal buckets together, and where each of the n begins (one more at the end)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
