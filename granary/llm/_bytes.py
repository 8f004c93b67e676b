"""Vectorised text primitives over Arrow buffers.

Texts stay UTF-8 bytes inside Arrow buffers; words, n-grams and their hashes are
found with numpy over slices of many documents at once, so no Python object is
made per word.  All hashes are fixed functions of the bytes: the same on every
executor and in every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 19
#: What a null id counts as where ids are compared: after every other id.
LAST_ID = (1 << 63) - 1

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
#: Spans are hashed modulo this Mersenne prime: unequal spans of n values collide with a probability of n / 2**61.
PRIME = (1 << 61) - 1
_BASE = {0: 0x0FB21C651E98DF25, 1: 0x16E8FEB86659FD93}
_P, _M31, _M30 = _U(PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return x - _P * (x >= _P)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    a1, a0, b1, b0 = a >> _U(31), a & _M31, b >> _U(31), b & _M31
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << _U(1)) + (middle >> _U(30)) + ((middle & _M30) << _U(31)) + a0 * b0)


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo PRIME, for i below n."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(base, -1, PRIME) if inverse else base
        have = np.ones(1 << max(12, n.bit_length()), dtype=np.uint64)
        size = 1
        while size < len(have):
            have[size : size * 2] = _times(have[:size], _U(pow(b, size, PRIME)))
            size *= 2
        _powers[base, inverse] = have
    return have[:n]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end], by prefix sums of a polynomial modulo PRIME."""
    base, n = _BASE[seed], len(values)
    terms = _times(_reduced(values), _power(base, n))
    sums = np.zeros((2, n + 1), dtype=np.uint64)
    np.cumsum(terms & _M31, out=sums[0, 1:])
    np.cumsum(terms >> _U(31), out=sums[1, 1:])
    x, y = (s[end] - s[start] for s in sums)
    found = _times(_reduced(_reduced(x) + (y >> _U(30)) + ((y & _M30) << _U(31))), _power(base, n + 1, True)[start])
    return mix(found + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


_FOLD = {0: (0xAEF17502108EF2D9, 0x9FB21C651E98DF25), 1: (0xABC98388FB8FAC03, 0xD6E8FEB86659FD93)}
#: Places worked on at once, so that what a step makes stays in the processor's cache.
BLOCK = 1 << 15


def joined(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of pairs in order; not linear, so no structure of the values cancels out."""
    k1, k2 = map(_U, _FOLD[seed])
    x = b * k1
    x += a
    x ^= x >> _U(32)
    x *= k2
    return x


def _grams(values: np.ndarray, sizes: tuple[int, ...], seed: int) -> list[np.ndarray]:
    out, now, width = [], values, 1
    for n in sizes:
        while width * 2 <= n:
            now = joined(now[:-width], now[width:], seed)
            width *= 2
        out.append(mix(now) if n == 1 else now if width == n else joined(now[: len(values) - n + 1], now[n - width :], seed))
    return out


def grams_hashes(values: np.ndarray, sizes: tuple[int, ...], seed: int = 0) -> list[np.ndarray]:
    """For each of some sizes in ascending order, hashes of every so many values that follow each other.

    Runs of 1, 2, 4, ... values are joined in pairs; a size between is two runs that overlap.
    """
    out = [np.empty(max(0, len(values) - n + 1), dtype=np.uint64) for n in sizes]
    while len(values) < sizes[-1]:
        if len(sizes) == 1:
            return out
        return [*grams_hashes(values, sizes[:-1], seed), out[-1]]
    for k in range(0, len(values), BLOCK):
        part = values[k : k + BLOCK + sizes[-1] - 1]
        fit = tuple(n for n in sizes if n <= len(part))
        for full, found in zip(out, _grams(part, fit, seed) if fit else (), strict=False):
            full[k : k + BLOCK] = found[:BLOCK]
    return out


def grams_hash(values: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of every n values that follow each other."""
    return grams_hashes(values, (n,), seed)[0]


def rows_hash(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the rows of a matrix."""
    while values.shape[1] > 1:
        odd = values[:, -1:] if values.shape[1] % 2 else values[:, :0]
        even = values[:, : values.shape[1] - odd.shape[1]]
        values = np.hstack([joined(even[:, 0::2], even[:, 1::2], seed), odd])
    return values[:, 0]


def lean(task: Callable) -> Callable:
    """The task of a mapInArrow, after which the worker gives free memory back: workers stay between tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            for key in [k for k, have in _powers.items() if len(have) > 2 * SLICE_BYTES]:
                del _powers[key]
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def sliding_anchor(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes, the position of the least (the leftmost of equals).

    Equal runs choose the same place within them, whatever stands around.
    """
    n = len(hashes) - width + 1
    out = np.empty(max(0, n), dtype=np.int64)
    for k in range(0, n, BLOCK):
        part = hashes[k : k + BLOCK + width - 1]
        least = (part & _U(0xFFFFFFFF00000000)) | np.arange(k, k + len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        out[k : k + BLOCK] = least & _U(0xFFFFFFFF)
    return out


def byte_table(separators: bytes) -> np.ndarray:
    """Which bytes belong to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of text whose A-Z are lower-cased
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; words end with their document."""
    if not len(data):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    is_word = inside[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = is_word[cut]
    last[cut - 1] = is_word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


#: Bytes up to which words are hashed side by side, eight bytes a step; longer ones are folded one by one.
LONG_WORD = 512
_FIRST = (np.uint64(2**64 - 1) >> (np.arange(8, -1, -1, dtype=np.uint64) * _U(8) % _U(64))) * (np.arange(9) > 0)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    padded = np.r_[data, np.zeros(8, dtype=np.uint8)]
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) + _U(seed << 32))
    use = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = start[use], size[use]
    while len(use):
        out[use] = joined(out[use], mix(eight[at] & _FIRST[np.minimum(left, 8)]), seed)
        going = left > 8
        use, at, left = use[going], at[going] + 8, left[going] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        word = np.zeros(-(-size[k] // 8) * 8, dtype=np.uint8)
        word[: size[k]] = data[start[k] : end[k]]
        out[k] = joined(out[k : k + 1], rows_hash(mix(word.view("<u8"))[None, :], seed), seed)[0]
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string or binary column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    buffers, n = column.buffers(), len(column)
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, dtype=np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, text: int = 1, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) of the batch with their bytes and the offsets into these."""
    data, offsets = text_buffers(batch.column(text))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def ids(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False))
