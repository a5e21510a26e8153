"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on whole Arrow batches: the UTF-8 buffer of a string column is viewed
as one ``uint8`` array, words are found by byte masks and hashed eight bytes at a time,
so no Python loop runs per word.  Batches are cut into slices of about ``SLICE_BYTES`` of
text (one very long text is a slice of its own), which bounds the temporaries of a worker.

Two kinds of hashes: ``span_hashes`` of words, lines and strings, in which every eight
bytes are mixed in a keyed, nonlinear way; and rolling hashes over prefix sums
(``prefix_hash``), which are polynomials modulo 2**64 and so may agree on different
strings of great regularity: they only choose places, never say that strings are equal.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 600_000

_U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 2**64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

#: ``[\x20\x09-\x0D]`` as a byte mask.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def release_caches() -> None:
    """Frees what token encoders have cached in this worker, which may serve another operator now."""
    tokens = sys.modules.get("treegate.llm.tokens")
    if tokens is not None:
        tokens.encoders.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the public SplitMix64 generator, elementwise."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), SLICE_BYTES + 65_536)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.empty(size, np.uint64)
            p[0], filled, step = 1, 1, base
            while filled < size:
                take = min(filled, size - filled)
                p[filled : filled + take] = p[:take] * _U64(step)
                step = step * step % 2**64
                filled += take
            out.append(p)
        _pow, _inv = out
    return _pow[:n], _inv[:n]


def prefix_hash(codes: np.ndarray, family: int = 0) -> np.ndarray:
    """``out[i]``: sum of table[codes[j]] * base**j for j < i, modulo 2**64, with one of two tables."""
    p, _ = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_TABLES[family][codes] * p[: len(codes)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [starts, ends); equal bytes hash alike at any place."""
    _, inv = _powers(len(prefix))
    h = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U64(_MULT))


#: Spans over this many bytes are hashed one by one.
_LONG = 512
_KEYS = _rng.integers(0, 2**64, 2 + _LONG // 8, dtype=np.uint64) | np.uint64(1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends); equal bytes hash alike at any place."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    out = mix(left.astype(np.uint64) * _U64(_MULT) ^ _KEYS[0])
    far = np.flatnonzero(left > _LONG)
    at, live = starts, np.arange(len(starts))
    if len(far):
        data = memoryview(np.ascontiguousarray(buf))
        for i in far.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        live = np.flatnonzero(left <= _LONG)
        at, left = starts[live], left[live]
    turn = 1
    while len(live):
        word = eight[at]
        short = left < 8
        if short.any():
            word[short] &= (_U64(1) << (left[short] * 8).astype(np.uint64)) - _U64(1)
        out[live] = mix((out[live] ^ word) * _KEYS[turn])
        more = left > 8
        live, at, left, turn = live[more], at[more] + 8, left[more] - 8, turn + 1
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (length rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about ``limit`` bytes of ``column`` each: (rows, bytes, offsets)."""
    buf, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + 20_000)
        yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and per row the index of its first word (length rows + 1)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[:-1][offs[:-1] < offs[1:]]  # rows with text: words end where a row ends
    first[cut] = inside[cut]
    last[cut[1:] - 1] = inside[cut[1:] - 1]
    last[n - 1] = inside[n - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs, side="left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hashes(LOWER[buf] if lower else buf, starts, ends)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] at each i (all of one row): length max(0, len - k + 1)."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h * _U64(0xFF51AFD7ED558CCD) + words[j : j + n])
    return h


def row_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of one row; fewer words: the whole sequence as one; none: empty."""
    m = len(words)
    if m == 0:
        return words
    if m < k:
        return mix(shingle_hashes(words, m) + _U64(m))
    return np.unique(shingle_hashes(words, k))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
