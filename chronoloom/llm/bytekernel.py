"""Vectorised kernels over the UTF-8 buffers of Arrow text columns.

Texts are never turned into Python strings here: a batch is one byte array plus document
offsets, and words, hashes and windows are index arrays into it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that the kernels hold in index arrays at once.
CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULT = U64(0x9E3779B97F4A7C15)
_MIX = U64(0xD6E8FEB86659FD93)
#: An odd base and its inverse modulo 2**64, for polynomial hashes by prefix sums.
_BASE = 0xB5297A4D3F84D5B5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * _MIX
    h = h ^ (h >> U64(32))
    h = h * _MIX
    return h ^ (h >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n (kept between calls)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of whole documents of about ``limit`` bytes; a longer document is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def release_memory() -> None:
    """Give freed memory back: Python workers live on between stages, and each would keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Words(NamedTuple):
    lower: np.ndarray  # the bytes, A-Z lower-cased
    space: np.ndarray
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are the runs ``[^\\x20\\x09-\\x0D]+``; none crosses a document."""
    lower = _LOWER[data]
    space = _SPACE[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(lower, space, z, z, np.zeros(len(offsets), np.int64))
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(lower, space, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of ``data``, by prefix sums of a polynomial in an odd base."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_BASE_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def shingle_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words (length len - size + 1), document edges ignored."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * _MULT + word_hash[j : j + n]
    return mix(h + U64(size))


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte spans at once: spans of one length are hashed together, lane by lane."""
    out = np.empty(len(starts), dtype=np.uint64)
    pad = np.zeros(len(data) + 8, dtype=np.uint8)
    pad[: len(data)] = data
    lane8 = np.ndarray((len(data) + 1,), dtype="<u8", buffer=pad, strides=(1,))
    lane4 = np.ndarray((len(data) + 5,), dtype="<u4", buffer=pad, strides=(1,))
    order = np.argsort(lens.astype(np.uint16) if len(lens) and lens.max() < 65536 else lens, kind="stable")
    sorted_lens = lens[order]
    cuts = np.flatnonzero(np.diff(sorted_lens)) + 1
    s64 = U64(seed)
    for idx in np.split(order, cuts):
        if not len(idx):
            continue
        length, p = int(lens[idx[0]]), starts[idx].copy()
        left = length
        if length >= 32:
            with np.errstate(over="ignore"):
                v = [np.full(len(idx), x, dtype=np.uint64) for x in (s64 + _P1 + _P2, s64 + _P2, s64, s64 - _P1)]
            while left >= 32:
                for k in range(4):
                    v[k] = _rotl(v[k] + lane8[p + 8 * k] * _P2, 31) * _P1
                p += 32
                left -= 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                h = (h ^ (_rotl(v[k] * _P2, 31) * _P1)) * _P1 + _P4
        else:
            with np.errstate(over="ignore"):
                h = np.full(len(idx), s64 + _P5, dtype=np.uint64)
        h = h + U64(length)
        while left >= 8:
            h = _rotl(h ^ (_rotl(lane8[p] * _P2, 31) * _P1), 27) * _P1 + _P4
            p += 8
            left -= 8
        if left >= 4:
            h = _rotl(h ^ (lane4[p].astype(np.uint64) * _P1), 23) * _P2 + _P3
            p += 4
            left -= 4
        while left:
            h = _rotl(h ^ (pad[p].astype(np.uint64) * _P5), 11) * _P1
            p += 1
            left -= 1
        h = (h ^ (h >> U64(33))) * _P2
        h = (h ^ (h >> U64(29))) * _P3
        out[idx] = h ^ (h >> U64(32))
    return out


_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).copy().view("<u8").ravel()


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each segment [first[i], first[i+1]) of hashes, how many have each of the 64 bits set."""
    n_seg = len(first) - 1
    out = np.zeros((n_seg, 64), dtype=np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    # sums of at most 255 hashes fit in a byte, eight bits of the hash side by side in one word
    cuts = [np.arange(a, b, 255) for a, b in zip(first[full], first[full + 1], strict=True)]
    owner = np.repeat(np.arange(len(full)), [len(c) for c in cuts])
    at = np.concatenate(cuts)
    lo, hi = first[full[0]], first[full[-1] + 1]
    raw = hashes[lo:hi].view(np.uint8).reshape(-1, 8)
    group = np.searchsorted(owner, np.arange(len(full)))
    for k in range(8):
        part = np.add.reduceat(_SPREAD[raw[:, k]], at - lo)
        out[full, 8 * k : 8 * k + 8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
    return out


def simhash_bits(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints from bit counts: a bit is 1 if set in over half of the n hashes."""
    ones = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").copy().view("<u8").ravel()
