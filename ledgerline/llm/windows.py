"""Numpy kernels for repeated 400-byte windows (operator 9).

Positions are compared through anchors.  Every window of ``WINDOW`` bytes holds
``WINDOW - SEED + 1`` seeds of ``SEED`` bytes; the seed with the smallest hash
(the leftmost on ties) is the window's anchor.  Equal windows choose the same
anchor at the same offset, so only positions whose anchor seed is shared need
any further look.  Consecutive windows usually keep one anchor, so a document
gives about one row for every 170 bytes instead of one for each byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

WINDOW = 400
SEED = 64
#: Bytes handled at once, which bounds a task's memory; the low 24 bits of a key hold a position in the slice.
SLICE = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD1B54A32D192ED03 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LOW = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _rolling(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums whose differences give the hash of any substring."""
    power, inverse = _powers(base, SLICE + WINDOW + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * power[: len(data)], out=prefix[1:])
    return prefix, inverse


def _seed_hashes(prefix: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    h = (prefix[SEED:] - prefix[:-SEED]) * inverse[: len(prefix) - SEED]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, by block prefixes and suffixes."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[memoryview]):
    """(text index, seed hash, region hash, anchor, first window, last window) per anchor.

    A region is what its windows cover: bytes first to last + WINDOW.  Its hash
    includes where the anchor lies in it.  Texts longer than SLICE are cut into
    slices that overlap by WINDOW - 1 bytes; a region then ends at the cut.
    """
    out = ([], [], [], [], [], [])
    for group in _slices(texts):
        data = np.frombuffer(b"".join(t[a:b] for _, t, a, b in group), np.uint8)
        if len(data) < WINDOW:
            continue
        prefix, inverse = _rolling(data, _BASE)
        hashes = _seed_hashes(prefix, inverse)
        keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        best = (_sliding_min(keys, WINDOW - SEED + 1) & _LOW).astype(np.int64)
        at = 0
        for i, text, a, b in group:
            n = b - a - WINDOW + 1
            if n > 0:
                own = best[at : at + n]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                last = np.append(first[1:], n) - 1
                seed = own[first]
                region = [
                    xxhash.xxh3_64_intdigest(text[a + s : a + e + WINDOW], o)
                    for s, e, o in zip(first.tolist(), last.tolist(), (seed - at - first).tolist())
                ]
                out[0].append(np.full(len(first), i))
                out[1].append(hashes[seed].view(np.int64))
                out[2].append(np.array(region, np.uint64).view(np.int64))
                out[3].append(seed - at + a)
                out[4].append(first + a)
                out[5].append(last + a)
            at += b - a
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _slices(texts: list[memoryview]):
    """Groups of (index, text, start, end) of at most SLICE + WINDOW bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        a = 0
        while len(text) - a >= WINDOW:
            b = min(len(text), a + SLICE)
            if size + b - a > SLICE and group:
                yield group
                group, size = [], 0
            group.append((i, text, a, b))
            size += b - a
            if b == len(text):
                break
            a = b - WINDOW + 1
    if group:
        yield group


def core_rows(text: memoryview, place: int, block: int):
    """(block number, core hash, first window, last offset, bytes) for each block of a region's windows.

    A window's offset is how far it starts before the anchor; a block holds the
    windows of ``block`` offsets, and its core is what all of those cover.
    """
    first = place >> 24
    last, anchor = first + (place >> 12 & 0xFFF), first + (place & 0xFFF)
    for b in range((anchor - last) // block, (anchor - first) // block + 1):
        low, high = max(anchor - last, b * block), min(anchor - first, b * block + block - 1)
        core = text[anchor - b * block : anchor - (b * block + block - 1) + WINDOW]
        yield b, xxhash.xxh3_64_intdigest(core) - (1 << 63), anchor - high, high, bytes(text[anchor - high : anchor - low + WINDOW])


def window_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, window start, hash) for every window of short texts."""
    sizes = np.array([len(t) for t in texts])
    width = int(sizes.max())
    grid = np.zeros((len(texts), width), np.uint64)
    for row, t in zip(grid, texts):
        row[: len(t)] = np.frombuffer(t, np.uint8)
    mixed = None
    for base in (_BASE, _BASE2):
        power, inverse = _powers(base, 3 * WINDOW)
        prefix = np.zeros((len(texts), width + 1), np.uint64)
        np.cumsum(grid * power[:width], axis=1, out=prefix[:, 1:])
        h = (prefix[:, WINDOW:] - prefix[:, :-WINDOW]) * inverse[: width - WINDOW + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        mixed = h ^ h >> np.uint64(29) if mixed is None else mixed * np.uint64(3) ^ h
    member, start = np.nonzero(np.arange(width - WINDOW + 1) <= (sizes - WINDOW)[:, None])
    return member, start, mixed[member, start]
