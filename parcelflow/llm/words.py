"""Vectorised words and word shingles of many texts: 64-bit rolling hashes in numpy, no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_pow[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _pow[k] = np.multiply.accumulate(steps)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole texts with about most bytes."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased, parted by space and \\t..\\r) and the offsets of each text's words."""
    buf = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)] if texts else np.zeros(0, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    word = ~SPACES[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[0::2], edge[1::2]
    if len(starts) > len(stops):
        stops = np.append(stops, len(word))
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    found = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return found, np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)


def shingles(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k-word shingle and the offsets of each text's shingles. Texts of 1 to k-1 words have one, of no word none."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    weight = powers(max(k, 2))[0]
    whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        whole += h[j : j + len(whole)] * weight[j]
    whole = mix(whole)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    out = np.empty(offsets[-1], np.uint64)
    doc = np.repeat(np.arange(len(n)), count)
    place = at[:-1][doc] + (np.arange(len(out)) - offsets[:-1][doc])
    full = (n >= k)[doc]
    out[full] = whole[place[full]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = h[at[d] : at[d + 1]]
        out[offsets[d]] = mix((own * weight[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, offsets
