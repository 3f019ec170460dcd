"""Word and word-pair features of many texts as CRC-32 buckets: array operations, no per-word Python."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

from parcelflow.llm.words import LOWER, chunks

#: Words over LONG bytes are hashed one by one; a text over PIECE bytes is looked at in pieces.
LONG, PIECE = 64, 4 << 20
#: Word bytes after lower-casing: digits, a to z and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each byte's remainder, and what m zero bytes make of each byte of a remainder, for m up to LONG."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    shifts = np.empty((LONG + 1, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for m in range(1, LONG + 1):
        shifts[m] = table[shifts[m - 1] & 255] ^ (shifts[m - 1] >> 8)
    return table, shifts


TABLE, SHIFTS = _steps()


def shifted(c: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """The checksums c with m zero bytes behind them, without their own contribution."""
    return SHIFTS[m, 0, c & 255] ^ SHIFTS[m, 1, (c >> 8) & 255] ^ SHIFTS[m, 2, (c >> 16) & 255] ^ SHIFTS[m, 3, c >> 24]


def word_checksums(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of buf, one byte of all words at a time, the longest first."""
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    at, size = starts[order], sizes[order]
    c = np.full(len(at), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-size, -LONG))  # words before are long
    for j in range(min(LONG, int(size[first])) if first < len(size) else 0):
        end = int(np.searchsorted(-size, -j))
        own = c[first:end]
        c[first:end] = TABLE[(own ^ buf[at[first:end] + j]) & 255] ^ (own >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        c[i] = zlib.crc32(buf[at[i] : at[i] + size[i]])
    out = np.empty_like(c)
    out[order] = c
    return out


def _pieces(raw: list[bytes]) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """(texts' places, pieces, whether the first word was counted before): texts many at once, a long text in pieces that share one word."""
    for begin, end in chunks(raw):
        if end - begin > 1 or len(raw[begin]) <= PIECE:
            yield list(range(begin, end)), raw[begin:end], False
            continue
        text, start, stop, again = raw[begin], 0, 0, False
        while stop < len(text):
            found = BREAK.search(text, stop + PIECE)
            stop = found.start() if found else len(text)
            yield [begin], [text[start:stop]], again
            body = LOWER[np.frombuffer(text, np.uint8, stop - start, start)]
            inner = np.flatnonzero(WORD[body])
            if len(inner):
                gap = np.flatnonzero(~WORD[body[: inner[-1]]])
                start, again = start + (int(gap[-1]) + 1 if len(gap) else 0), True
            else:
                start, again = stop, again and False


def features(raw: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets of features, the text each is of, words of each text), some texts at a time; a text may come several times.

    Words are runs of digits, a to z (A to Z lower-cased) and characters beyond ASCII. Features are the words and the pairs of
    neighbouring words joined by a space, repeats counted; a bucket is the CRC-32 of a feature's bytes modulo buckets.
    """
    blank = np.uint32(zlib.crc32(b" "))
    for places, texts, again in _pieces(raw):
        buf = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        word = WORD[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        starts, stops = edge[0::2], edge[1::2]  # the last byte is a break
        size = stops - starts
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        c = word_checksums(buf, starts, size)
        pair = np.flatnonzero(text[1:] == text[:-1])
        front, back = shifted(c[pair], 1) ^ blank, size[pair + 1]
        both = shifted(front, np.minimum(back, LONG)) ^ c[pair + 1]
        for i in np.flatnonzero(back > LONG):
            both[i] = zlib.crc32(buf[starts[pair[i] + 1] : stops[pair[i] + 1]], int(front[i]))
        own = slice(1, None) if again else slice(None)
        at = np.asarray(places)
        words = np.zeros(len(raw), np.int64)
        words[at] = np.bincount(text[own], minlength=len(texts))
        yield np.concatenate([c[own], both]) % np.uint32(buckets), at[np.concatenate([text[own], text[pair]])], words
