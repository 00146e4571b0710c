"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of letters or digits in lower case. Texts are hashed whole, whatever their length: bytes are
read in pieces cut between words, so memory is bounded by the piece and not by the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

WORD = re.compile(r"[^\W_]+")
PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; another salt gives another independent hash."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, p)])) for p in (_P, _P_INV))
    return _powers


def _clean(text: str | None) -> bytes:
    """Lower-case bytes in which every byte of 128 and above belongs to a word."""
    text = (text or "").lower()
    return (text if text.isascii() else " ".join(WORD.findall(text))).encode()


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Lists of byte strings of about PIECE bytes together, each with the number of its text."""
    parts: list[bytes] = []
    owner: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        b = _clean(t)
        at = 0
        while at < len(b) or not at:
            end = min(len(b), at + PIECE)
            while at < end < len(b) and _IS_WORD[b[end]]:
                end += 1
            parts.append(b[at:end])
            owner.append(i)
            size += end - at
            at = max(end, 1)
            if size >= PIECE:
                yield parts, owner
                parts, owner, size = [], [], 0
    if parts:
        yield parts, owner


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order of the texts, and the number of words of each text; null counts as empty."""
    counts = np.zeros(len(texts), np.int64)
    out = [np.empty(0, np.uint64)]
    for parts, owner in _pieces(texts):
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        inside = _IS_WORD[data]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        per = np.diff(np.searchsorted(start, ends), prepend=0)
        np.add.at(counts, owner, per)
    return np.concatenate(out), counts


def grams(flat: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words within a text, and the text's number for each, in order."""
    n = len(flat)
    row = np.repeat(np.arange(len(counts)), counts)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ flat[j : n - k + 1 + j]) * _P
        h ^= h >> np.uint64(29)
    whole = row[: n - k + 1] == row[k - 1 :]
    return h[whole], row[: n - k + 1][whole]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, rows in order."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], row[first]


def batches(sizes: Sequence[int], limit: int = 4 << 20) -> Iterator[slice]:
    """Slices of consecutive rows of about ``limit`` units together, at least one row each."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))
