"""Word and shingle hashes of whole texts, computed over byte buffers with numpy.

A batch of texts is cut into pieces of about 128 KB at word ends, so memory is bounded whatever the length
of a text, and each piece is hashed without a Python loop over its words: with `S` the running sum of
`code[byte] * P**i` modulo 2**64, the word between `s` and `e` has the hash `(S[e] - S[s]) * P**-s`, which is
then mixed. Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 1 << 17
_P = 0x9E3779B97F4A7C15 | 1
_M = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def _table(separators) -> bytes:
    return bytes(32 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: words [^\x20\x09-\x0D]+, A-Z lowered
SPACED = _table({32, *range(9, 14)})
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lowered
ALNUM = _table({*range(0, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """`n` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P) + np.uint64(seed))


_CODE = stream(11, 256)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below `n`; kept for pieces of the usual size only."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, PIECE + (PIECE >> 3))
    made = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    if size <= 4 * PIECE:
        _powers[:] = made
    return made[0], made[1]


def _hash_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a piece in which every separator is a space."""
    raw = np.frombuffer(piece, np.uint8)
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.not_equal(raw, 32, out=inside[1:-1].view(np.bool_))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    power, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    values = _CODE[raw]
    values *= power[: len(raw)]
    np.cumsum(values, out=sums[1:])
    found = sums[ends]
    found -= sums[starts]
    found *= inverse[starts]
    found += (ends - starts).astype(np.uint64)
    return mix(found), starts


@dataclass
class Hashed:
    """Hashes of consecutive texts: text i has `values[offsets[i]:offsets[i + 1]]`."""

    values: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i] : self.offsets[i + 1]]


def _long_text(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        parts.append(_hash_piece(data[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def hash_words(texts: list[bytes]) -> Hashed:
    """Word hashes of translated texts (see `SPACED` and `ALNUM`), group after group of about `PIECE` bytes."""
    values, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            data = b" ".join(texts[i] for i in group)
            found, starts = _hash_piece(data)
            bounds = np.cumsum([len(texts[i]) + 1 for i in group])
            counts[group] = np.diff(np.searchsorted(starts, bounds), prepend=0)
            values.append(found)
        group, size = [], 0

    with np.errstate(over="ignore"):
        for i, data in enumerate(texts):
            if len(data) > PIECE:
                flush()
                found = _long_text(data)
                counts[i] = len(found)
                values.append(found)
                continue
            if size + len(data) > PIECE:
                flush()
            group.append(i)
            size += len(data) + 1
        flush()
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return Hashed(np.concatenate(values) if values else np.empty(0, np.uint64), offsets)


def _fold(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of `k` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for j in range(1, k):
        total *= np.uint64(_M)
        total += words[j : j + n]
    total += np.uint64(k)
    return mix(total)


def runs(words: Hashed, k: int) -> Hashed:
    """Hash of every run of `k` consecutive words of each text; a text of fewer words has none."""
    with np.errstate(over="ignore"):
        rolled = _fold(words.values, k)
    counts = np.maximum(words.counts() - (k - 1), 0)
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], counts)
    return Hashed(rolled[at], offsets)


def shingles(words: Hashed, k: int) -> Hashed:
    """As `runs`, but a text of 1 to k - 1 words has one shingle, its whole sequence."""
    full, n = runs(words, k), words.counts()
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return full
    counts = full.counts()
    counts[short] = 1
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    values = np.empty(offsets[-1], np.uint64)
    taken = np.ones(offsets[-1], np.bool_)
    taken[offsets[short]] = False
    values[taken] = full.values
    with np.errstate(over="ignore"):
        for i in short:
            values[offsets[i]] = _fold(words.of(i), int(n[i]))[0]
    return Hashed(values, offsets)


def encoded(texts, table: bytes) -> list[bytes]:
    """UTF-8 of the texts with separators as spaces; null is empty."""
    return [t.encode().translate(table) if t is not None else b"" for t in texts]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
