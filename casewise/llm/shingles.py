"""Words and five-word shingles of whole texts as 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
CHUNK_BYTES = 1 << 20
SET_CHUNK = 1 << 18  # for sets: a dozen 64-bit numbers a character are held

# White space between words (blank, tab, line feed, vertical tab, form feed, carriage return).
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z count as a-z
_LETTERS[_SPACE] = 0
_PLACES = mix(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        n = max(size, min(1 << size.bit_length(), 2 * CHUNK_BYTES))
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, factor, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"][:size], _powers["down"][:size]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and end byte of every word; bytes count from the start of the joined texts."""
    joined = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-8") or b"\n", np.uint8)
    space = _SPACE[joined]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_table(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_LETTERS[joined] * up[:-1], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    sizes = np.array([len((t or "").encode("utf-8")) + 1 for t in texts], np.int64)
    return hashes, np.searchsorted(np.cumsum(sizes), starts, side="right"), starts, stops


def combine(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words within a text, and where each begins; a shorter text is one run."""
    if not len(hashes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    padded = np.concatenate([hashes, np.zeros(WORDS - 1, np.uint64)])
    owners = np.concatenate([owner, np.full(WORDS - 1, -1)])
    n = len(hashes)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    total, length = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(WORDS):
        inside = owners[k : n + k] == owner
        total += np.where(inside, padded[k : n + k] * _PLACES[k], np.uint64(0))
        length += inside
    at = np.flatnonzero((length == WORDS) | first)
    return mix(total[at] + length[at].astype(np.uint64)), at


def chunks_of(texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """Consecutive texts of about ``limit`` characters together, with the number of the first."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t or "")
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in chunks_of(texts, SET_CHUNK):
        hashes, owner, _, _ = word_hashes(part)
        shingles, at = combine(hashes, owner)
        cuts = np.searchsorted(owner[at], np.arange(len(part) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield np.unique(shingles[a:b])
