"""Words of many texts at once: numpy finds their bounds in UTF-8 and gives each a 64-bit hash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from flowsift.llm.common import by_value

_rng = np.random.default_rng(20240229)
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
VALUES = _rng.integers(1, 2**63, 256, np.int64).astype(np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words between characters that are neither digits, letters nor beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: bytes of words between white space
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span ``values[start:end]`` of 64-bit values; spans don't overlap and aren't empty."""
    lens = ends - starts
    at = np.cumsum(lens) - lens
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.uint64)
    inside = np.arange(total, dtype=np.int64) - np.repeat(at, lens)
    picked = values if total == len(values) else values[inside + np.repeat(starts, lens)]
    weights = POWERS[inside & 4095]
    if lens.max() > len(POWERS):  # blocks of a long span have weights of their own, so their order counts
        block = (inside >> 12).astype(np.uint64)
        weights = weights * np.where(block > 0, mix(block) | np.uint64(1), np.uint64(1))
    sums = np.add.reduceat(picked * weights, at)
    return mix(sums + lens.astype(np.uint64))


@dataclass
class Words:
    """Words of a run of texts; those of text ``i`` are ``first[i]:first[i + 1]``."""

    data: np.ndarray  # lower-cased bytes of all texts, a space after each
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(texts: list[str], kind: np.ndarray) -> Words:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    inside = kind[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    hashes = span_hashes(VALUES[data], starts, ends)
    return Words(data, starts, ends, np.searchsorted(starts, bounds), hashes)


by_value(__name__)
