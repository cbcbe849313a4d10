"""64-bit hashes of the words of many texts at once, in numpy.

A word's hash is a polynomial over random byte values modulo 2**64, mixed at the
end.  Two different words, shingles or lines of this size share a hash with a
probability of about 2**-60; everything here takes equal hashes as equal words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
"""The bytes between words `[^\\x20\\x09-\\x0D]+`."""

NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = False
"""All ASCII but letters; every byte of a longer UTF-8 character counts as a letter."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES, lower: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, end byte) of every word; no word spans two texts."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, ends
    values = _BYTE.copy()
    if lower:
        values = values[LOWER]
    values[between] = 0
    terms = values[data]
    terms *= _power_table(_BASE, n)
    h = np.add.reduceat(terms, starts) * _power_table(_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, "right") - 1, starts, ends


def prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of every word (of a shorter word: all), without case."""
    values, h = _BYTE[LOWER], np.full(len(starts), size, np.uint64)
    for k in range(size):
        has = starts + k < ends
        h = np.where(has, h * _U(_BASE) + values[data[np.where(has, starts + k, 0)]], h)
    return mix(h)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text number) of each run of ``width`` words; a shorter text is one shingle."""
    per = np.bincount(doc, minlength=n_docs)
    count = len(h)
    out = mix(h + _U(1))
    full = np.zeros(count, np.uint64)
    if count >= width:
        for k in range(width):
            full[: count - width + 1] = mix(full[: count - width + 1] * _U(3) + out[k : count - width + 1 + k])
    left = (np.cumsum(per)[doc] - np.arange(count)) if count else np.zeros(0, np.int64)
    good = left >= width
    short = np.flatnonzero((per > 0) & (per < width))
    begin = np.cumsum(per) - per
    extra = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = per[short] > k
        at = np.where(has, begin[short] + k, 0)
        extra = np.where(has, mix(extra * _U(5) + out[at] if count else extra), extra)
    sh, d = np.concatenate([full[good], extra]), np.concatenate([doc[good], short])
    if len(short):
        order = np.argsort(d, kind="stable")
        sh, d = sh[order], d[order]
    return sh, d


def distinct_per_text(sh: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs without repeats, sorted by text and hash."""
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], doc[new]
