"""Maximal repetitions of words, found as maximal pairs of the LCP-interval tree.

A run is a stretch of consecutive words with smallest period q, at least
``max(least_words, least_periods * q)`` long, that no neighbouring word extends.  With
start s and length n, the words from s and from s + q on agree for n - q words, differ
after them (right-maximal) and before them (left-maximal): the two places are a maximal
pair.  Conversely a maximal pair at distance q that agrees for l words, with l + q long
enough, spans a run, so runs need no extension step.

1. The suffixes of all texts of a chunk are sorted by prefix doubling.  Ranks begin with
   the text, so no two texts meet; only suffixes that still share their rank are sorted on.
2. Common prefixes of neighbours are read off the ranks of the doubling.
3. The tree of LCP intervals is walked bottom-up.  An interval holds the places where its
   words occur, in order, each with the class of the word on its left.  When a child joins,
   every place of the smaller list meets its neighbours in the larger one: that is where its
   pairs of another left class at a distance of at most l / (least_periods - 1) are.  (A
   nearer place would be an occurrence of the same words, thus a smaller period.)
4. Pairs with one start and end but different distances are one run; its smallest distance
   is the period.

Suffixes that have no place with the same first words close enough for their longest common
prefix are left out beforehand; they are in no pair that satisfies the constraints.

Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are.  Defined cases: a null, empty or
blank text has no words, no runs and an empty collapsed text; a text of any length is handled whole,
its memory grows with its words; repeated rows, equal and null ids give a row each; an
empty table gives no rows; columns beside id and text are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimlens.llm.common import each_batch, id_text, map_arrow, text_chunks

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass(frozen=True)
class Params:
    least_words: int = 6
    least_periods: int = 4

    @property
    def least_common(self) -> int:
        """The shortest common prefix that any run's pair has."""
        return min(self.length(q) - q for q in range(1, self.least_words + 1))

    def length(self, period: int) -> int:
        return max(self.least_words, self.least_periods * period)


class Suffixes:
    """Sorted suffixes of texts (words as numbers; ``text`` ascending): rank, and what prefix doubling knew."""

    def __init__(self, word: np.ndarray, text: np.ndarray):
        n = len(word)
        ends = np.searchsorted(text, text, "right")
        key = text * (int(word.max(initial=0)) + 1) + word
        order = np.argsort(key, kind="stable")
        _, head = np.unique(key[order], return_index=True)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.repeat(head, np.diff(np.append(head, n)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        step, live = 1, np.arange(n)
        while True:
            shared = np.bincount(self.rank[live], minlength=n)[self.rank[live]] > 1
            live = live[shared]
            if not len(live):
                break
            self.levels.append((live, self.rank[live]))
            after = live + step
            inside = after < ends[live]
            follow = np.zeros(len(live), np.int64)
            follow[inside] = self.rank[after[inside]] + 1
            old = self.rank[live]
            key = old * (n + 1) + follow
            order = np.argsort(key, kind="stable")
            key, old = key[order], old[order]
            at = np.arange(len(live))
            new_group, old_group = np.ones(len(live), bool), np.ones(len(live), bool)
            new_group[1:], old_group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
            begin = np.maximum.accumulate(np.where(new_group, at, 0))
            self.rank[live[order]] = old + begin - np.maximum.accumulate(np.where(old_group, at, 0))
            step *= 2

    def _known(self, level: int, at: np.ndarray) -> np.ndarray:
        places, ranks = self.levels[level]
        k = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[k] == at, ranks[k], -1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes from ``a`` and from ``b`` (other places) share at their start."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            left = self._known(level, a + out)
            out += ((left >= 0) & (left == self._known(level, b + out))).astype(np.int64) << level
        return out

    def neighbours(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``places`` in suffix order, and the common prefix of each with the one before (the first: 0)."""
        places = places[np.argsort(self.rank[places], kind="stable")]
        lcp = np.zeros(len(places), np.int64)
        if len(places) > 1:
            lcp[1:] = self.common(places[:-1], places[1:])
        return places, lcp


def _candidates(suffixes: Suffixes, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes, in order, that may be half of a pair, and their common prefixes."""
    level = p.least_common.bit_length() - 1
    none = np.zeros(0, np.int64)
    if len(suffixes.levels) <= level:
        return none, none
    places, ranks = suffixes.levels[level]  # first words that occur again
    order = np.lexsort((places, ranks))
    place, rank = places[order], ranks[order]
    far = np.iinfo(np.int64).max
    step = np.where(rank[1:] == rank[:-1], np.diff(place), far)
    near = np.minimum(np.append(far, step), np.append(step, far))
    distance = np.full(len(suffixes.rank), far)
    distance[place] = near
    places, lcp = suffixes.neighbours(places)
    best = np.maximum(lcp, np.append(lcp[1:], 0))
    good = (best >= p.least_common) & (distance[places] <= best // (p.least_periods - 1))
    return suffixes.neighbours(places[good])


def _join(one: list[int], two: list[int], lcp: int, left: np.ndarray, p: Params, out: dict[tuple[int, int], int]) -> list[int]:
    """The places of two children of an interval in one list; pairs between them go to ``out``: (start, length) to period."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    reach = lcp // (p.least_periods - 1)
    before = -1
    for x in small:
        k = bisect_left(large, x)
        for y in (large[k - 1] if k else before, large[k] if k < len(large) else before):
            if y == before:  # of the same child, or none
                continue
            period = abs(x - y)
            if period <= reach and left[x] != left[y]:
                length = lcp + period
                if length >= p.length(period):
                    key = (min(x, y), length)
                    out[key] = min(period, out.get(key, period))
        large.insert(k, x)
        before = x
    return large


def maximal_pairs(places: np.ndarray, lcp: np.ndarray, left: np.ndarray, p: Params) -> dict[tuple[int, int], int]:
    """(start, length) to period over the intervals of ``lcp``, walked bottom-up."""
    out: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, list[int]]] = []

    def close(down_to: int) -> None:
        """Close intervals until the innermost open one has a prefix of at most ``down_to``."""
        _, held = stack.pop()
        while stack and stack[-1][0] > down_to:
            size, other = stack.pop()
            held = _join(held, other, size, left, p, out)
        if down_to < p.least_common:
            stack.clear()
        elif stack and stack[-1][0] == down_to:
            _, other = stack.pop()
            stack.append((down_to, _join(held, other, down_to, left, p, out)))
        else:
            stack.append((down_to, held))

    leaf = int(lcp.max(initial=0)) + 1
    for place, size in zip(places.tolist(), lcp.tolist(), strict=True):
        if stack:
            close(size)
        stack.append((leaf, [place]))
    if stack:
        close(0)
    return out


def find_runs(texts: list[list[bytes]], p: Params = Params()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text (a list of words), sorted by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(word):
        return out
    first = np.cumsum(sizes) - sizes
    left = np.append(-1, word[:-1])
    left[first[sizes > 0]] = -1
    found = maximal_pairs(*_candidates(Suffixes(word, text), p), left, p)
    for (start, length), period in found.items():
        out[text[start]].append((int(start - first[text[start]]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run, or only in the first period of runs."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not gone]


def _finder(p: Params):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            for first, end, data, at in text_chunks(batch.column("text")):
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                found = find_runs(texts, p)
                sizes = [len(runs) for runs in found]
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                runs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=["start", "length", "period"])
                collapsed = [b" ".join(without_repeats(t, r)) for t, r in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), runs),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, in words, by start and period), collapsed: the text
    with each run cut down to its first period and single blanks between words."""
    return map_arrow(id_text(docs, doc_id, text), _finder(p), SCHEMA)
