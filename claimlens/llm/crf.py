"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Fit, on a bounded sample of labelled documents (``Params.sample`` ids in hash order; of a
text longer than ``Params.sample_size`` characters evenly spaced pieces of that total):

1. Tokens are runs of letters, lower-cased.  Words and word beginnings that explain the
   toxic documents (in turn the one in most toxic documents not yet explained) label the
   tokens of the sample, until every toxic document is explained or no useful one is left.
   Useful are those rare in the other documents and in so many toxic ones that chance
   would hardly have it (binomial tails, with a bound on the share of false discoveries among
   all words looked at).
2. The field has two states; its features are the token's word, its first four and five
   bytes, the words before and after it and a bias, hashed to ``Params.buckets``;
   transitions are free.  Sentences
   (cut at . ! ? and line ends) are the chains.  Weights are fitted by Adagrad on the
   log-likelihood, whose gradient comes from forward-backward marginals.
3. A logistic function of the largest marginal and of the number of toxic tokens, fitted
   on the document labels, is the score.

Scoring runs in the tasks over whole texts.  Spans are runs of tokens with a marginal of
a half or more, as byte offsets into the UTF-8 text.

Defined cases: null, empty and letterless texts have no tokens and the lowest score of
the fit; without labelled rows of both kinds all scores are the share of label 1 (0 without
any); repeated rows are scored each; an empty table gives no rows; labels, other columns
and the id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimlens.llm import wordhash
from claimlens.llm.common import each_batch, id_text, labelled_sample, map_arrow, text_chunks


@dataclass(frozen=True)
class Params:
    sample: int = 4000
    sample_size: int = 60_000
    buckets: int = 1 << 16
    steps: int = 8
    least_documents: int = 3
    chance: float = 0.001
    """Expected share, among the words that may label, of those that fall on the documents at random."""
    precision: float = 0.95
    seed: int = 13


@dataclass(frozen=True)
class Model:
    unary: np.ndarray  # (features, buckets): score of state 1 over 0
    bias: float
    step: np.ndarray  # (2, 2) transition scores
    score: np.ndarray  # logistic weights: constant, logit of the largest marginal, log of the toxic tokens


_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?\n"]] = True


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, text, first byte, end byte and whether it starts a chain, of every token."""
    h, doc, first, end = wordhash.words(data, at, wordhash.NOT_LETTERS)
    new = np.ones(len(h), bool)
    if len(h):
        ends = np.cumsum(_ENDS[data])
        new[1:] = (doc[1:] != doc[:-1]) | (ends[first[1:]] != ends[first[:-1]])
    return h, doc, first, end, new


def _features(units: np.ndarray, new: np.ndarray, buckets: int) -> np.ndarray:
    """(features, tokens) buckets: units of the token, the words before and after; a missing one is bucket 0."""
    own = (units % np.uint64(buckets - 1)).astype(np.int32) + 1
    out = np.zeros((len(units) + 2, units.shape[1]), np.int32)
    out[: len(units)] = own
    out[-2, 1:] = np.where(new[1:], 0, own[0][:-1])
    out[-1, :-1] = np.where(new[1:], 0, own[0][1:])
    return out


def _units(h: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(3, tokens): hashes of the word and of its first four and five bytes."""
    return np.stack([h, wordhash.prefixes(data, first, end, 4), wordhash.prefixes(data, first, end, 5)])


def _energy(model_unary: np.ndarray, bias: float, features: np.ndarray) -> np.ndarray:
    out = np.full(features.shape[1], bias)
    for weights, at in zip(model_unary, features, strict=True):
        out += weights[at]
    return out


def _marginals(unary: np.ndarray, step: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of every token, and the expected transitions (2, 2) summed, by forward-backward.

    Chains run side by side, longest first, one step of all chains at a time.
    """
    n = len(unary)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right") if n else []
    t = np.exp(step)
    local = np.ones((n, 2))
    local[:, 1] = np.exp(np.clip(unary, -30, 30))
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    for k, m in enumerate(live):
        i = starts[:m] + k
        a = local[i] if k == 0 else (alpha[i - 1] @ t) * local[i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    for k in range(len(live) - 2, -1, -1):
        i = starts[: live[k + 1]] + k
        b = (beta[i + 1] * local[i + 1]) @ t.T
        beta[i] = b / b.sum(axis=1, keepdims=True)
    joint = alpha * beta
    p = joint[:, 1] / joint.sum(axis=1)
    inner, moves = np.flatnonzero(~new), np.zeros((2, 2))
    for k in range(0, len(inner), 1 << 16):
        i = inner[k : k + (1 << 16)]
        pair = alpha[i - 1][:, :, None] * t * (local[i] * beta[i])[:, None, :]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, moves


def _labels(units: np.ndarray, doc: np.ndarray, toxic: np.ndarray, p: Params) -> np.ndarray:
    """Whether each token has a unit that explains toxic documents."""
    cuts = [0, *np.searchsorted(doc, np.arange(256, len(toxic), 256)).tolist(), len(doc)]
    # texts side by side, some at a time, so that only distinct units are held for all of them
    pairs = [
        wordhash.distinct_per_text(units[:, a:b].ravel(), np.tile(doc[a:b], len(units))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]
    unit, at = np.unique(np.concatenate([u for u, _ in pairs]), return_inverse=True)
    where = np.concatenate([d for _, d in pairs])
    clean = np.bincount(at, ~toxic[where], len(unit)).astype(np.int64)
    dirty = np.bincount(at, toxic[where], len(unit)).astype(np.int64)
    seen = dirty + clean
    useful = (dirty >= p.precision * seen) & (dirty >= p.least_documents)
    tried = np.flatnonzero(useful)
    tails = np.array([_tail(int(dirty[k]), int(seen[k]), float(toxic.mean())) for k in tried])
    order = np.argsort(tails, kind="stable")
    bound = p.chance * np.arange(1, len(tried) + 1) / max(1, int((seen >= p.least_documents).sum()))
    passed = np.flatnonzero(tails[order] <= bound)
    useful[:] = False
    useful[tried[order[: passed[-1] + 1 if len(passed) else 0]]] = True
    rows = useful[at] & toxic[where]
    at, where = at[rows], where[rows]
    open_docs, chosen = toxic.copy(), []
    while len(at):
        gain = np.bincount(at, open_docs[where], len(unit))
        best = int(gain.argmax())
        if not gain[best]:
            break
        chosen.append(unit[best])
        open_docs[where[at == best]] = False
        rest = open_docs[where]
        at, where = at[rest], where[rest]
    chosen, out = np.sort(np.array(chosen, np.uint64)), np.zeros(units.shape[1], bool)
    for row in units if len(chosen) else ():
        out |= chosen[np.minimum(np.searchsorted(chosen, row), len(chosen) - 1)] == row
    return out


def _tail(hits: int, n: int, share: float) -> float:
    """P(at least ``hits`` of n documents are toxic)."""
    return sum(comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(hits, n + 1)) if n < 400 else float(hits < share * n)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (q - y) + 0.1 * w)
    return w


def _summary(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    top, many = np.full(n, 1e-6), np.zeros(n)
    np.maximum.at(top, doc, p)
    many += np.bincount(doc, np.where(p >= 0.5, p, 0), n)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(many)], 1)


def _sample_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, text and chain start of the tokens of all texts, hashed some texts at a time."""
    parts = []
    for a, _, data, at in text_chunks(pa.array(texts, pa.large_string())):
        h, doc, first, end, new = tokens(data, at)
        parts.append((_units(h, data, first, end), doc + a, new))
    return tuple(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))


def fit_texts(texts: list[str], toxic: np.ndarray, p: Params = Params()) -> Model:
    flat = Model(np.zeros((5, p.buckets), np.float32), 0.0, np.zeros((2, 2)), np.zeros(3))
    if not len(toxic) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(flat.unary, 0.0, flat.step, np.array([40 * (share - 0.5), 0, 0]))
    units, doc, new = _sample_tokens(texts)
    if not len(doc):
        return Model(flat.unary, 0.0, flat.step, np.array([np.log(toxic.mean() / (1 - toxic.mean())), 0, 0]))
    y = _labels(units, doc, toxic, p)
    features, n_units = _features(units, new, p.buckets), len(units)
    del units
    # start where the units alone would put the field, then fit all weights together
    share = y.mean()
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    unary, step = np.zeros((len(features), p.buckets)), np.zeros((2, 2))
    for k in range(n_units):
        hot, count = np.bincount(features[k], y, p.buckets), np.bincount(features[k], minlength=p.buckets)
        odds = (hot + 0.5 * share + 1e-6) / (count - hot + 0.5 * (1 - share) + 1e-6)
        unary[k] = np.where(count > 0, np.clip(np.log(odds) - bias, -9, 18), 0) / n_units
    seen_u, seen_s, seen_b = np.full_like(unary, 1e-6), np.full_like(step, 1e-6), 1e-6
    inside = np.flatnonzero(~new)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[inside - 1].astype(int), y[inside].astype(int)), 1)
    for _ in range(p.steps):
        q, expected = _marginals(_energy(unary, bias, features), step, new)
        miss = y - q
        for k in range(len(features)):
            g = np.bincount(features[k], miss, p.buckets) - 0.01 * unary[k]
            seen_u[k] += g * g
            unary[k] += (0.5 if k < n_units else 0.1) * g / np.sqrt(seen_u[k])
        g = observed - expected - 0.02 * step
        seen_s += g * g
        step += 0.1 * g / np.sqrt(seen_s)
        g = miss.sum()
        seen_b += g * g
        bias += 0.1 * g / np.sqrt(seen_b)
    q, _ = _marginals(_energy(unary, bias, features), step, new)
    weights = _logistic(_summary(q, doc, len(toxic)), toxic.astype(float))
    return Model(unary.astype(np.float32), float(bias), step, weights)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), label: str = "toxic") -> Model:
    """A model from labelled documents; ``labels`` has doc_id and ``label`` (0 or 1, others are left out)."""
    return fit_texts(*labelled_sample(docs, labels, label, p.sample, p.sample_size, p.seed), p)


def _scorer(model: Model):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            for first, end, data, at in text_chunks(batch.column("text")):
                n = end - first
                h, doc, start, stop, new = tokens(data, at)
                p = np.zeros(0)
                if len(h):
                    features = _features(_units(h, data, start, stop), new, model.unary.shape[1])
                    p, _ = _marginals(_energy(model.unary, model.bias, features), model.step, new)
                z = np.clip(_summary(p, doc, n) @ model.score, -40, 40)
                hot = np.flatnonzero(p >= 0.5)
                fresh = np.ones(len(hot), bool)
                fresh[1:] = (np.diff(hot) > 1) | new[hot[1:]]
                begin, finish = hot[fresh], hot[np.append(fresh[1:], True)[: len(hot)]]
                each = np.bincount(doc[begin], minlength=n)
                edges = pa.array(np.append(0, np.cumsum(each)), pa.int32())
                own = at[doc[begin]]
                sides = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (start[begin] - own, stop[finish] - own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(1 / (1 + np.exp(-z))), *sides],
                    names=["doc_id", "score", "span_starts", "span_ends"],
                )

    return score


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, span_starts, span_ends (byte offsets of toxic spans)."""
    schema = "doc_id long, score double, span_starts array<long>, span_ends array<long>"
    return map_arrow(id_text(docs, doc_id, text), _scorer(model), schema)
