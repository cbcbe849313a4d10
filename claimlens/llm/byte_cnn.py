"""Quality scores by a byte-level convolutional network, trained and run in numpy.

A document's bytes are embedded and met by learned filters (``width`` bytes, every second
position).  Each filter's largest answer in every overlapping chunk of ``chunk`` bytes is
kept; the chunks cover the whole document.  The means and the maxima over the chunks are
combined into one probability.

The filters are fitted by Adam on single chunks with their document's label, the
combination by logistic regression on documents, both on a bounded sample
(``Params.sample`` labelled ids in hash order; of a text longer than ``Params.sample_size``
characters evenly spaced pieces of that total).

A text is laid out with a block of zeros after it, so its score depends on its own bytes only.

Defined cases: a null or empty text is one chunk of padding and gets its score like any
other; without labelled rows of both kinds all scores are the share of label 1 (0.5
without any); repeated rows are scored each; an empty table gives no rows; labels, other
columns and the id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimlens.llm.common import each_batch, id_text, labelled_sample, map_arrow, text_chunks

_BLOCK = 64  # bytes whose answers are pooled first; a chunk is several blocks


@dataclass(frozen=True)
class Params:
    sample: int = 3000
    sample_size: int = 40_000
    chunk: int = 512
    overlap: int = 64
    width: int = 8
    depth: int = 6
    filters: int = 24
    steps: int = 900
    batch: int = 96
    seed: int = 29


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # (256, depth), double: sums then do not depend on what is computed beside them
    kernel: np.ndarray  # (width * depth, filters)
    bias: np.ndarray
    combine: np.ndarray  # constant, means, maxima


def _padded(data: np.ndarray, at: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text from a block's start on, zeros up to the next block and one block more; blocks of each text, and its first."""
    sizes = np.diff(at)
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    first = np.cumsum(blocks + 1) - (blocks + 1)
    out = np.zeros(int((blocks + 1).sum()) * _BLOCK + p.width, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * _BLOCK - at[:-1], sizes)] = data
    return out, blocks, first


def _windows(embedded: np.ndarray, p: Params) -> np.ndarray:
    rows = (len(embedded) - p.width) // 2
    strides = (2 * embedded.strides[0], embedded.strides[1])
    return np.lib.stride_tricks.as_strided(embedded, (rows, p.width * p.depth), strides, writeable=False)


def _block_answers(data: np.ndarray, model: Model, p: Params, at_once: int = 512) -> np.ndarray:
    """(blocks, filters): largest answer in each block."""
    count = (len(data) - p.width) // _BLOCK
    out = np.empty((count, model.kernel.shape[1]))
    whole = np.zeros(at_once * _BLOCK + p.width, np.uint8)  # always the same shape
    for first in range(0, count, at_once):
        n = min(at_once, count - first)
        whole[: n * _BLOCK + p.width] = data[first * _BLOCK : (first + n) * _BLOCK + p.width]
        answers = _windows(model.table[whole], p) @ model.kernel
        out[first : first + n] = answers.reshape(at_once, _BLOCK // 2, -1).max(axis=1)[:n]
    return np.maximum(out + model.bias, 0)


def features(data: np.ndarray, at: np.ndarray, model: Model, p: Params) -> np.ndarray:
    """(texts, 1 + 2 * filters): constant, mean and maximum over the chunks of each text."""
    padded, blocks, first = _padded(data, at, p)
    answers = _block_answers(padded, model, p)
    step, span = (p.chunk - p.overlap) // _BLOCK, p.chunk // _BLOCK
    chunks = np.maximum(1, -(-(blocks - p.overlap // _BLOCK) // step))
    text = np.repeat(np.arange(len(blocks)), chunks)
    own = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = np.repeat(first, chunks) + own * step
    end = np.minimum(begin + span, np.repeat(first + blocks, chunks))
    pooled = np.maximum.reduceat(answers, np.stack([begin, end], 1).ravel())[::2]
    starts = np.cumsum(chunks) - chunks
    mean = np.add.reduceat(pooled.astype(np.float64), starts) / chunks[:, None]
    return np.hstack([np.ones((len(blocks), 1)), mean, np.maximum.reduceat(pooled, starts)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (q - y) + 0.5 * w)
    return w


def fit_texts(texts: list[str], good: np.ndarray, p: Params = Params()) -> Model:
    rng = np.random.default_rng(p.seed)
    table = rng.normal(0, 0.5, (256, p.depth))
    kernel = rng.normal(0, (p.width * p.depth) ** -0.5, (p.width * p.depth, p.filters))
    bias, top, top_bias = np.zeros(p.filters), rng.normal(0, 0.1, p.filters), 0.0
    if not len(good) or good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        flat = np.zeros(1 + 2 * p.filters)
        flat[0] = 40 * (share - 0.5)
        return Model(table, kernel, bias, flat)
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    sides = [np.flatnonzero(good == k) for k in (False, True)]
    weights = [table, kernel, bias, top, np.array([top_bias])]
    slow, fast = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rows = p.chunk // 2
    for turn in range(1, p.steps + 1):
        picked = np.concatenate([rng.choice(s, p.batch // 2) for s in sides])
        y = good[picked].astype(float)
        data = np.zeros((p.batch, p.chunk + p.width), np.uint8)
        for k, doc in enumerate(picked):
            step = p.chunk - p.overlap
            begin = step * int(rng.integers(0, max(1, -(-(len(raw[doc]) - p.overlap) // step))))
            part = raw[doc][begin : begin + p.chunk + p.width]
            data[k, : len(part)] = part
        table, kernel, bias, top, _ = weights
        flat = table.astype(np.float32)[data.ravel()].reshape(p.batch, p.chunk + p.width, p.depth)
        strides = (flat.strides[0], 2 * flat.strides[1], flat.strides[2])
        windows = np.lib.stride_tricks.as_strided(flat, (p.batch, rows, p.width * p.depth), strides, writeable=False)
        answers = (windows.reshape(-1, p.width * p.depth) @ kernel.astype(np.float32)).reshape(p.batch, rows, -1)
        where = answers.argmax(axis=1)
        pooled = np.take_along_axis(answers, where[:, None, :], 1)[:, 0] + bias
        live = np.maximum(pooled, 0)
        q = 1 / (1 + np.exp(-np.clip(live @ top + weights[4][0], -30, 30)))
        miss = (q - y) / p.batch
        back = (miss[:, None] * top) * (pooled > 0)
        seen = windows[np.arange(p.batch)[:, None], where]  # (batch, filters, width * depth)
        g_kernel = np.einsum("bf,bfk->kf", back, seen)
        g_table = np.zeros_like(table)
        at = where[:, :, None] * 2 + np.arange(p.width)
        bytes_at = data[np.arange(p.batch)[:, None, None], at]
        g_seen = (back[:, :, None] * kernel.T[None]).reshape(p.batch, p.filters, p.width, p.depth)
        np.add.at(g_table, bytes_at.ravel(), g_seen.reshape(-1, p.depth))
        grads = [g_table, g_kernel, back.sum(0), live.T @ miss + 1e-4 * top, np.array([miss.sum()])]
        for k, g in enumerate(grads):
            slow[k] = 0.9 * slow[k] + 0.1 * g
            fast[k] = 0.999 * fast[k] + 0.001 * g * g
            weights[k] = weights[k] - 0.01 * (slow[k] / (1 - 0.9**turn)) / (np.sqrt(fast[k] / (1 - 0.999**turn)) + 1e-8)
    table, kernel, bias = weights[:3]
    model = Model(table, kernel, bias, np.zeros(1 + 2 * p.filters))
    x = np.vstack([features(r, np.array([0, len(r)]), model, p) for r in raw])
    return Model(table, kernel, bias, _logistic(x, good.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), label: str = "quality") -> Model:
    """A model from labelled documents; ``labels`` has doc_id and ``label`` (0 or 1, others are left out)."""
    return fit_texts(*labelled_sample(docs, labels, label, p.sample, p.sample_size, p.seed), p)


def _scores(column: pa.Array, model: Model, p: Params) -> pa.Array:
    out = []
    for _, _, data, at in text_chunks(column):
        z = features(data, at, model, p) @ model.combine
        out.append(np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 12))
    return pa.array(np.concatenate(out) if out else np.zeros(0))


def score(docs: DataFrame, model: Model, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            columns = [batch.column("doc_id"), _scores(batch.column("text"), model, p)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score"])

    return map_arrow(id_text(docs, doc_id, text), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, p: Params = Params(), least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all columns as they were."""
    place = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            kept = np.asarray(_scores(batch.column(place), model, p)) >= least
            yield batch.filter(pa.array(kept))

    return map_arrow(docs, run, schema)
