"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. In each chunk learned filters slide over
learned byte vectors and are max-pooled; a text is the maximum and the mean of its chunks' pooled filters, and a
logistic layer turns these into one probability.

The network is fitted by Adam on the whole texts of a bounded sample of labelled rows (``TRAIN_ROWS``); every row's whole
text is scored in Arrow batches.

Defined results: null and empty texts count as one chunk of padding; rows are scored alone, so ties, repeated rows and
empty tables need no rule; without usable labels every score is the labels' share (0 without any); columns with an
output's name are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.textbytes import slices
from corpusloom.runtime import free_name, quoted

#: Bytes of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 256, 32
#: Bytes between filter positions, and bytes that a filter sees (twice the stride).
STRIDE = 4
VECTOR, FILTERS = 8, 32
#: Labelled rows used for fitting, at most.
TRAIN_ROWS = 4_000
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.006, 1e-4
#: Batches that fitting takes at least; a small sample is gone through more often.
LEAST_STEPS = 600
#: Chunks run at once.
AT_ONCE = 1024


@dataclass
class Network:
    vectors: np.ndarray  # (256, VECTOR)
    first: np.ndarray  # (STRIDE * VECTOR, FILTERS): a filter's first half
    second: np.ndarray  # and its second half
    shift: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (2 * FILTERS,)
    bias: np.ndarray  # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.first, self.second, self.shift, self.top, self.bias]

    def filtered(self, chunks: np.ndarray) -> np.ndarray:
        """Filter values (chunk, position, filter) of (n, CHUNK) bytes."""
        x = self.vectors[chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * VECTOR)
        return x[:, :-1] @ self.first + x[:, 1:] @ self.second + self.shift

    def peaks(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's best position in each chunk, and its rectified value there."""
        at, best = [], []
        for i in range(0, len(chunks), AT_ONCE):
            values = self.filtered(chunks[i : i + AT_ONCE])
            at.append(values.argmax(axis=1))
            best.append(np.maximum(np.take_along_axis(values, at[-1][:, None], 1)[:, 0], 0))
        return np.concatenate(at), np.concatenate(best)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """The max-pooled, rectified filters of each chunk."""
        parts = [np.maximum(self.filtered(chunks[i : i + AT_ONCE]).max(axis=1), 0) for i in range(0, len(chunks), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        chunks, first = chunked(buf, off)
        pooled = self.pooled(chunks)
        counts = np.diff(np.append(first, len(chunks)))[:, None]
        both = np.hstack([np.maximum.reduceat(pooled, first, axis=0), np.add.reduceat(pooled, first, axis=0) / counts])
        return 1 / (1 + np.exp(-np.clip(both.astype(np.float64) @ self.top + self.bias[0], -30, 30)))


def chunked(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, first chunk of each text): overlapping chunks over every byte, zero-padded; at least one each."""
    step = CHUNK - OVERLAP
    sizes = np.diff(off)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(sizes)), counts)
    start = off[:-1][text] + (np.arange(len(text)) - first[text]) * step
    padded = np.concatenate([buf, np.zeros(CHUNK, np.uint8)])
    chunks = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[start]
    beyond = np.flatnonzero(start + CHUNK > off[1:][text])
    if len(beyond):
        chunks[beyond] *= np.arange(CHUNK)[None, :] < (off[1:][text[beyond]] - start[beyond])[:, None]
    return chunks, first


def fit(samples: list[np.ndarray], labels: np.ndarray) -> Network:
    """Fit on each sample text's chunks (n, CHUNK) and its 0/1 label, in the order given."""
    rng = np.random.RandomState(23)
    f32 = lambda a: a.astype(np.float32)
    size = STRIDE * VECTOR
    net = Network(f32(rng.normal(0, 0.5, (256, VECTOR))), f32(rng.normal(0, size**-0.5, (size, FILTERS))), f32(rng.normal(0, size**-0.5, (size, FILTERS))), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), np.zeros(1, np.float32))
    share = float(np.mean(labels)) if len(labels) else 0.0
    if not 0 < share < 1:
        net.bias[:] = 30 if share else -30
        return net
    net.bias[:] = np.log(share / (1 - share))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(labels)))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        rate = RATE * (1 - epoch / epochs)
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            chunks = np.concatenate([samples[r] for r in rows])
            counts = np.array([len(samples[r]) for r in rows])
            first = np.cumsum(counts) - counts
            peak, pooled = net.peaks(chunks)
            highest = np.maximum.reduceat(pooled, first, axis=0)
            mean = np.add.reduceat(pooled, first, axis=0) / counts[:, None]
            both = np.hstack([highest, mean])
            wrong = f32((1 / (1 + np.exp(-np.clip(both @ net.top + net.bias[0], -30, 30))) - labels[rows]) / len(rows))
            grad_both = wrong[:, None] * net.top
            text = np.repeat(np.arange(len(rows)), counts)
            is_top = pooled == highest[text]
            grad_pooled = (grad_both[:, FILTERS:] / counts[:, None])[text] + grad_both[:, :FILTERS][text] * is_top
            grad_pooled *= pooled > 0
            n, k = np.nonzero(grad_pooled)
            g, at = grad_pooled[n, k], peak[n, k]
            grads = [np.zeros_like(p) for p in net.parameters()]
            order_k = np.argsort(k, kind="stable")
            n, k, g, at = n[order_k], k[order_k], g[order_k], at[order_k]
            cuts = np.searchsorted(k, np.arange(FILTERS + 1))
            grad_bytes = np.zeros((256, VECTOR), np.float64)
            for f in range(FILTERS):
                a, b = cuts[f], cuts[f + 1]
                if a == b:
                    continue
                for half, weights, shift in ((grads[1], net.first, 0), (grads[2], net.second, 1)):
                    spot = (at[a:b] + shift) * STRIDE
                    half[:, f] = g[a:b] @ net.vectors[chunks[n[a:b][:, None], spot[:, None] + np.arange(STRIDE)]].reshape(b - a, size)
                    for s in range(STRIDE):
                        byte_mass = np.bincount(chunks[n[a:b], spot + s], g[a:b], 256)
                        grad_bytes += byte_mass[:, None] * weights[s * VECTOR : (s + 1) * VECTOR, f]
            grads[0][:] = grad_bytes
            grads[3][:] = np.bincount(k, g, FILTERS)
            grads[4][:] = wrong @ both
            grads[5][:] = wrong.sum()
            step += 1
            for p, grad, (m, v) in zip(net.parameters(), grads, moments, strict=True):
                grad += DECAY * p
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= f32(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return net


def train(sample: DataFrame) -> Network:
    """Fit on a bounded (id, text, label) table; tasks send all chunks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                chunks, first = chunked(buf, off)
                bounds = np.append(first, len(chunks))
                taken = [chunks[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(taken, pa.binary())], names=["id", "label", "chunks"])

    rows = sample.select("id", "text", "label").mapInArrow(run, "id long, label int, chunks binary").toArrow().sort_by("id")
    return fit([np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, CHUNK) for c in rows["chunks"]], np.array(rows["label"], dtype=np.float32))


def score(docs: DataFrame, model: Network, text_col: str = "text", output: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add every whole text's score."""
    kept = [f for f in docs.schema.fields if (keep is None or f.name in keep) and f.name != output]
    source = docs.select(*(F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(kept)), F.col(quoted(text_col)).cast("string").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, buf, off in slices(batch.column(batch.num_columns - 1)):
                out[a:b] = model.scores(buf, off)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*(f.name for f in kept), output])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(output, T.DoubleType())]))


def keep_good(docs: DataFrame, model: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with the columns they came with."""
    name = free_name(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) >= threshold).select(*(F.col(quoted(c)) for c in docs.columns))
