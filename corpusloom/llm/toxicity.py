"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, A-Z lower-cased) and of their beginnings of 4 to 8 bytes,
which stand for stems, hashed into 2**31 bins. The score is the logistic of ``bias + sum w[i] + sum over pairs of <v[i], v[j]>``: pairs carry what linear weights can't, such as an
insult together with a group's name. Only bins whose presence goes with the label in the training sample have weights, so
that the many words seen once or twice add no noise, and other words hardly ever fall into their bins.

The model is fitted in numpy on a bounded sample of labelled rows (``TRAIN_ROWS``); every row's whole text is scored in
Arrow batches.

Defined results: null and empty texts have no terms and get the logistic of the bias; rows are scored alone, so ties,
repeated rows and empty tables need no rule; without usable labels every score is 0; columns with an output's name are
replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.textbytes import TERMS, run_hashes, runs, slices
from corpusloom.runtime import checkpointed, free_name, quoted

BINS = 1 << 31
STEMS = (4, 5, 6, 7, 8)
#: Low bits of a bin that are looked up first.
SIEVE_BITS = 18
#: Labelled rows used for fitting, at most.
TRAIN_ROWS = 6_000
#: Bins with weights, at most; the sample texts that must have a bin; the standard errors by which it must go with the label.
KEPT_BINS, LEAST_TEXTS, LEAST_STRENGTH = 1500, 4, 3.0
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 12, 256, 0.05, 2e-4


@dataclass
class FactorizationMachine:
    bins: np.ndarray  # sorted bins that have weights
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.bins & ((1 << SIEVE_BITS) - 1)] = True

    def known(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, slot) of the bins that have weights."""
        where = np.flatnonzero(self.sieve[bins & ((1 << SIEVE_BITS) - 1)])
        at = np.searchsorted(self.bins, bins[where])
        hit = self.bins[np.minimum(at, len(self.bins) - 1)] == bins[where] if len(self.bins) else np.zeros(len(where), bool)
        return where[hit], at[hit]

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities of whole texts."""
        slots, texts = [], []
        for bins, text in term_bins(buf, off):
            where, at = self.known(bins)
            slots.append(at)
            texts.append(text[where])
        n = len(off) - 1
        pairs = np.unique(np.concatenate(texts) * max(1, len(self.bins)) + np.concatenate(slots))
        return logistic(self.margin(pairs % max(1, len(self.bins)), pairs // max(1, len(self.bins)), n))

    def margin(self, at: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(text, self.weights[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def term_bins(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bin, text number) of the texts' terms, then of the terms' beginnings of each length; with repeats."""
    s, e, text = runs(buf, off, TERMS)
    yield (run_hashes(buf, s, e) >> np.uint64(33)).astype(np.int64), text
    for k in STEMS:
        longer = e - s > k
        s, e, text = s[longer], e[longer], text[longer]
        yield (run_hashes(buf, s, s + k) >> np.uint64(33)).astype(np.int64), text


def fit(bins: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """Fit on the distinct bins of each sample text and its 0/1 label, in the order given."""
    total, positive = len(labels), int(labels.sum())
    if not 0 < positive < total:
        return FactorizationMachine(np.zeros(0, np.int64), 30.0 if positive else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    flat = np.concatenate(bins)
    if not len(flat):
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(positive / (total - positive))), np.zeros(0), np.zeros((0, FACTORS)))
    vocabulary, seen = np.unique(flat, return_counts=True)
    toxic_bins, times = np.unique(np.concatenate([b for b, y in zip(bins, labels, strict=True) if y]), return_counts=True)
    hits = np.zeros(len(vocabulary), np.int64)
    hits[np.searchsorted(vocabulary, toxic_bins)] = times
    rate = positive / total
    strength = np.abs(hits - seen * rate) / np.sqrt(seen * rate * (1 - rate))
    strength[(seen < LEAST_TEXTS) | (strength < LEAST_STRENGTH)] = 0
    kept = np.argsort(-strength, kind="stable")[:KEPT_BINS]
    kept = np.sort(vocabulary[kept[strength[kept] > 0]]).astype(np.int64)
    rng = np.random.RandomState(11)
    model = FactorizationMachine(kept, float(np.log(rate / (1 - rate))), np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS)))
    texts = [model.known(b)[1] for b in bins]
    state = {n: [np.zeros_like(p), np.zeros_like(p)] for n, p in (("w", model.weights), ("v", model.factors))}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(total)
        for start in range(0, total, BATCH):
            rows = order[start : start + BATCH]
            at = np.concatenate([texts[r] for r in rows])
            text = np.repeat(np.arange(len(rows)), [len(texts[r]) for r in rows])
            wrong = (logistic(model.margin(at, text, len(rows))) - labels[rows]) / len(rows)
            step += 1
            model.bias -= RATE * float(wrong.sum())
            grad_w = np.bincount(at, wrong[text], len(kept)) + DECAY * model.weights
            grad_v = DECAY * model.factors
            for f in range(FACTORS):
                v = model.factors[at, f]
                grad_v[:, f] += np.bincount(at, wrong[text] * (np.bincount(text, v, len(rows))[text] - v), len(kept))
            for name, value, grad in (("w", model.weights, grad_w), ("v", model.factors, grad_v)):
                m, s = state[name]
                m *= 0.9
                m += 0.1 * grad
                s *= 0.999
                s += 0.001 * grad * grad
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def train(sample: DataFrame) -> FactorizationMachine:
    """Fit on a bounded (id, text, label) table.

    Bins are counted and chosen by aggregation; the driver gets each text's chosen bins only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                pairs = np.unique(np.concatenate([text * BINS + bins for bins, text in term_bins(buf, off)]))
                bins, text = pairs % BINS, pairs // BINS
                cut = np.searchsorted(text, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bins, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists], names=["id", "label", "bins"])

    binned = checkpointed(sample.select("id", "text", "label").mapInArrow(run, "id long, label int, bins array<int>"))
    rate = F.lit(binned.agg(F.avg("label")).first()[0] or 0.0)
    counted = binned.select("label", F.explode("bins").alias("bin")).groupBy("bin").agg(F.count("*").alias("seen"), F.sum("label").alias("hits"))
    strength = F.abs(F.col("hits") - F.col("seen") * rate) / F.sqrt(F.col("seen") * rate * (1 - rate) + 1e-12)
    strong = counted.where(F.col("seen") >= LEAST_TEXTS).where(strength >= LEAST_STRENGTH).orderBy(F.desc(strength), "bin").limit(KEPT_BINS)
    kept = np.sort(np.array([r.bin for r in strong.collect()], np.int32))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(b.values, kept, assume_unique=True) if len(b.values) else np.zeros(0, np.int32) for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["id", "label", "bins"])

    rows = binned.mapInArrow(known, "id long, label int, bins array<int>").toArrow().sort_by("id")
    return fit([np.asarray(b.values, dtype=np.int64) for b in rows["bins"]], np.array(rows["label"], dtype=np.float64))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", output: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
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


def keep_clean(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with the columns they came with."""
    name = free_name(docs, "score")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).select(*(F.col(quoted(c)) for c in docs.columns))
