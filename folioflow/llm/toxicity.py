"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import sample_by_id, text_slices
from folioflow.llm.tokens import Generations

# Bound of the labelled sample that the model is fitted on, in documents.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 19
GRADES = 4
# A document is toxic where grade 1 or more is likelier than grade 0.
TOXIC = 0.5
# Features enter the model if toxic and other documents of the sample differ in them by this chi square.
LEAST_CHI_SQUARE = 25.0
LEAST_DOCUMENTS = 4
BEGINNINGS = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 80_000
# A set of features takes many times its text, so slices are smaller here.
_SLICE_BYTES = 1 << 20


def features(text: str) -> set[str]:
    """The distinct lower-cased words of a whole text and their beginnings, marked by a hyphen.

    Presence counts, so length does not dilute; beginnings stand for inflected and compound forms.
    """
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) >= n} for n in BEGINNINGS))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights * features - thresholds[k]); the weights are shared by all thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for every margin and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margins[:, None], -500, 500)))


def grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Severity of the labelled sample: 0 if not toxic, else 1 to 3 by how many marked features it holds.

    Labels say toxic or not. A feature is marked if it is far likelier in toxic documents of the sample
    (smoothed log odds over 3, five toxic documents at least). A marked word comes with its beginnings,
    so under eight marked features are grade 1, under sixteen grade 2, more are grade 3.
    """
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    label = np.repeat(toxic, [len(r) for r in rows])
    yes, no = (np.bincount(flat[label == k], minlength=BUCKETS) for k in (1, 0))
    n_yes, n_no = max(toxic.sum(), 1), max(len(toxic) - toxic.sum(), 1)
    odds = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    marked = (odds > 3) & (yes >= 5)
    hits = np.array([marked[r].sum() for r in rows], dtype=np.int64)
    return np.where(toxic == 1, 1 + (hits >= 8) + (hits >= 16), 0).astype(np.int64)


def selected(rows: list[np.ndarray], toxic: np.ndarray, least: float = LEAST_CHI_SQUARE) -> np.ndarray:
    """Which features are likelier in toxic documents: chi square of presence, ``LEAST_DOCUMENTS`` at least.

    Words that mean nothing would otherwise add up in long documents, for or against them.
    """
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    label = np.repeat(toxic, [len(r) for r in rows])
    yes, no = (np.bincount(flat[label == k], minlength=BUCKETS).astype(np.float64) for k in (1, 0))
    n_yes, n = float(toxic.sum()), float(len(toxic))
    held = yes + no
    spread = n_yes * (n - n_yes) * held * (n - held)
    chi = n * (yes * (n - n_yes) - no * n_yes) ** 2 / np.maximum(spread, 1e-12)
    return (held >= LEAST_DOCUMENTS) & (spread > 0) & (chi >= least) & (yes * (n - n_yes) > no * n_yes)


def fit(rows: list[np.ndarray], toxic: np.ndarray, epochs: int = 20, seed: int = 11, shrink: float = 1e-6) -> OrdinalModel:
    """Stochastic gradient descent on the ordinal likelihood with per-weight steps and ordered thresholds.

    Thresholds are a first value and positive gaps, so they stay in order. Features that enter speak
    for toxicity, so their weights are kept from going below 0. Without toxic rows nothing is above
    grade 0.
    """
    weights = np.zeros(BUCKETS)
    if not len(rows) or not toxic.any():
        return OrdinalModel(weights, np.full(GRADES - 1, 50.0))
    wanted = grades(rows, toxic)
    used_features = selected(rows, toxic)
    rows = [r[used_features[r]] for r in rows]
    first, gaps = 3.0, np.zeros(GRADES - 2)  # gaps in logarithms
    squares, square_first, square_gaps = np.full(BUCKETS, 1e-8), 1e-8, np.full(GRADES - 2, 1e-8)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 32)):
            used = np.concatenate([rows[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            margin = np.bincount(owner, weights=weights[used], minlength=len(batch))
            thresholds = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            over = 1 / (1 + np.exp(np.clip(thresholds[None, :] - margin[:, None], -50, 50)))
            edges = np.concatenate([np.ones((len(batch), 1)), over, np.zeros((len(batch), 1))], axis=1)
            at, y = np.arange(len(batch)), wanted[batch]
            upper, lower = edges[at, y], edges[at, y + 1]
            chance = np.maximum(upper - lower, 1e-12)
            # d(-log chance) by margin and by each threshold
            d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
            slope = -(d_upper - d_lower) / chance
            by_threshold = np.zeros(GRADES - 1)
            np.add.at(by_threshold, np.maximum(y - 1, 0), np.where(y > 0, d_upper / chance, 0))
            np.add.at(by_threshold, np.minimum(y, GRADES - 2), np.where(y < GRADES - 1, -d_lower / chance, 0))
            step = np.bincount(used, weights=slope[owner], minlength=BUCKETS)
            touched = np.flatnonzero(step)
            g = step[touched] / len(batch) + shrink * weights[touched]
            squares[touched] += g * g
            weights[touched] = np.maximum(weights[touched] - 0.2 * g / np.sqrt(squares[touched]), 0)
            g = by_threshold.sum() / len(batch)
            square_first += g * g
            first -= 0.1 * g / math.sqrt(square_first)
            g = np.cumsum(by_threshold[:0:-1])[::-1] * np.exp(gaps) / len(batch)
            square_gaps += g * g
            gaps -= 0.1 * g / np.sqrt(square_gaps)
    return OrdinalModel(weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, most=_SLICE_BYTES):
        rows = [np.array(sorted(map(bucket, features(t or ""))), dtype="<i4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, type=pa.binary())], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``bound`` labelled documents; only hashed distinct words reach the driver.

    ``labels`` has ``doc_id`` and a 0/1 ``label``; null labels are left out, of several labels of an id
    the largest counts. The sampled ids, never more than ``bound``, are broadcast to the documents.
    """
    labels = labels.where(F.col("label").isNotNull()).select("doc_id", F.col("label").cast("int"))
    chosen = sample_by_id(labels, bound, "toxicity").groupBy("doc_id").agg(F.max("label").alias("label"))
    found = (
        docs.select("doc_id", F.col("text").cast("string"))
        .join(F.broadcast(chosen), "doc_id")
        .select("label", "text")
        .limit(2 * bound)
        .mapInArrow(_featurise, "label int, features binary")
        .toArrow()
    )
    pairs = sorted(zip(found.column("label").to_pylist(), found.column("features").to_pylist(), strict=True))
    return fit([np.frombuffer(r, dtype="<i4") for _, r in pairs], np.array([label for label, _ in pairs], dtype=np.int64))


class _Weights(Generations):
    def __init__(self, weights: np.ndarray) -> None:
        super().__init__(_CACHE_WORDS)
        self.weights = weights

    def margins(self, found: list[set[str]]) -> np.ndarray:
        self.update((word, float(self.weights[bucket(word)])) for word in self.missing(set().union(*found)))
        return np.array([math.fsum(map(self.__getitem__, words)) for words in found])


def severity(docs: DataFrame, model: OrdinalModel, kept: dict[str, Column], toxic: float = TOXIC) -> DataFrame:
    """``kept`` columns with ``severity`` (expected grade, 0 to 3), ``grade`` (likeliest), ``score`` and ``predicted``.

    ``score`` is the probability of any toxicity and ``predicted`` is 1 from ``toxic`` on. Whole texts are
    read; null and empty texts have no features and get the intercept. Sums are exact, so a result does
    not depend on the order of words in a set.
    """
    # The text travels once: as a kept column if it is one, else as a column that is dropped again.
    shown = list(kept)
    text = "text" if "text" in kept else "_text"
    columns = kept if "text" in kept else kept | {"_text": F.col("text").cast("string")}
    chosen = docs.select(*[c.alias(name) for name, c in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Weights(model.weights)
        for batch in text_slices(batches, text, _SLICE_BYTES):
            margins = cache.margins([features(t or "") for t in batch.column(text).to_pylist()])
            above = model.above(margins)
            edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            likeliest = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(shown)],
                    pa.array(above.sum(axis=1)),
                    pa.array(likeliest),
                    pa.array(above[:, 0]),
                    pa.array((above[:, 0] >= toxic).astype(np.int32)),
                ],
                names=[*batch.schema.names[: len(shown)], "severity", "grade", "score", "predicted"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(shown)])
    return chosen.mapInArrow(run, f"{fields}, severity double, grade int, score double, predicted int")
