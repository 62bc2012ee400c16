"""Language identification from averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import sample_by_id, text_slices

UNKNOWN = "und"
# Bound of the labelled sample that the model is fitted on, in documents.
SAMPLE_ROWS = 3_000
BUCKETS = 8192
DIMENSIONS = 16
GRAMS = (2, 3, 4)
# Share of correctly labelled calibration documents that rejection may lose.
REJECTED_SHARE = 0.005
_WORD = re.compile(r"[^\W\d_]+")
# Text whose distinct words are looked at together; their grams take some 100 bytes a character.
_SLICE_BYTES = 2 << 20


def _steps() -> np.ndarray:
    """The 256 steps of CRC-32 for one byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEPS = _steps()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of marked words and of their character grams, with the index of the word of each.

    A bucket is the CRC-32 of the UTF-8 bytes modulo ``BUCKETS``. All grams that begin at a character share
    its running checksum, and the characters of all words step at once.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter(map(len, marked), np.int32, len(marked))
    of_word = np.repeat(np.arange(len(marked), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the word's end
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)
    octets = []  # of each character, the first to last byte; absent ones are skipped by width
    for k in range(int(width.max(initial=0))):
        shift = np.maximum(6 * (width - 1 - k), 0).astype(np.uint32)
        rest = (codes >> shift) & np.uint32(0x3F) | np.uint32(0x80)
        octets.append((np.where(width == 1, codes, lead[width] | codes >> shift) if k == 0 else rest).astype(np.uint8))
    whole = np.fromiter((zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked), np.uint32, len(marked))
    owners, buckets = [np.arange(len(marked), dtype=np.int32)], [(whole % np.uint32(BUCKETS)).astype(np.int32)]
    begin, state = np.arange(len(codes)), np.full(len(codes), 0xFFFFFFFF, dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        fits = left[begin] >= n
        begin, state = begin[fits], state[fits]
        at = begin + n - 1
        for k, octet in enumerate(octets):
            stepped = _STEPS[(state ^ octet[at]) & np.uint32(0xFF)] ^ state >> np.uint32(8)
            state = stepped if k == 0 else np.where(width[at] > k, stepped, state)
        if n in GRAMS:
            owners.append(of_word[begin])
            buckets.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    found = _WORD.findall(text.lower())
    if found and not any(c.isalpha() for word in found for c in word):
        return []
    return found


@dataclass
class LanguageModel:
    """``table`` holds one row of logits per bucket: embeddings times the softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from summed logits and the number of subwords of each text."""
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        return softmax(logits)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7, epochs: int = 40) -> LanguageModel | None:
    """Stochastic gradient descent on cross entropy, then a temperature and a rejection threshold.

    ``rows`` has the distinct buckets of each document and their counts; only the rows of one step are
    ever dense. A fifth of the rows (every fifth of a fixed shuffle) is kept from training and
    calibrates. Without rows there is no model; with one language it predicts that one.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(labels))
    shares = [(found, (n / max(n.sum(), 1)).astype(np.float32)) for found, n in rows]
    wanted = np.array([languages.index(label) for label in labels])
    held = order[::5] if len(order) >= 10 else order
    train = np.setdiff1d(order, held) if len(order) >= 10 else order
    vectors = draw.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = draw.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        for step in np.array_split(draw.permutation(train), max(1, len(train) // 32)):
            batch = np.zeros((len(step), BUCKETS), dtype=np.float32)
            for at, row in enumerate(step):
                batch[at, shares[row][0]] = shares[row][1]
            hidden = batch @ vectors
            slope = softmax(hidden @ weights + bias)
            slope[np.arange(len(step)), wanted[step]] -= 1
            slope /= len(step)
            back = slope @ weights.T
            weights -= 1.0 * rate * (hidden.T @ slope)
            bias -= 0.1 * rate * slope.sum(axis=0)
            vectors -= 20.0 * rate * (batch.T @ back)
    model = LanguageModel(languages, (vectors @ weights).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    logits = np.stack([shares[row][1] @ model.table[shares[row][0]] for row in held]) + model.bias
    tried = np.geomspace(0.05, 5, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(held)), wanted[held]] + 1e-12).mean() for t in tried]
    model.temperature = float(tried[int(np.argmin(losses))])
    best = softmax(logits / model.temperature)
    right = best.max(axis=1)[best.argmax(axis=1) == wanted[held]]
    model.threshold = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and counts of the whole text, and of a run of twelve words, so that short texts are learned too."""
    for batch in text_slices(batches):
        labels, held, buckets, counts = batch.column("lang").to_pylist(), [], [], []
        for label, text in zip(labels, batch.column("text").to_pylist(), strict=True):
            words = words_of(text or "")
            middle = len(words) // 2
            for part in (words, words[middle : middle + 12]):
                if part:
                    n = np.bincount(subwords(part)[1], minlength=BUCKETS)
                    found = np.flatnonzero(n)
                    held.append(label)
                    buckets.append(found.astype("<i4").tobytes())
                    counts.append(n[found].astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, type=pa.string()), pa.array(buckets, type=pa.binary()), pa.array(counts, type=pa.binary())],
            names=["lang", "buckets", "counts"],
        )


def train(labelled: DataFrame, bound: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fit on at most ``bound`` rows of (``doc_id, text, lang``); only bucket counts reach the driver.

    The driver holds the counts of at most ``BUCKETS`` buckets twice per document of the sample, whatever
    the texts are.
    """
    chosen = sample_by_id(labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text"), bound, "language")
    found = chosen.select(F.col("lang").cast("string"), "text").mapInArrow(_featurise, "lang string, buckets binary, counts binary").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("lang", "buckets", "counts")), strict=True))  # not in the order of tasks
    counted = [(np.frombuffer(b, dtype="<i4"), np.frombuffer(n, dtype="<i4")) for _, b, n in rows]
    return fit(counted, [label for label, _, _ in rows])


def word_logits(words: list[str], table: np.ndarray) -> np.ndarray:
    """Summed logits of the subwords of each word and, last, their number."""
    owners, buckets = subwords(words)
    columns = [np.bincount(owners, weights=table[buckets, k], minlength=len(words)) for k in range(table.shape[1])]
    return np.stack([*columns, np.bincount(owners, minlength=len(words))], axis=1)


def text_logits(texts: list[list[str]], table: np.ndarray) -> np.ndarray:
    """The same sums for texts of one or more words; a word of several texts is looked at once."""
    words = pa.array([w for found in texts for w in found], pa.large_string()).dictionary_encode()
    rows = word_logits(words.dictionary.to_pylist(), table)[words.indices.to_numpy()]
    sizes = np.array([len(found) for found in texts])
    return np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0)


def identify(docs: DataFrame, model: LanguageModel | None, held_out: Column) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, accepted``.

    ``lang_pred`` is the likeliest learned language of the whole text with its calibrated probability;
    null texts and texts without a letter are ``und`` with score 0. ``accepted`` is false for ``und`` and
    where the score is under the calibrated threshold. Without a model every row is ``und``. Only the text
    is read for a prediction; rows that repeat are predicted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=_SLICE_BYTES):
            words = [words_of(t or "") if model else [] for t in batch.column("text").to_pylist()]
            sizes = np.array([len(w) for w in words])
            names, scores = [UNKNOWN] * len(words), np.zeros(len(words))
            some = np.flatnonzero(sizes)
            if len(some):
                sums = text_logits([words[at] for at in some.tolist()], model.table)
                chances = model.probabilities(sums[:, :-1], sums[:, -1])
                scores[some] = chances.max(axis=1)
                for at, best in zip(some.tolist(), chances.argmax(axis=1).tolist(), strict=True):
                    names[at] = model.languages[best]
            accepted = (scores >= model.threshold) & (sizes > 0) if model else scores > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores), pa.array(accepted)],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"
    )
