"""Quality of texts: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import sample_by_id, text_slices

# Bound of the labelled sample that the trees are fitted on, in documents.
SAMPLE_ROWS = 16_000
ACCEPTED = 0.3
BINS = 64

_BYTES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32,),
    "line": (10,),
    "stop": b".,;:",
    "loud": b"!?",
    "symbol": b"#$%&*@^~=+_<>/\\",
    "bar": b"|",
    "quote": b"\"'()[]{}-",
    "high": range(128, 256),
}
_CLASSES = np.zeros((256, len(_BYTES)))
for _column, _members in enumerate(_BYTES.values()):
    _CLASSES[list(_members), _column] = 1

STATISTICS = (
    "log_bytes", *_BYTES, "log_words", "word_mean", "word_spread", "distinct", "top_share", "same_next",
    "distinct_triples", "lines", "line_copies", "line_mean", "ends_marked",
)


def statistics(text: str) -> list[float]:
    """The figures of ``STATISTICS`` for a whole text; all shares of an empty text are 0."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    classes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / size
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    triples = max(len(words) - 2, 1)
    lines = text.split("\n")
    counts = Counter(words)
    return [
        np.log1p(len(raw)),
        *classes,
        np.log1p(len(words)),
        lengths.mean() if len(words) else 0.0,
        lengths.std() if len(words) else 0.0,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples,
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        len(text) / len(lines),
        sum(not w[-1].isalnum() for w in words) / n,
    ]


@dataclass
class Trees:
    """All trees in flat arrays; node 0 of a tree is ``roots[t]``, and a leaf points to itself."""

    edges: list[np.ndarray]
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def binned(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(rows.shape, dtype=np.int64)
        for column, edges in enumerate(self.edges):
            out[:, column] = np.searchsorted(edges, rows[:, column], side="left")
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1; every document walks all trees at once, one level a step."""
        bins = self.binned(rows)
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        document = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            goes_left = bins[document, self.feature[at]] <= self.limit[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.prior + self.value[at].sum(axis=1))))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting; splits come from histograms of gradients over quantile bins.

    Without rows, or with one class, the score is the smoothed share of label 1.
    """
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    prior = float(np.log(share / (1 - share)))
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(rows[:, c], steps)) if len(rows) else np.zeros(0) for c in range(rows.shape[1])]
    model = Trees(edges, *(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64, np.int64)), depth, prior)
    if len(rows) == 0 or labels.min() == labels.max():
        return model
    bins = model.binned(rows)
    shifted = bins + np.arange(rows.shape[1]) * BINS
    margin = np.full(len(rows), prior)
    feature, limit, left, right, value, roots = [], [], [], [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, curve = chance - labels, np.maximum(chance * (1 - chance), 1e-9)
        roots.append(len(value))
        open_nodes = [(len(value), np.arange(len(rows)))]
        for column, start in ((feature, 0), (limit, 0), (left, len(value)), (right, len(value)), (value, 0.0)):
            column.append(start)
        for level in range(depth + 1):
            grown = []
            for node, members in open_nodes:
                g, h = slope[members], curve[members]
                split = _best_split(shifted[members], g, h, rows.shape[1], ridge) if level < depth else None
                if split is None:
                    value[node] = float(-rate * g.sum() / (h.sum() + ridge))
                    margin[members] += value[node]
                    continue
                feature[node], limit[node] = split
                goes_left = bins[members, split[0]] <= split[1]
                for side, part in ((left, members[goes_left]), (right, members[~goes_left])):
                    side[node] = len(value)
                    grown.append((len(value), part))
                    for column, start in ((feature, 0), (limit, 0), (left, len(value)), (right, len(value)), (value, 0.0)):
                        column.append(start)
            open_nodes = grown
    model.feature, model.limit, model.left, model.right, model.roots = (np.array(x) for x in (feature, limit, left, right, roots))
    model.value = np.array(value)
    return model


def _best_split(shifted: np.ndarray, g: np.ndarray, h: np.ndarray, columns: int, ridge: float, least: int = 10) -> tuple[int, int] | None:
    flat = shifted.ravel()
    size = columns * BINS
    sums = [
        np.bincount(flat, weights=None if w is None else np.repeat(w, columns), minlength=size).reshape(columns, BINS).cumsum(axis=1)
        for w in (g, h, None)
    ]
    (gl, hl, nl), (gs, hs, ns) = sums, (g.sum(), h.sum(), len(g))
    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
    gain[(nl < least) | (ns - nl < least)] = -1
    best = int(np.argmax(gain))
    return (best // BINS, best % BINS) if gain.ravel()[best] > 1e-6 else None


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = [np.array(statistics(t or ""), dtype="<f8").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, type=pa.binary())], names=["label", "statistics"])


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``bound`` labelled documents; only their statistics reach the driver.

    ``labels`` has ``doc_id`` and a 0/1 ``label``; null labels are left out, of several labels of an id
    the smallest counts. The sampled ids, never more than ``bound``, are broadcast to the documents.
    """
    labels = labels.where(F.col("label").isNotNull()).select("doc_id", F.col("label").cast("int"))
    chosen = sample_by_id(labels, bound, "quality").groupBy("doc_id").agg(F.min("label").alias("label"))
    found = (
        docs.select("doc_id", F.col("text").cast("string"))
        .join(F.broadcast(chosen), "doc_id")
        .select("label", "text")
        .limit(2 * bound)
        .mapInArrow(_statistics_of, "label int, statistics binary")
        .toArrow()
    )
    pairs = sorted(zip(found.column("label").to_pylist(), found.column("statistics").to_pylist(), strict=True))
    rows = np.array([np.frombuffer(r, dtype="<f8") for _, r in pairs]).reshape(len(pairs), len(STATISTICS))
    return fit(rows, np.array([label for label, _ in pairs], dtype=np.float64))


def grade(docs: DataFrame, model: Trees, kept: dict[str, Column], accepted: float = ACCEPTED) -> DataFrame:
    """``kept`` columns with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= ``accepted``).

    Whole texts are scored; null and empty texts are scored as texts without words. Each row is scored
    from its text alone, so repeated rows and clashing names of other columns do not matter.
    """
    # The text travels once: as a kept column if it is one, else as a column that is dropped again.
    shown = list(kept)
    text = "text" if "text" in kept else "_text"
    columns = kept if "text" in kept else kept | {"_text": F.col("text").cast("string")}
    chosen = docs.select(*[c.alias(name) for name, c in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            rows = np.array([statistics(t or "") for t in batch.column(text).to_pylist()])
            scores = model.score(rows.reshape(batch.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(shown)], pa.array(scores), pa.array((scores >= accepted).astype(np.int32))],
                names=[*batch.schema.names[: len(shown)], "score", "predicted"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(shown)])
    return chosen.mapInArrow(run, f"{fields}, score double, predicted int")
