"""Embedding near-duplicates over an inverted multi-index.

Independent codebooks on the two halves of the unit vectors form a product grid. Every vector lies in
one cell and visits the cells nearest to it, in multi-sequence order, as many as reach the target
recall; what it meets there is verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioflow.functions.hashing import uniform
from folioflow.llm.components import connected_components
from folioflow.llm.vectors import matrix, usable
from folioflow.session import materialise

LEAST_COSINE = 0.93
TARGET_RECALL = 0.9995
# Bound of the sample that codebooks and visits are fitted on, in vectors.
SAMPLE_ROWS = 8192
CELL_ROWS = 48
# Sampled vectors per code of a half; more cells than that allows ask for a larger sample.
CODE_ROWS = 8
# Rows of one block of a cell; larger cells are split into pairs of blocks.
MEMBER_BLOCK = 2048
QUERY_BLOCK = 4096


@dataclass
class MultiIndex:
    """``halves`` are the codebooks; a cell number is first code times the number of second codes plus second code."""

    halves: tuple[np.ndarray, np.ndarray]
    visits: int
    width: int

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = self.width // 2
        return tuple(
            ((part**2).sum(axis=1)[:, None] - 2 * part @ codes.T + (codes**2).sum(axis=1)[None, :])
            for part, codes in zip((rows[:, :split], rows[:, split:]), self.halves, strict=True)
        )

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        first, second = self.distances(rows)
        return first.argmin(axis=1) * len(self.halves[1]) + second.argmin(axis=1)

    def sequence(self, rows: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of every row, the nearest first.

        With the codes of each half in order of distance, the pair at places (i, j) has (i + 1) * (j + 1) - 1
        pairs that are no farther, so only places with (i + 1) * (j + 1) <= count can be among the nearest.
        """
        count = min(count, len(self.halves[0]) * len(self.halves[1]))
        parts = self.distances(rows)
        orders = [d.argsort(axis=1, kind="stable") for d in parts]
        ranked = [np.take_along_axis(d, o, axis=1) for d, o in zip(parts, orders, strict=True)]
        firsts = range(min(count, len(self.halves[0])))
        i, j = np.array([(i, j) for i in firsts for j in range(min(count // (i + 1), len(self.halves[1])))]).T
        nearest = np.argsort(ranked[0][:, i] + ranked[1][:, j], axis=1, kind="stable")[:, :count]
        return np.take_along_axis(orders[0], i[nearest], axis=1) * len(self.halves[1]) + np.take_along_axis(orders[1], j[nearest], axis=1)

    def places(self, rows: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """How many cells are nearer to every row than its partner's cell; no grid is written out."""
        parts = self.distances(rows)
        at = [d.argmin(axis=1) for d in self.distances(partners)]
        bound = sum(d[np.arange(len(rows)), own] for d, own in zip(parts, at, strict=True))
        second = np.sort(parts[1], axis=1)
        slack = 1e-9  # rounding must not count the cell itself
        return np.array([np.searchsorted(s, b - f - slack).sum() for f, s, b in zip(parts[0], second, bound, strict=True)])


def _codebook(rows: np.ndarray, codes: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = rows[draw.choice(len(rows), min(codes, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        owner = ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
        counts = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def fit(sample: np.ndarray, cells: int, least: float = LEAST_COSINE, recall: float = TARGET_RECALL, seed: int = 5) -> MultiIndex:
    """Codebooks for about ``cells`` cells, and how many cells a vector must visit.

    The number of visits comes from the hardest links: sampled vectors and partners at exactly the least
    cosine in random directions. A pair counts as found if either end visits the other's cell.
    """
    draw = np.random.default_rng(seed)
    width = sample.shape[1]
    codes = int(np.clip(round(np.sqrt(cells)), 1, max(1, len(sample) // CODE_ROWS)))
    split = width // 2
    index = MultiIndex((_codebook(sample[:, :split], codes, draw), _codebook(sample[:, split:], codes, draw)), 1, width)
    rows = sample[draw.choice(len(sample), min(len(sample), 4096), replace=False)]
    noise = draw.normal(size=rows.shape)
    noise -= (noise * rows).sum(axis=1, keepdims=True) * rows
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    partners = least * rows + np.sqrt(1 - least**2) * noise
    ranks = [index.places(a, b) for a, b in ((rows, partners), (partners, rows))]
    index.visits = int(np.quantile(np.minimum(*ranks), recall, method="higher")) + 1
    return index


def _block(members: pa.Table, queries: pa.Table, least: float) -> pa.Table:
    """Links of one block of queries with one block of a cell's members, summed per vector.

    A pair that both ends find is counted by each end at its own visit; a pair that only the query
    finds is counted here for both. Only vectors with links are returned, with the smallest id of their
    part of the block's link graph, never the pairs.
    """
    ids, weights = (members.column(c).to_numpy() for c in ("id", "copies"))
    asked, ask_weights = (queries.column(c).to_numpy() for c in ("id", "copies"))
    close = matrix(queries.column("vector")) @ matrix(members.column("vector")).T >= least
    close &= asked[:, None] != ids[None, :]
    q, m = np.nonzero(close)
    if not len(q):
        return _NONE
    own = queries.column("own").to_numpy()[q]
    visits = np.stack(members.column("visits").to_numpy()[np.unique(m)])
    place = np.searchsorted(np.unique(m), m)
    alone = np.empty(len(q), dtype=bool)
    for start in range(0, len(q), 1 << 16):
        part = slice(start, start + (1 << 16))
        alone[part] = ~(visits[place[part]] == own[part, None]).any(axis=1)
    nodes, at = np.unique(np.concatenate([asked, ids]), return_inverse=True)
    at_q, at_m = at[: len(asked)][q], at[len(asked) :][m]
    links = np.bincount(at_q, weights=weights[m], minlength=len(nodes))
    links += np.bincount(at_m, weights=ask_weights[q] * alone, minlength=len(nodes))
    root = np.arange(len(nodes))
    while True:
        least_root = root.copy()
        np.minimum.at(least_root, at_q, root[at_m])
        np.minimum.at(least_root, at_m, root[at_q])
        least_root = np.minimum(least_root, least_root[least_root])
        if (least_root == root).all():
            break
        root = least_root
    touched = np.unique(np.concatenate([at_q, at_m]))
    return pa.table({"id": nodes[touched], "links": links[touched].astype(np.int64), "root": nodes[root[touched]]}, schema=_LINKS)


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
_NONE = _LINKS.empty_table()


def near_duplicates(
    vectors: DataFrame, least: float = LEAST_COSINE, recall: float = TARGET_RECALL, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors (``vec_id, embedding, label``) link if their labels are equal and not null, their lengths are
    equal and their cosine in double precision is ``least`` or more. Vectors that cannot take part
    (null, empty, zero, null or non-finite components, null label, null id) link with nothing; their
    component is their own id and they are kept. Repeated rows are copies of each other and link. An id
    with several vectors is several vectors: each has links and a component of its own. Other columns are
    not read; an empty table gives no rows.

    Exact copies are one class with a number and a weight before anything is compared. The index is fitted
    on at most ``sample_rows`` vectors (beyond ``sample_rows / CODE_ROWS`` codes a half, cells grow with the
    table unless the sample does) and holds every class. Cells are cut into blocks of bounded size, so a hot cell
    spreads over tasks; a block sends one row per linked vector.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label")
    ).withColumn("_use", usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # Rows that take no part have a key that meets nothing but spreads over the tasks of the last join.
    key = {"_a": F.when(F.col("_use"), F.xxhash64("vector", "label")).otherwise(F.xxhash64("vec_id", "vector")), "_b": F.when(F.col("_use"), F.xxhash64("label", F.size("vector"), "vector"))}
    rows = rows.withColumns(key)
    classes = materialise(
        rows.where("_use")
        .groupBy("_a", "_b")
        .agg(
            F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector")
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "vector-classes",
    )
    total, groups, width = classes.agg(F.count(F.lit(1)), F.count_distinct("label"), F.max(F.size("vector"))).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rate = F.lit(min(1.0, 0.9 * sample_rows / total))
    sample = matrix(classes.where(uniform("multi-index", "_a") <= rate).orderBy("_a", "_b").limit(sample_rows).select("vector").toArrow().column(0), width)
    if not len(sample):
        sample = matrix(classes.limit(1).select("vector").toArrow().column(0), width)
    index = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), max(1, total // max(groups, 1) // CELL_ROWS), least, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = matrix(batch.column("vector"), width)
            unit /= np.abs(unit).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), width).cast(pa.list_(pa.float64()))
            visits = index.sequence(unit, index.visits).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "copies", "label", "size")),
                    lists,
                    pa.array(index.cells(unit)),
                    pa.FixedSizeListArray.from_arrays(pa.array(visits.ravel()), visits.shape[1]).cast(pa.list_(pa.int64())),
                ],
                names=["id", "copies", "label", "size", "vector", "own", "visits"],
            )

    schema = "id bigint, copies bigint, label string, size int, vector array<double>, own bigint, visits array<bigint>"
    placed = classes.select("id", "copies", "label", F.size("vector").alias("size"), "vector").mapInArrow(place, schema)
    placed = materialise(placed, "vector-cells")

    cell = ["label", "size", "cell"]
    asked = placed.select("id", "copies", "label", "size", "vector", "own", F.explode("visits").alias("cell"))
    held = placed.select("id", "copies", "label", "size", "vector", "visits", F.col("own").alias("cell"))
    blocks = (
        held.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
        .join(asked.groupBy(cell).agg(F.count(F.lit(1)).alias("nq")), cell)
        .select(*cell, F.ceil(F.col("n") / MEMBER_BLOCK).cast("int").alias("parts"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("turns"))
    )
    blocks = materialise(blocks, "vector-blocks")
    turn, part = F.sequence(F.lit(0), F.col("turns") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
    mix = F.xxhash64("id")
    held = held.join(blocks, cell).withColumns({"part": F.pmod(mix, F.col("parts")).cast("int"), "turn": F.explode(turn)})
    asked = asked.join(blocks, cell).withColumns({"turn": F.pmod(mix, F.col("turns")).cast("int"), "part": F.explode(part)})
    by = [*cell, "part", "turn"]
    links = (
        held.select(*by, "id", "copies", "vector", "visits")
        .groupBy(by)
        .cogroup(asked.select(*by, "id", "copies", "vector", "own").toDF(*by, "id", "copies", "vector", "own").groupBy(by))
        .applyInArrow(lambda m, q: _block(m, q, least) if len(m) and len(q) else _NONE, "id bigint, links bigint, root bigint")
    )
    links = materialise(links, "vector-links")
    parts = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = (
        classes.select("_a", "_b", "id", "name", "copies")
        .join(counts, "id", "left")
        .join(parts.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "_a", "_b", "name", F.coalesce("component", "id").alias("part"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
    )
    found = materialise(found, "vector-parts")
    found = found.join(found.groupBy("part").agg(F.min("name").alias("component_id")), "part").select("_a", "_b", "n_links", "component_id")
    return (
        rows.select("vec_id", "_a", "_b")
        .join(materialise(found, "vector-found"), ["_a", "_b"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
        )
    )
