"""Exact k-nearest-neighbour join.

Three plans with one contract ``(q_id, id, dist, rank)``; ties go to the smaller id.

* Few queries (what a task holds of them under ``broadcast_bytes``): the queries go to every task and the
  base is read once in place. A task keeps k rows per query, so the base is never shuffled.
* Otherwise a grid: a task holds one block of queries, as large as ``block_bytes`` allows, and streams its
  share of the base past it. The base is copied once per query block, a query once per share of the base.
* Cells around pivots, where a sample of queries shows that they rule out enough. The triangle inequality
  gives each query an upper bound for its k-th distance, hence the only cells that can hold a neighbour.
  Blocks hold queries of cells that lie side by side, only cells that a query of the block may need are
  sent to it, and a run of cells meets only the queries that need one of them.

Inside a task a block is one matrix product; only rows within rounding error of the cut are measured
again by exact differences.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioflow.functions.hashing import uniform
from folioflow.operators.ordering import smallest, top_per_key
from folioflow.session import materialise

BROADCAST_BYTES = 128 << 20
# Tile of a matrix product.
BLOCK_BYTES = 8 << 20
MAX_PIVOTS = 1024
# Base rows of neighbouring cells that meet the queries together, at least.
MIN_CHUNK_ROWS = 256
# What a task of the grid holds for its queries, and the share of the base that a sampled query may visit for cells to pay.
RESIDENT_BYTES = 128 << 20
CELLS_BELOW = 0.5
SAMPLE_ROWS = 512

_EPS = np.finfo(np.float64).eps
_LOG = logging.getLogger(__name__)
_RESULT = "q_id string, id string, dist double"
# Rows of a tile that may pass the cut, per query and wanted neighbour, before the cut is made sharper first.
_LOOSE = 4
_ID_BYTES = 64  # of an id held in memory; longer ones only make the blocks larger than asked


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "euclidean",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = RESIDENT_BYTES,
    cells_below: float = CELLS_BELOW,
) -> DataFrame:
    """``queries`` and ``base`` hold ``id`` and ``vector`` (float or double arrays) without nulls or NaN.

    ``cells_below`` is the share of the base that sampled queries may visit for cells to be used: 0 never uses
    them, more than 1 always. Copies of a query are logged.
    """
    n_queries, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).head()
    if n_queries == 0 or k <= 0:
        return _empty(queries)
    if n_queries * _held_bytes(dim, k) <= broadcast_bytes:
        found = _scan_base(queries, base, k, metric, exclude_self)
    else:
        cells = _Cells(base, k + 1 if exclude_self else k, metric, dim) if cells_below > 0 else None
        if cells and len(cells.rows) and (cells_below > 1 or cells.visited(queries) < cells_below):
            found = _join_cells(queries, cells, n_queries, k, metric, exclude_self, dim, block_bytes)
        else:
            found = _join_blocks(queries, base, n_queries, k, metric, exclude_self, dim, block_bytes)
    return top_per_key(found, k, ["q_id"], [F.col("dist"), F.col("id")])


def _held_bytes(dim: int, k: int) -> int:
    """What a task holds for a query: its id, its vector and unit form, a norm and a cut, and k rows."""
    return 16 * dim + 24 + _ID_BYTES + k * (8 + _ID_BYTES)


def _vector_type(rows: DataFrame) -> str:
    return rows.schema["vector"].dataType.simpleString()


def _empty(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], _RESULT + ", rank bigint")


# --- block kernel -----------------------------------------------------------------------------


def _unpack(table: pa.RecordBatch | pa.Table, id_name: str = "id") -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(table.column(id_name).to_pylist(), dtype=str)
    column = table.column("vector")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return ids, flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _measure(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows."""
    if metric == "cosine":
        norms = np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        return 1.0 - np.einsum("ij,ij->i", q, b) / norms
    gap = q - b
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class _Nearest:
    """The k best base rows seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.ids, self.matrix, self.k, self.metric, self.exclude_self = ids, matrix, k, metric, exclude_self
        self.search = _unit(matrix) if metric == "cosine" else matrix
        self.norms = np.einsum("ij,ij->i", self.search, self.search)
        self.cut = np.full(len(ids), np.inf)  # squared search distance of the k-th row
        self.held = np.zeros(len(ids), dtype=np.int64)  # rows seen, up to k
        self.found = np.empty((len(ids), k), dtype="<U1")
        self.dist = np.empty((len(ids), k))

    def add(self, ids: np.ndarray, matrix: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Take base rows in; ``asked`` numbers the queries, in rising order, that they may concern, if not all."""
        n_asked = len(self.ids) if asked is None else len(asked)
        if not len(ids) or not n_asked:
            return
        search = _unit(matrix) if self.metric == "cosine" else matrix
        norms = np.einsum("ij,ij->i", search, search)
        order, low, high = self._own(ids) if self.exclude_self else (None, None, None)
        step = max(1, BLOCK_BYTES // (8 * len(ids)))
        for start in range(0, n_asked, step):
            end = min(start + step, n_asked)
            rows = slice(start, end) if asked is None else asked[start:end]
            square = self.search[rows] @ search.T
            square *= -2.0
            square += self.norms[rows, None]
            square += norms
            if order is not None:
                times = high[rows] - low[rows]
                own = np.repeat(np.arange(end - start), times)
                place = np.repeat(low[rows], times) + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
                square[own, order[place]] = np.inf
            self._add_tile(np.arange(start, end) if asked is None else rows, square, ids, matrix, norms.max())

    def _own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of ``ids``, and from where to where each query's own id stands in it."""
        order = np.argsort(ids, kind="stable")
        ordered = ids[order]
        return order, np.searchsorted(ordered, self.ids, "left"), np.searchsorted(ordered, self.ids, "right")

    def _add_tile(self, rows: np.ndarray, square: np.ndarray, ids: np.ndarray, matrix: np.ndarray, most: float) -> None:
        slack = 16 * matrix.shape[1] * _EPS * (self.norms[rows] + most)
        cut = self.cut[rows]
        near = np.flatnonzero(square <= (cut + slack)[:, None])  # far faster than nonzero of two dimensions
        if self.k < len(ids) and len(near) > _LOOSE * self.k * len(rows):
            cut = np.minimum(cut, np.partition(square, self.k - 1, axis=1)[:, self.k - 1])
            near = np.flatnonzero(square <= (cut + slack)[:, None])
        near = near[np.isfinite(square.ravel()[near])]
        query, other = rows[near // len(ids)], near % len(ids)
        if not len(query):
            return
        pairs = max(1, BLOCK_BYTES // (8 * matrix.shape[1]))
        dist = np.concatenate(
            [
                _measure(self.matrix[query[i : i + pairs]], matrix[other[i : i + pairs]], self.metric)
                for i in range(0, len(query), pairs)
            ]
        )
        self._merge(query, ids[other], dist)

    def _merge(self, query: np.ndarray, found: np.ndarray, dist: np.ndarray) -> None:
        """Take rows into the lists of their queries, which ``query`` names in rising order; the others stay as they are."""
        if found.dtype.itemsize > self.found.dtype.itemsize:
            self.found = self.found.astype(found.dtype)
        touched = np.unique(query)
        old, place = np.nonzero(np.arange(self.k) < self.held[touched, None])
        old = touched[old]
        query = np.concatenate([old, query])
        found = np.concatenate([self.found[old, place], found])
        dist = np.concatenate([self.dist[old, place], dist])
        order = np.lexsort((found, dist, query))
        query, found, dist = query[order], found[order], dist[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        query, place = query[keep], place[keep]
        self.found[query, place], self.dist[query, place] = found[keep], dist[keep]
        self.held[touched] = np.bincount(np.searchsorted(touched, query), minlength=len(touched))
        full = touched[self.held[touched] == self.k]
        worst = self.dist[full, self.k - 1]
        self.cut[full] = 2.0 * np.maximum(worst, 0.0) if self.metric == "cosine" else worst**2

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The rows held, in batches of bounded size."""
        step = max(1, BLOCK_BYTES // (64 * self.k))
        for start in range(0, len(self.ids), step):
            query, place = np.nonzero(np.arange(self.k) < self.held[start : start + step, None])
            query += start
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.ids[query].tolist(), pa.string()),
                    pa.array(self.found[query, place].tolist(), pa.string()),
                    pa.array(self.dist[query, place], pa.float64()),
                ],
                names=["q_id", "id", "dist"],
            )


# --- few queries: one pass over the base ------------------------------------------------------


def _scan_base(queries: DataFrame, base: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(_unpack(queries.select("id", "vector").toArrow()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        nearest = _Nearest(ids, matrix, k, metric, exclude_self)
        for batch in batches:
            nearest.add(*_unpack(batch))
        yield from nearest.batches()

    # Each task gives k rows a query, so many small parts of the base would give far more rows than it has.
    few = 3 * base.sparkSession.sparkContext.defaultParallelism
    return base.select("id", "vector").coalesce(few).mapInArrow(scan, _RESULT)


# --- many queries: cells around pivots --------------------------------------------------------


class _Cells:
    """The base dealt to its nearest pivots, and for each cell its size, radius and smallest distances to the pivot."""

    def __init__(self, base: DataFrame, wanted: int, metric: str, dim: int):
        context = base.sparkSession.sparkContext
        n_pivots = max(1, min(MAX_PIVOTS, BLOCK_BYTES // (8 * dim)))
        pivot_rows = smallest(base.select("id", "vector"), n_pivots, [uniform("pivot", "id"), F.col("id")])
        _, pivots = _unpack(pivot_rows.toArrow())
        pivots = _unit(pivots) if metric == "cosine" else pivots
        self.tour = _tour(pivots)
        self.far = _distances_to(context.broadcast(pivots), metric)
        placed = base.select("id", "vector").mapInArrow(
            _place(self.far), f"id string, vector {_vector_type(base)}, cell int, reach double"
        )
        self.placed = materialise(placed.withColumn("row", F.monotonically_increasing_id()), "cells")
        self.sizes = self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("reach").alias("radius"))
        # At most n_pivots * wanted numbers come to the driver.
        closest = (
            top_per_key(self.placed.select("cell", "reach", "id"), wanted, ["cell"], [F.col("reach"), F.col("id")])
            .groupBy("cell")
            .agg(F.collect_list("reach").alias("reaches"))
        )
        cells = self.sizes.join(closest, "cell").orderBy("cell").collect()
        self.rows = np.array([c["rows"] for c in cells])
        number = np.array([c["cell"] for c in cells], dtype=np.int64)
        radius = np.array([c["radius"] for c in cells])
        reaches = np.full((len(cells), wanted), np.inf)
        for i, c in enumerate(cells):
            reaches[i, : len(c["reaches"])] = sorted(c["reaches"])
        self.number = number
        self.hits = _hits(context.broadcast((number, radius, reaches)), self.far, wanted)

    def visited(self, queries: DataFrame) -> float:
        """Share of the base that a query of a bounded sample has to be compared with, on average."""
        sample = smallest(queries.select("id", "vector"), SAMPLE_ROWS, [uniform("visits", "id"), F.col("id")])
        matrix = _unpack(sample.toArrow())[1]
        visits = sum(self.rows[cell].sum() for _, cell in self.hits(matrix))
        share = float(visits / (len(matrix) * self.rows.sum()))
        _LOG.info("a sampled query visits %.3f of the base", share)
        return share


def _tour(pivots: np.ndarray) -> np.ndarray:
    """Place of each pivot on a way that goes on to the nearest one not yet seen."""
    place, at = np.full(len(pivots), -1), 0
    for i in range(len(pivots)):
        place[at] = i
        gap = pivots - pivots[at]
        at = int(np.where(place < 0, np.einsum("ij,ij->i", gap, gap), np.inf).argmin())
    return place


def _distances_to(shared_pivots, metric: str) -> Callable[[np.ndarray], np.ndarray]:
    def far(matrix: np.ndarray) -> np.ndarray:
        points = _unit(matrix) if metric == "cosine" else matrix
        centres = shared_pivots.value
        square = (
            np.einsum("ij,ij->i", points, points)[:, None]
            + np.einsum("ij,ij->i", centres, centres)[None, :]
            - 2.0 * points @ centres.T
        )
        return np.sqrt(np.maximum(square, 0.0))

    return far


def _place(far_from: Callable[[np.ndarray], np.ndarray], hits=None, n_cells: int = 0):
    """Rows with their nearest cell and, given ``hits``, a bit for each cell that may hold a neighbour."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _unpack(batch)[1]
            cell, reach = np.empty(len(matrix), dtype=np.int32), np.empty(len(matrix))
            for start in range(0, len(matrix), MAX_PIVOTS):
                far = far_from(matrix[start : start + MAX_PIVOTS])
                nearest = far.argmin(axis=1)
                cell[start : start + len(far)], reach[start : start + len(far)] = nearest, far[np.arange(len(far)), nearest]
            columns = {"id": batch.column("id"), "vector": batch.column("vector"), "cell": pa.array(cell), "reach": pa.array(reach)}
            if hits:
                needs = np.zeros((len(matrix), n_cells), dtype=bool)
                for row, index in hits(matrix):
                    needs[row, index] = True
                columns["needs"] = pa.array([bits.tobytes() for bits in np.packbits(needs, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return place


def _hits(shared_cells, far_from: Callable[[np.ndarray], np.ndarray], wanted: int):
    """A function from vectors to arrays (row, index of a cell) of the cells that may hold a neighbour."""

    def hits(matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        number, radius, reaches = shared_cells.value
        step = max(1, BLOCK_BYTES // (8 * max(1, reaches.size)))
        for start in range(0, len(matrix), step):
            far = far_from(matrix[start : start + step])[:, number]
            bound = np.full(len(far), np.inf)
            if wanted <= reaches.size:
                bounds = (far[:, :, None] + reaches).reshape(len(far), -1)
                bound = np.partition(bounds, wanted - 1, axis=1)[:, wanted - 1]
            # Pivot distances carry a rounding error of about sqrt(eps); widen the bound by it.
            row, cell = np.nonzero(far - radius <= bound[:, None] + 1e-6 * (1.0 + far))
            yield row + start, cell

    return hits


def _join_cells(
    queries: DataFrame, cells: _Cells, n_queries: int, k: int, metric: str, exclude_self: bool, dim: int, block_bytes: int
) -> DataFrame:
    """The grid with blocks of queries from cells side by side, which get only the cells that one of them may need."""
    spark = queries.sparkSession
    n_cells = len(cells.number)
    held = _held_bytes(dim, k) + n_cells // 8 + 1  # and a bit for each cell
    q_blocks, b_shares = _sides(spark, n_queries, int(cells.rows.sum()), held, block_bytes)
    _LOG.info("%s blocks of queries around cells, each met by %s shares of the base", q_blocks, b_shares)
    block_rows = -(-n_queries // q_blocks)
    homes = queries.select("id", "vector").mapInArrow(
        _place(cells.far, cells.hits, n_cells), f"id string, vector {_vector_type(queries)}, cell int, reach double, needs binary"
    )
    homes = materialise(homes.select("id", "vector", "cell", "needs", F.monotonically_increasing_id().alias("row")), "homes")
    # Small tables of a row per pivot at most.
    sizes = {r["cell"]: r["rows"] for r in homes.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).collect()}
    starts, start = [], 0
    for cell in sorted(sizes, key=lambda c: cells.tour[c]):
        starts.append((cell, sizes[cell], start))
        start += sizes[cell]
    starts = F.broadcast(_small(spark, starts, "cell", "rows", "start"))
    block = F.floor((F.col("start") + F.pmod("row", "rows")) / F.lit(block_rows)).cast("int")
    asked = homes.join(starts, "cell").select("id", "vector", "needs", block.alias("block"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, bits = batch.column("block").to_numpy(), _bits(batch)
            for b in np.unique(blocks).tolist():
                any_of = np.bitwise_or.reduce(bits[blocks == b], axis=0)
                seen[b] = seen[b] | any_of if b in seen else any_of
        for b, any_of in seen.items():
            found = np.flatnonzero(np.unpackbits(any_of, count=n_cells))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b), pa.int32()), pa.array(found, pa.int32())], names=["block", "index"])

    wanted = asked.select("block", "needs").mapInArrow(needed, "block int, index int").groupBy("index").agg(F.collect_set("block").alias("blocks"))
    places = [(i, int(c), int(cells.tour[c])) for i, c in enumerate(cells.number)]
    wanted = F.broadcast(wanted.join(F.broadcast(_small(spark, places, "index", "cell", "place")), "index"))
    met = cells.placed.join(wanted, "cell").withColumn("block", F.explode("blocks"))
    met = met.withColumn("task", F.col("block") * b_shares + F.pmod("row", F.lit(b_shares)).cast("int"))
    asked = asked.withColumn("task", F.explode(F.sequence(F.col("block") * b_shares, (F.col("block") + 1) * b_shares - 1)))
    return _grid(asked, met, q_blocks * b_shares, k, metric, exclude_self)


# --- many queries: a grid of large blocks -----------------------------------------------------


def _sides(spark, n_queries: int, n_base: int, held: int, block_bytes: int) -> tuple[int, int]:
    """Blocks of queries and shares of the base: blocks fit ``block_bytes``, tasks keep all cores busy, few rows are copied."""
    context = spark.sparkContext
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * context.defaultParallelism)
    even = round((tasks * n_queries / max(1, n_base)) ** 0.5)
    q_blocks = max(1, -(-n_queries * held // block_bytes), min(even, tasks, n_queries))
    return q_blocks, max(1, -(-tasks // q_blocks))


def _join_blocks(
    queries: DataFrame, base: DataFrame, n_queries: int, k: int, metric: str, exclude_self: bool, dim: int, block_bytes: int
) -> DataFrame:
    """Task (q, b) of the grid holds block q of the queries and streams share b of the base.

    Rows are dealt round robin by a stored number, so ids and vectors that repeat spread like any others.
    """

    def numbered(side: DataFrame, label: str) -> DataFrame:
        return materialise(side.select("id", "vector", F.monotonically_increasing_id().alias("row")), label)

    def over(last: int):
        return F.explode(F.sequence(F.lit(0), F.lit(last - 1)))

    asked, met = numbered(queries, "query-blocks"), numbered(base, "base-shares")
    q_blocks, b_shares = _sides(base.sparkSession, n_queries, met.count(), _held_bytes(dim, k), block_bytes)
    _LOG.info("%s blocks of queries, each met by %s shares of the base", q_blocks, b_shares)
    asked = asked.withColumn("other", over(b_shares))
    asked = asked.withColumn("task", (F.pmod("row", F.lit(q_blocks)) * b_shares + F.col("other")).cast("int"))
    met = met.withColumn("other", over(q_blocks))
    met = met.withColumn("task", (F.col("other") * b_shares + F.pmod("row", F.lit(b_shares))).cast("int"))
    return _grid(asked, met, q_blocks * b_shares, k, metric, exclude_self)


def _grid(asked: DataFrame, met: DataFrame, tasks: int, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """Each ``task`` holds its queries and streams its base rows past them, cell by cell where queries say which they need."""
    alike = _vector_type(asked) == _vector_type(met)
    with_cells = "needs" in asked.columns

    def side(rows: DataFrame, is_base: bool) -> DataFrame:
        columns = {"vector": F.col("vector") if alike else F.col("vector").cast("array<double>"), "is_base": F.lit(is_base)}
        for name, kind in (("needs", "binary"), ("index", "int"), ("place", "int")) if with_cells else ():
            columns[name] = F.col(name) if name in rows.columns else F.lit(None).cast(kind)
        return rows.select("task", "id", *[c.alias(name) for name, c in columns.items()])

    both = side(asked, False).unionByName(side(met, True))
    both = both.repartitionById(tasks, F.col("task")).sortWithinPartitions("is_base", *["place"] * with_cells)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nearest, needs = [], None, None
        for batch in batches:
            first = batch.column("is_base").true_count  # queries come before the base
            asked, met = batch.slice(0, batch.num_rows - first), batch.slice(batch.num_rows - first)
            if asked.num_rows:
                block.append((*_unpack(asked), *([_bits(asked)] if with_cells else [])))
            if not met.num_rows or not block and nearest is None:
                continue
            if nearest is None:
                ids, vectors, *bits = (np.concatenate(parts) for parts in zip(*block, strict=True))
                block.clear()
                nearest = _Nearest(ids, vectors, k, metric, exclude_self)
                needs = np.ascontiguousarray(bits[0].T) if bits else None
                del bits
            ids, vectors = _unpack(met)
            if needs is None:
                nearest.add(ids, vectors)
                continue
            cell = met.column("index").to_numpy()
            for start, end in _runs(cell):
                some = np.unique(cell[start:end])
                concerned = np.flatnonzero((needs[some >> 3] & (128 >> (some & 7)).astype(np.uint8)[:, None]).any(axis=0))
                nearest.add(ids[start:end], vectors[start:end], concerned if len(concerned) < len(nearest.ids) else None)
        if nearest is not None:
            yield from nearest.batches()

    return both.mapInArrow(stream, _RESULT)


def _small(spark, rows: list[tuple], *names: str) -> DataFrame:
    """Numbers of the driver as a table."""
    return spark.createDataFrame(pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, zip(*rows, strict=True), strict=True)}))


def _bits(batch: pa.RecordBatch) -> np.ndarray:
    """The bits of ``needs``, a row of bytes each."""
    return np.frombuffer(b"".join(batch.column("needs").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)


def _runs(cell: np.ndarray) -> list[tuple[int, int]]:
    """Whole cells of rows in order, put together until a run has ``MIN_CHUNK_ROWS``."""
    runs, start = [], 0
    for end in [*(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]:
        if end - start >= MIN_CHUNK_ROWS or end == len(cell):
            runs.append((start, end))
            start = end
    return runs


def cosine_topn(queries: DataFrame, base: DataFrame, n: int = 20, **options) -> DataFrame:
    """The ``n`` nearest by cosine distance, the item itself left out."""
    return knn_join(queries, base, n, metric="cosine", exclude_self=True, **options)
