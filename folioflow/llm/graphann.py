"""Approximate nearest neighbours by inner product over robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.llm.vectors import matrix, usable
from folioflow.session import materialise

SHARD_ROWS = 4096
QUERY_BLOCK = 4096
DEGREE = 40
BEAM = 96
BUILD_BEAM = 72
RELAXATION = 1.15
# Lengths in a shard differ by no more than this power of two.
BAND_BITS = 2
_EXPAND = 4
_BATCH = 256


@dataclass
class Graph:
    """``points`` are searched; ``links`` holds the out-neighbours of every point, filled up with -1."""

    points: np.ndarray
    links: np.ndarray
    entry: int


def beam_search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points met by greedy best-first search, with squared distances; -1 where fewer.

    All queries of a batch advance together, each expanding its few nearest open points.
    """
    n, width = len(graph.points), len(queries)
    norms = np.einsum("ij,ij->i", graph.points, graph.points)
    ids = np.full((width, beam), -1, dtype=np.int32)
    far = np.full((width, beam), np.inf, dtype=np.float32)
    done = np.ones((width, beam), dtype=bool)
    stamp = np.zeros((width, n), dtype=np.int32)  # 0: not met
    ids[:, 0], done[:, 0] = graph.entry, False
    far[:, 0] = norms[graph.entry] - 2 * queries @ graph.points[graph.entry]
    stamp[:, graph.entry] = 1
    slots = np.arange(1, _EXPAND * graph.links.shape[1] + 1, dtype=np.int32)[None, :]
    active = np.arange(width)
    while len(active):
        open_at = np.argsort(done[active], axis=1, kind="stable")[:, :_EXPAND]
        fresh = ~np.take_along_axis(done[active], open_at, axis=1)
        active, open_at, fresh = active[fresh[:, 0]], open_at[fresh[:, 0]], fresh[fresh[:, 0]]
        if not len(active):
            break
        at = active[:, None]
        chosen = np.where(fresh, ids[at, open_at], -1)
        done[at, open_at] = True
        near = np.where(chosen[:, :, None] >= 0, graph.links[chosen], -1).reshape(len(active), -1)
        safe = np.maximum(near, 0)
        new = (near >= 0) & (stamp[at, safe] == 0)
        r, c = np.nonzero(new)
        stamp[active[r], near[r, c]] = slots[0, c]
        new[r, c] = stamp[active[r], near[r, c]] == slots[0, c]  # one of each repeated neighbour
        r, c = np.nonzero(new)
        found = near[r, c]
        distance = np.full(near.shape, np.inf, dtype=np.float32)
        distance[r, c] = norms[found] - 2 * np.einsum("ij,ij->i", queries[active[r]], graph.points[found])
        all_far = np.concatenate([far[active], distance], axis=1)
        all_ids = np.concatenate([ids[active], np.where(new, near, -1)], axis=1)
        all_done = np.concatenate([done[active], ~new], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_far, best, axis=1), axis=1, kind="stable"), axis=1)
        far[active], ids[active], done[active] = (np.take_along_axis(x, best, axis=1) for x in (all_far, all_ids, all_done))
    return ids, far


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, relaxation: float) -> np.ndarray:
    """Diverse neighbours of every owner: the nearest candidate stays and removes those that it is closer to.

    A candidate goes when ``relaxation`` times its distance to a kept one is no more than its distance to
    the owner. ``candidates`` hold -1 where there is none; kept neighbours come nearest first.
    """
    norms = np.einsum("ij,ij->i", points, points)
    safe = np.maximum(candidates, 0)
    vectors = points[safe]
    own = norms[owners][:, None] + norms[safe] - 2 * np.einsum("bd,bcd->bc", points[owners], vectors)
    own[(candidates < 0) | (candidates == owners[:, None])] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    own = np.take_along_axis(own, order, axis=1)
    safe = np.take_along_axis(safe, order, axis=1)
    vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
    alive = np.isfinite(own)
    rows = np.arange(len(owners))
    kept = np.full((len(owners), degree), -1, dtype=np.int32)
    factor = np.float32(relaxation * relaxation)
    for slot in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, slot] = safe[rows, first][some]
        between = norms[safe] + norms[safe[rows, first]][:, None] - 2 * np.einsum("bd,bcd->bc", vectors[rows, first], vectors)
        alive &= ~((factor * between <= own) & some[:, None])
        alive[rows, first] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxation: float = RELAXATION, seed: int = 3) -> Graph:
    """Insert all points in a random order, in batches that double: search, prune, link back.

    The first insertions link to every earlier point. Back links fill up to twice the degree, then the
    point is pruned again.
    """
    n = len(points)
    order = np.random.default_rng(seed).permutation(n)
    centre = points.mean(axis=0)
    entry = int(((points - centre) ** 2).sum(axis=1).argmin())
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int64)
    links = np.full((n, 2 * degree), -1, dtype=np.int32)
    counts = np.zeros(n, dtype=np.int64)
    graph = Graph(points, links, entry)
    start = 1
    while start < n:
        batch = order[start : start + max(1, min(start, _BATCH))]
        if start <= beam:
            candidates = np.tile(order[: start + len(batch)], (len(batch), 1))
        else:
            candidates = beam_search(graph, points[batch], beam)[0]
        kept = robust_prune(points, batch, candidates, degree, relaxation)
        links[batch, :degree] = kept
        counts[batch] = (kept >= 0).sum(axis=1)
        r, c = np.nonzero(kept >= 0)
        _link_back(graph, counts, kept[r, c], batch[r], degree, relaxation)
        start += len(batch)
    full = np.flatnonzero(counts > degree)
    for part in np.array_split(full, max(1, len(full) // _BATCH)):
        if len(part):
            kept = robust_prune(points, part, links[part], degree, relaxation)
            links[part] = -1
            links[part, :degree] = kept
    graph.links = np.ascontiguousarray(links[:, :degree])
    return graph


def _link_back(graph: Graph, counts: np.ndarray, targets: np.ndarray, sources: np.ndarray, degree: int, relaxation: float) -> None:
    order = np.argsort(targets, kind="stable")
    targets, sources = targets[order], sources[order]
    owners, first, size = np.unique(targets, return_index=True, return_counts=True)
    place = counts[targets] + np.arange(len(targets)) - np.repeat(first, size)
    room = graph.links.shape[1]
    fits = place < room
    graph.links[targets[fits], place[fits]] = sources[fits]
    over = np.flatnonzero(counts[owners] + size > room)
    counts[owners] = np.minimum(counts[owners] + size, room)
    for owner in np.array_split(over, max(1, len(over) // _BATCH)):
        if not len(owner):
            continue
        widest = int(size[owner].max())
        more = np.full((len(owner), widest), -1, dtype=np.int32)
        for row, k in enumerate(owner):
            more[row, : size[k]] = sources[first[k] : first[k] + size[k]]
        nodes = owners[owner]
        both = np.concatenate([graph.links[nodes], more], axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        kept = robust_prune(graph.points, nodes, both, degree, relaxation)
        graph.links[nodes] = -1
        graph.links[nodes, :degree] = kept
        counts[nodes] = (kept >= 0).sum(axis=1)


def _lifted(rows: np.ndarray) -> np.ndarray:
    """Scaled to the longest row; one more component makes all lengths 1, so that distance to a query orders by inner product."""
    rows = rows / np.abs(rows).max()
    squares = (rows**2).sum(axis=1)
    rows, squares = rows / np.sqrt(squares.max()), squares / squares.max()
    return np.concatenate([rows, np.sqrt(np.maximum(1 - squares, 0))[:, None]], axis=1).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def band(vector: str) -> Column:
    """Bands of lengths, each ``BAND_BITS`` powers of two wide; at most about a thousand hold all finite doubles."""
    largest = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
    return F.floor((F.log2(largest) + F.log2(squares) / 2) / BAND_BITS).cast("int")


def build_shard(rows: pa.Table) -> pa.Table:
    """One row: the shard's distinct vectors, the ids that each stands for, and the graph."""
    table = rows.sort_by([("vec_id", "ascending")])
    vectors = matrix(table.column("vector"))
    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    owner = owner.ravel()
    order = np.argsort(owner, kind="stable")
    ids = table.column("vec_id").to_numpy()[order]
    graph = build(_lifted(distinct))
    held = io.BytesIO()
    np.savez(held, vectors=distinct, ids=ids, ends=np.cumsum(np.bincount(owner)), links=graph.links, entry=graph.entry)
    first = {c: [rows.column(c)[0].as_py()] for c in ("shard", "band", "size")}
    return pa.table({**first, "graph": [held.getvalue()]}, schema=_SHARDS)


_SHARDS = pa.schema([("shard", pa.int64()), ("band", pa.int32()), ("size", pa.int32()), ("graph", pa.binary())])
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_shard(shard: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    """Up to ``k`` nearest ids of the shard for every query of a block, measured again in doubles."""
    with np.load(io.BytesIO(shard.column("graph")[0].as_py())) as stored:
        vectors, ids, ends = stored["vectors"], stored["ids"], stored["ends"]
        graph = Graph(_lifted(vectors), stored["links"], int(stored["entry"]))
    starts = ends - np.diff(ends, prepend=0)
    asked = matrix(queries.column("vector"))
    names = queries.column("vec_id").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(asked), _BATCH):
        part = asked[at : at + _BATCH]
        lifted = np.concatenate([_unit(part), np.zeros((len(part), 1))], axis=1).astype(np.float32)
        met, _ = beam_search(graph, lifted, beam)
        for row, found in enumerate(met):
            found = found[found >= 0]
            scores = vectors[found] @ part[row]
            sizes = ends[found] - starts[found]
            members = np.repeat(starts[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            members, scores = ids[members], np.repeat(scores, sizes)
            other = members != names[at + row]
            members, scores = members[other], scores[other]
            best = np.lexsort((members, -scores))
            best = best[np.sort(np.unique(members[best], return_index=True)[1])[:k]]  # each id once, at its best score
            out.append((np.full(len(best), names[at + row]), members[best], scores[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table(dict(zip(_HITS.names, columns, strict=True)), schema=_HITS)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = BEAM, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The ``k`` ids of ``vectors`` with the largest inner product for every query: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id, embedding``. Ranks start at 1, ties go to the smaller ``vec_id``, a query's
    own id is left out, and scores are doubles of the original vectors. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without an id, take no part; vectors of another length are
    no candidates. Fewer candidates give fewer rows, an empty table none; other columns are not read. Repeated
    rows count once, and an id with several vectors counts at its best score.

    Rows are dealt by bands of their length, and in a band to shards of about ``shard_rows`` by a hash of the
    vector, so that no long vector hides the differences of short ones, and copies meet in a shard and are
    one point of its graph. Repeated rows are dropped first. Of the copies of a vector only the first ``k`` + 1
    ids can ever be returned, and Spark cuts to those inside each task, so a hot vector stays small. Every block of queries searches
    every shard; a query's hits, ``k`` per shard, are merged at the end.
    """
    keep = [F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector")]
    rows, asked = (t.select(*keep).where(F.col("vec_id").isNotNull() & usable("vector")) for t in (vectors, queries))
    rows = rows.withColumns({"_a": F.xxhash64("vector"), "_b": F.xxhash64(F.size("vector"), "vector"), "size": F.size("vector"), "band": band("vector")})
    rows = rows.dropDuplicates(["_a", "_b", "vec_id"])
    first = Window.partitionBy("_a", "_b").orderBy("vec_id")
    rows = materialise(rows.withColumn("_copy", F.row_number().over(first)).where(F.col("_copy") <= k + 1).drop("_copy"), "ann-rows")
    kind = ["size", "band"]
    points = rows.select("_a", "_b", *kind).distinct().groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    shards = materialise(points.select(*kind, F.ceil(F.col("n") / shard_rows).cast("bigint").alias("shards")), "ann-shards")
    blocks = max(1, -(-asked.count() // query_block))
    sharded = rows.join(shards, kind).select(F.pmod("_a", F.col("shards")).alias("shard"), *kind, "vec_id", "vector")
    graphs = sharded.groupBy("shard", *kind).applyInArrow(build_shard, "shard bigint, band int, size int, graph binary")
    graphs = materialise(graphs, "ann-graphs")
    by = ["shard", *kind, "block"]
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    left = graphs.select("shard", *kind, every_block.alias("block"), "graph")
    every_shard = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1))
    asked = asked.withColumns({"size": F.size("vector"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks))})
    right = asked.join(shards, "size").select(every_shard.alias("shard"), *kind, "block", "vec_id", "vector")

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        return search_shard(shard, block, k, beam) if len(shard) and len(block) else _HITS.empty_table()

    hits = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
