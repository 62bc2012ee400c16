"""Prefix trie of conversations, rolled up by centroid decomposition of its parent links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.session import materialise

# Components of at most this many nodes are decomposed inside one task; larger ones by Spark joins, halved each round.
COMPONENT_NODES = 1 << 14
# Characters of joined ids in one row on their way to a digest.
ID_BLOCK = 1 << 16

NODE = ["depth", "k1", "k2"]
COMPONENT = ["c_depth", "c1", "c2"]


def _running(rows: DataFrame, order: list[Column], keep: dict[str, Column], tags: list[str], label: str) -> DataFrame:
    """Rows sorted by ``conv`` and ``order``, with running totals inside each conversation, stored.

    ``keep`` are bigint columns; ``tags`` those of them of which the exclusive or runs. Adds ``n`` (from 1),
    ``r_`` and ``f_`` columns (running and first value of a tag) and ``last``. The sort range-partitions on
    the whole key, so a conversation that holds a third of the rows spreads; totals run along each sorted
    partition as it streams. What a conversation brings from the partitions before follows from the first
    and last row of each, at most two rows a partition, and is joined as a broadcast table.
    """
    names = ["conv", *keep]
    added = ["n", *(f"r_{t}" for t in tags), *(f"f_{t}" for t in tags)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: pa.Table | None = None
        state: tuple | None = None  # conversation, rows so far, running and first tags
        head = True
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            if waiting.num_rows > 1:  # whether the last row ends its conversation shows in the next batch
                out, state = _totals(waiting, tags, state, waiting.num_rows - 1, head, part)
                waiting, head = waiting.slice(waiting.num_rows - 1), False
                yield from out.to_batches()
        if waiting is not None and waiting.num_rows:
            yield from _totals(waiting, tags, state, waiting.num_rows, head, part)[0].to_batches()

    schema = ", ".join(f"{c} bigint" for c in [*names, *added]) + ", last boolean, _part bigint, _head boolean, _tail boolean"
    placed = rows.orderBy("conv", *order).select("conv", *[c.alias(n) for n, c in keep.items()]).mapInArrow(run, schema)
    placed = materialise(placed, label)
    edges = placed.where("_head or _tail").orderBy("_part", F.col("_head").desc()).collect()
    came, state = [], None
    for edge in edges:
        if edge["_head"]:
            goes_on = state is not None and state[0] == edge["conv"]
            if goes_on:
                came[-1][-1] = True
            came.append([edge["_part"], edge["conv"], *(state[1:] if goes_on else [None] * len(added)), False])
        if edge["_tail"]:
            own = [edge[c] for c in added]
            if state is not None and state[0] == edge["conv"]:
                own = [own[0] + state[1], *(x ^ y for x, y in zip(own[1 : 1 + len(tags)], state[2:])), *state[2 + len(tags) :]]
            if came[-1][1] != edge["conv"]:
                came.append([edge["_part"], edge["conv"], *[None] * len(added), False])
            state = (edge["conv"], *own)
    fields = ", ".join(f"c_{c} bigint" for c in added)
    before = rows.sparkSession.createDataFrame([tuple(c) for c in came], f"_part bigint, conv bigint, {fields}, goes_on boolean")
    out = placed.join(F.broadcast(before), ["_part", "conv"], "left")
    zero = F.lit(0).cast("bigint")
    totals = {"n": F.col("n") + F.coalesce("c_n", zero), "last": F.col("last") & ~(F.col("_tail") & F.coalesce("goes_on", F.lit(False)))}
    for t in tags:
        totals[f"r_{t}"] = F.col(f"r_{t}").bitwiseXOR(F.coalesce(f"c_r_{t}", zero))
        totals[f"f_{t}"] = F.coalesce(f"c_f_{t}", f"f_{t}")
    return out.withColumns(totals).select(*names, *added, "last")


def _totals(table: pa.Table, tags: list[str], state: tuple | None, rows: int, head: bool, part: int) -> tuple[pa.Table, tuple]:
    """The first ``rows`` rows with their totals, and the state behind them."""
    conv = table.column("conv").to_numpy()
    n = len(conv)
    begins = np.ones(n, dtype=bool)
    begins[1:] = conv[1:] != conv[:-1]
    joined = state is not None and state[0] == conv[0]
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    first = (start == 0) & joined
    columns = [np.arange(n) - start + 1 + np.where(first, state[1] if joined else 0, 0)]
    values = [table.column(t).to_numpy() for t in tags]
    for k, value in enumerate(values):
        runs = np.bitwise_xor.accumulate(value)
        before = np.where(start > 0, runs[start - 1], state[2 + k] if joined else 0)
        columns.append(runs ^ before)
    for k, value in enumerate(values):
        columns.append(np.where(first, state[2 + len(tags) + k] if joined else 0, value[start]))
    ends = np.append(begins[1:], True)
    tail = np.zeros(n, dtype=bool)
    tail[-1] = rows == n
    heads = np.zeros(n, dtype=bool)
    heads[0] = head
    names = ["n", *(f"r_{t}" for t in tags), *(f"f_{t}" for t in tags), "last", "_part", "_head", "_tail"]
    for name, column in zip(names, [*columns, ends, np.full(n, part), heads, tail], strict=True):
        table = table.append_column(name, pa.array(column))
    at = rows - 1
    return table.slice(0, rows), (int(conv[at]), *(int(c[at]) for c in columns))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(``conv``, ``pos`` from 0, ``h1``, ``h2``, ``words``): the turns of every conversation in order.

    Order: ``turn``, nulls first, then role and text. Null roles and texts are empty. Rows without a
    ``conv_id`` belong to no conversation and are left out; repeated rows are turns of their own. Other
    columns are not read. Texts move once, to be sorted; then a turn is two hashes and a word count.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")
    )
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("bigint")
    keep = {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "role", "text"), "words": words}
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return _running(turns, order, keep, [], "turns").select("conv", (F.col("n") - 1).alias("pos"), *keep)


def shared_beginnings(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilds every conversation on the first turns of its group's first one: (turns, all ids and their turns).

    Conversation c begins with the first h turns of c - c % ``group`` (all if it has fewer, none if it is
    absent) and goes on with its own after its first h; h is crc32 of the decimal id modulo ``most``. The
    remainder has the sign of c. A base gives at most ``most`` - 1 turns to fewer than 2 ``group`` others.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    firsts = turns.where((F.col("pos") < most - 1) & (F.col("conv") % group == 0)).groupBy(F.col("conv").alias("base"))
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("firsts"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": h}).join(firsts, "base", "left")
    shared = F.filter(F.coalesce("firsts", F.array()), lambda t: t["pos"] < F.col("h"))
    convs = convs.withColumn("shared", shared).withColumn("moved", F.size("shared") - F.col("h"))
    convs = materialise(convs.select("conv", "own", "h", "moved", "shared"), "conversations")
    short = convs.where("moved < 0").select("conv", "moved")
    own = turns.where(F.col("pos") >= h).join(short, "conv", "left")
    own = own.withColumn("pos", F.col("pos") + F.coalesce("moved", F.lit(0)))
    columns = ["conv", "pos", "h1", "h2", "words"]
    given = convs.select("conv", F.explode("shared").alias("t")).select("conv", "t.*")
    length = F.size("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return given.select(*columns).unionByName(own.select(*columns)), convs.select("conv", length.alias("length"))


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int = COMPONENT_NODES) -> DataFrame:
    """The trie of turn sequences: one row per distinct beginning of a conversation, root included.

    ``turns`` are those of ``ordered_turns`` with positions gapless from 0, ``convs`` the ids of all
    conversations with their ``length`` in turns, 0 too. No conversation gives no rows.

    A node is known by its depth and the exclusive or, over its turns, of two hashes of turn and position,
    so that prefixes are running totals and a long conversation splits over tasks. ``n_convs``, children
    and subtree sizes are sums over conversations; the other subtree totals come from ``rollup``.
    """
    tag = {"t1": F.xxhash64("h1", "h2", "pos"), "t2": F.xxhash64(F.lit("second"), "h1", "h2", "pos")}
    paths = _running(turns, [F.col("pos")], {"words": F.col("words"), **tag}, ["t1", "t2"], "paths").select(
        "conv",
        F.col("n").alias("depth"),
        *[F.col(f"r_t{k}").alias(f"k{k}") for k in (1, 2)],
        *[F.col(f"r_t{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)],
        *[F.col(f"f_t{k}").alias(f"c{k}") for k in (1, 2)],
        "words",
        "last",
    )
    columns = ["p1", "p2", "c1", "c2", "words"]
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in columns]
    )
    nodes = materialise(nodes, "nodes")
    # A node's children and the node itself meet as rows of one key, summed before they are shuffled.
    values = ["conv_id", "n_convs", *columns]
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    upward = nodes.where("depth > 1").select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"),
        *[F.lit(None).cast("bigint").alias(c) for c in values], one.alias("child"),
    )
    nodes = nodes.withColumn("child", zero).unionByName(upward).groupBy(*NODE)
    nodes = nodes.agg(*[F.min(c).alias(c) for c in values], F.sum("child").alias("n_children"))
    first = convs.agg(F.min("conv").alias("root"), F.count(F.lit(1)).alias("all")).where("all > 0")
    nodes = nodes.withColumns(
        {
            "leaf": (F.col("n_children") == 0).cast("bigint"),
            "saved": (F.col("n_convs") - 1) * F.col("words"),
            "above": F.lit(None).cast("bigint"),
        }
    )
    totals = materialise(rollup(paths, nodes, ["leaf", "saved"], ["n_convs", "n_children"], limit), "totals")

    ends = paths.where("last").select(*NODE, "conv")
    silent = convs.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv")
    digests = id_digests(ends.unionByName(silent))

    sums = totals.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    root = first.join(F.broadcast(sums)).select(
        *[zero.alias(c) for c in NODE],
        F.col("root").alias("conv_id"),
        F.lit(None).cast("bigint").alias("above"),
        F.col("all").alias("n_convs"),
        "n_children",
        F.coalesce("leaf", one).alias("leaf"),
        F.coalesce("saved", zero).alias("saved"),
    )
    under = totals.join(F.broadcast(first.select("root")), F.col("depth") == 1, "left").withColumn("above", F.coalesce("above", "root"))
    whole = root.unionByName(under.select(*root.columns)).join(digests, NODE, "left")
    return whole.select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("bigint").alias("n_children"),
        F.col("leaf").cast("bigint").alias("n_leaves"),
        F.col("saved").cast("bigint").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def rollup(paths: DataFrame, nodes: DataFrame, values: list[str], keep: list[str], limit: int = COMPONENT_NODES) -> DataFrame:
    """Nodes with the sums of ``values`` over their subtrees, by centroid decomposition, and their parent's ``conv_id``.

    ``above`` is null for first turns. Without the root, whose removal is the first split, every first turn
    is the top of a component. A round takes of each component of more than ``limit`` nodes its centroid, the
    deepest node whose subtree holds more than half of it; adds the total of that subtree to the nodes
    between it and the top; and splits: what hangs below the centroid becomes components of their own, the
    centroid one of a single node that holds the total, and the rest stays, with its sizes lessened along
    that path. Every part has at most half of the nodes, so rounds grow with the logarithm of nodes /
    ``limit``, and a node gets at most one addition a round, however deep the trie. Smaller components are
    finished the same way inside tasks.

    The first subtree sizes need no rollup: the nodes that a conversation is the smallest member of are
    the end of its path, so a node's size is a sum over its members. Which nodes lie below a centroid
    follows from their smallest members too: those that pass through the centroid.
    """
    columns = [*NODE, "p1", "p2", "conv_id", "above", *keep, *values]
    tree = materialise(nodes.select(*columns, F.lit(1).cast("bigint").alias("c_depth"), "c1", "c2"), "tree")
    large = tree.groupBy(*COMPONENT).agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > limit)
    done, added = [tree], []
    if not large.isEmpty():
        large = materialise(large, "components")
        done = [tree.join(large, COMPONENT, "left_anti")]
        big = tree.join(large, COMPONENT)
        ends = big.groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("_from"), F.max("depth").alias("_to"))
        sizes = paths.select("conv", *NODE).join(ends, "conv").groupBy(*NODE)
        sizes = sizes.agg(F.sum(F.col("_to") - F.greatest("_from", "depth") + 1).alias("size"))
        big = materialise(big.join(sizes, NODE), "tree")
        while not big.isEmpty():
            rest, way = _split(paths, big.drop("_all"), values, [*columns, *COMPONENT, "size"])
            added.append(way.select(*NODE, *values))
            large = rest.groupBy(*COMPONENT).agg(F.max("size").alias("_all")).where(F.col("_all") > limit)
            large = materialise(large, "components")
            done.append(rest.join(large, COMPONENT, "left_anti"))
            big = materialise(rest.join(large, COMPONENT), "tree")
    small = reduce(DataFrame.unionByName, [d.select(*columns, *COMPONENT) for d in done])
    names = [*NODE, "conv_id", "above", *keep, *values]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_components(batches):
            keys = list(zip(*(group[c] for c in NODE), strict=True))
            index = {k: i for i, k in enumerate(keys)}
            tops = set(zip(*(group[c] for c in COMPONENT), strict=True))
            parents = [
                -1 if key in tops else index[key[0] - 1, p1, p2]
                for key, p1, p2 in zip(keys, group["p1"], group["p2"], strict=True)
            ]
            group["above"] = [a if p < 0 else group["conv_id"][p] for p, a in zip(parents, group["above"], strict=True)]
            totals = centroid_totals(parents, [group[v] for v in values])
            found = [*(group[c] for c in names[: -len(values)]), *totals]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

    finished = small.repartition(*COMPONENT).sortWithinPartitions(*COMPONENT, "depth").mapInArrow(
        finish, ", ".join(f"{c} bigint" for c in names)
    )
    if not added:
        return finished
    more = reduce(DataFrame.unionByName, added).groupBy(*NODE).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    finished = finished.join(more, NODE, "left")
    return finished.withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).select(*names)


def _split(paths: DataFrame, big: DataFrame, values: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over large components: their parts with new components and sizes, and what is added to nodes."""
    whole = big.groupBy(*COMPONENT).agg(F.max("size").alias("_all"))
    centre = F.max(F.struct("depth", "k1", "k2", "p1", "p2", "conv_id", "size")).alias("centre")
    centres = big.join(whole, COMPONENT).where(F.col("size") * 2 > F.col("_all")).groupBy(*COMPONENT).agg(centre)
    parts = ("depth", "k1", "k2", "p1", "p2", "conv_id", "size")
    centres = materialise(centres.select(*COMPONENT, *[F.col(f"centre.{c}").alias(f"m_{c}") for c in parts]), "centres")
    at = [F.col(c) == F.col(f"m_{c}") for c in NODE]
    through = paths.select("conv", *NODE).join(centres, at).select("conv", *COMPONENT, "m_depth", "m_conv_id")
    after = paths.select("conv", (F.col("depth") - 1).alias("m_depth"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    through = through.join(after, ["conv", "m_depth"], "left").withColumnRenamed("conv", "conv_id")
    placed = big.join(through, ["conv_id", *COMPONENT], "left")
    placed = placed.withColumn("_below", F.coalesce(F.col("depth") >= F.col("m_depth"), F.lit(False)))
    placed = materialise(placed, "placed")
    sums = placed.where("_below").groupBy(*COMPONENT).agg(*[F.sum(v).alias(v) for v in values])
    parents = placed.select(*[F.col(c).alias(f"u_{c}") for c in (*NODE, "conv_id")])
    is_parent = [F.col("m_depth") - 1 == F.col("u_depth"), F.col("m_p1") == F.col("u_k1"), F.col("m_p2") == F.col("u_k2")]
    centres = materialise(centres.join(sums, COMPONENT).join(parents, is_parent, "left"), "centres")
    way = paths.select("conv", *NODE).join(centres.withColumnRenamed("m_conv_id", "conv"), "conv")
    way = way.where((F.col("depth") < F.col("m_depth")) & (F.col("depth") >= F.col("c_depth")))
    way = materialise(way.select(*NODE, *values, "m_size"), "way")
    inner = placed.where(F.col("_below") & (F.col("depth") > F.col("m_depth"))).withColumns(
        {
            "c_depth": F.col("m_depth") + 1,
            "c1": F.col("n1"),
            "c2": F.col("n2"),
            "above": F.when(F.col("depth") == F.col("m_depth") + 1, F.col("m_conv_id")).otherwise(F.col("above")),
        }
    )
    upper = placed.where(~F.col("_below")).join(way.select(*NODE, "m_size"), NODE, "left")
    upper = upper.withColumn("size", F.col("size") - F.coalesce("m_size", F.lit(0)))
    middle = placed.where(F.col("_below") & (F.col("depth") == F.col("m_depth"))).drop(*values)
    middle = middle.join(centres.select(*COMPONENT, *values, "u_conv_id"), COMPONENT).withColumns(
        {
            "above": F.coalesce("above", "u_conv_id"),
            "size": F.lit(1).cast("bigint"),
            "c_depth": F.col("depth"),
            "c1": F.col("k1"),
            "c2": F.col("k2"),
        }
    )
    rest = inner.select(*columns).unionByName(upper.select(*columns)).unionByName(middle.select(*columns))
    return materialise(rest, "tree"), way


def _whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of batches cut where a component ends; what is not yet whole waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = [held.column(c)[held.num_rows - 1].as_py() for c in COMPONENT] if held.num_rows else []
        columns = [held.column(c).to_pylist() for c in COMPONENT]
        cut = held.num_rows
        while cut and [c[cut - 1] for c in columns] == last:
            cut -= 1
        if cut:
            yield held.slice(0, cut).to_pydict()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.to_pydict()


def centroid_totals(parents: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree sums of a forest by centroid decomposition; a parent stands before its children, -1 marks tops."""
    n = len(parents)
    totals = [[0] * n for _ in values]
    trees: dict[int, list[int]] = {}
    part = [0] * n
    for i, p in enumerate(parents):
        part[i] = i if p < 0 else part[p]
        trees.setdefault(part[i], []).append(i)
    waiting = list(trees.values())
    size, below = [0] * n, [-1] * n
    while waiting:
        nodes = waiting.pop()
        top, count = nodes[0], len(nodes)
        if count == 1:
            for total, value in zip(totals, values, strict=True):
                total[top] += value[top]
            continue
        for i in nodes:
            size[i], below[i] = 1, -1
        for i in reversed(nodes[1:]):
            size[parents[i]] += size[i]
        centre = next(i for i in reversed(nodes) if size[i] * 2 > count)
        below[centre] = centre
        split: dict[int, list[int]] = {}
        upper, inside = [], [centre]
        for i in nodes:
            if i == centre:
                continue
            above = below[parents[i]] if i != top else -1
            if above < 0:
                upper.append(i)
                continue
            below[i] = i if above == centre else above
            split.setdefault(below[i], []).append(i)
            inside.append(i)
        for total, value in zip(totals, values, strict=True):
            whole = sum(value[i] for i in inside)
            i = centre
            while True:
                total[i] += whole
                if i == top:
                    break
                i = parents[i]
        waiting += split.values()
        if upper:
            waiting.append(upper)
    return totals


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ``digest``): SHA-256 of the decimal ids in ``conv`` of each node, ascending, joined by commas.

    A digest is read in order, so one task must read all of a node's ids. It gets them as blocks of joined
    ids that sorted range partitions have made, a few thousand ids a row, and holds one block at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            length = 0
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv")), strict=True):
                if not out or out[-1][0] != node or length > ID_BLOCK:
                    out.append([node, conv, []])
                    length = 0
                out[-1][2].append(str(conv))
                length += len(out[-1][2][-1]) + 1
            arrays = [pa.array([o[0][k] for o in out], pa.int64()) for k in range(len(NODE))]
            arrays += [pa.array([o[1] for o in out], pa.int64()), pa.array([",".join(o[2]) for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names = [*NODE, "digest"]

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            types = [pa.int64()] * len(NODE) + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield batch_of(out)
        if node:
            yield batch_of([(*node, state.hexdigest())])

    key = ", ".join(f"{c} bigint" for c in NODE)
    ends = ends.select(*[F.col(c).cast("bigint").alias(c) for c in (*NODE, "conv")])
    blocks = ends.orderBy(*NODE, "conv").mapInArrow(join, f"{key}, first bigint, ids string")
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(digest, f"{key}, digest string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, each rebuilt on its group's shared beginning."""
    return prefix_trie(*shared_beginnings(materialise(ordered_turns(conversations), "ordered")))


SQL = r"""
WITH crc AS (
  SELECT [list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
          FOR n IN range(256)] AS t
), turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), told AS (
  SELECT c, list(said ORDER BY pos) AS own FROM turns GROUP BY c
), convs AS (
  SELECT c, own,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM told, crc
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS s
  FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 20
), beginnings AS (
  SELECT c, unnest(range(0, len(s) + 1)) AS depth, s FROM rebuilt
), nodes AS (
  SELECT depth, s[1:depth] AS key, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = depth), '') AS ends
  FROM beginnings GROUP BY depth, s[1:depth]
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.key[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
  LEFT JOIN (SELECT key[1:depth - 1] AS key, depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL) k
    ON k.depth = n.depth + 1 AND k.key = n.key
), ups AS (
  SELECT key, n_children, saved, unnest(range(0, depth + 1)) AS up FROM linked
), sums AS (
  SELECT up AS depth, key[1:up] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM ups GROUP BY up, key[1:up]
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM linked l JOIN sums s ON s.depth = l.depth AND s.key = l.key
"""
