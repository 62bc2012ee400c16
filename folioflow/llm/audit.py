"""Audit of how filters interact: what every order of them removes, step by step, from one min-plus product."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.session import materialise

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def place_matrix(orders: Sequence[Sequence[int]]) -> np.ndarray:
    """(filters, orders): the position of each filter in each order, the inverse permutations as columns."""
    return np.argsort(np.asarray(orders), axis=1).T.astype(np.int64)


def min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix product with minimum for sum and sum for product."""
    out = left[:, :1] + right[:1]
    for k in range(1, right.shape[0]):
        np.minimum(out, left[:, k : k + 1] + right[k : k + 1], out=out)
    return out


def removal_counts(masks: np.ndarray, docs: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: int) -> tuple[list, dict]:
    """All orders of ``n`` filters, and for each count of ``COUNTS`` an (orders, steps) matrix.

    ``masks`` holds distinct sets of failed filters, one bit a filter, ``docs``, ``good`` and ``toxic``
    their weights. A failed filter costs its position, a passed one costs more than any position, so the
    min-plus product of masks and positions is the step that removes a set under an order, or ``n`` and
    more where nothing does. All counts are scatter sums of integers over these steps.
    """
    orders = list(permutations(range(n)))
    places = place_matrix(orders)
    fails = (masks[:, None] >> np.arange(n)) & 1 == 1
    steps = np.minimum(min_plus(np.where(fails, 0, n), places), n)
    row = np.broadcast_to(np.arange(len(orders)), steps.shape)

    def scatter(weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), n + 1), dtype=np.int64)
        np.add.at(out, (row, steps), weights[:, None])
        return out[:, :n]

    removed = scatter(docs)
    redundant = np.zeros_like(removed)
    alone, share = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for f in range(n):
        late = fails[:, f, None] & (places[f][None] > steps)
        np.add.at(redundant, (np.arange(len(orders)), places[f]), (late * docs[:, None]).sum(axis=0))
        alone[f] = docs[masks == 1 << f].sum()
        share[f] = removed[np.arange(len(orders)), places[f]].sum()
    at_step = np.asarray(orders)
    return orders, {
        "kept": docs.sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": redundant,
        "unique_fails": alone[at_step],
        "good_lost": scatter(good),
        "toxic_lost": scatter(toxic),
        "shapley": share[at_step],
    }


def interaction_audit(sets: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per ``part``, order of ``filters`` and step, with all counts, zeros included.

    ``sets`` has one row per ``part`` and ``mask`` (bit i: filter i fails) with sums ``docs``, ``good`` and
    ``toxic``. A part has at most 2^n of them, so that a group is small whatever the corpus. Parts without
    rows give no rows. The number of rows of a part is n! * n; keep n below 8.
    """
    n = len(filters)
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def audit(found: pa.Table) -> pa.Table:
        masks, *weights = (found.column(c).to_numpy().astype(np.int64) for c in ("mask", "docs", "good", "toxic"))
        orders, counts = removal_counts(masks, *weights, n)
        names = ["".join(filters[f] for f in order) for order in orders]
        arrays = [
            pa.array([found.column("part")[0].as_py()] * (len(orders) * n), type=pa.string()),
            pa.array(np.repeat(names, n).tolist(), type=pa.string()),
            pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
        ]
        return pa.table([*arrays, *[pa.array(counts[c].ravel()) for c in COUNTS]], names=["part", "filter_order", "step", *COUNTS])

    return sets.groupBy("part").applyInArrow(audit, schema)


def failed_by_text(text: Column) -> Column:
    """Bits of the four conditions that a text alone decides: short, repetitive, shouting, marked."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    count, distinct = F.size(words).cast("bigint"), F.size(F.array_distinct(words)).cast("bigint")
    conditions = [
        count < 100,
        100 * distinct < 80 * count,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 10 * F.length(text).cast("bigint"),
        text.rlike("[#$%&*|]"),
    ]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(``part``, ``mask``, ``docs``, ``good``, ``toxic``): how many documents fail which of the five filters.

    A null text is empty, a null ``lang`` the part of the empty string. A row fails the last filter if a
    row with a smaller ``doc_id`` has the same text; a row without id is neither smaller nor larger than
    another. Rows with one id and one text count each, and none is a copy of the other. A document is good
    or toxic if any label row of its id says 1; null labels say nothing. Only ``doc_id``, ``text`` and
    ``lang`` are read; empty tables give no rows.

    One scan leaves 40 bytes a row. Copies are counted without a join on the text: equal rows are summed,
    then each text's rows by part and label keep their smallest id and how often it occurs, all with
    map-side sums, so a text that a third of the rows share meets its smallest id as a few rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            failed_by_text(text).alias("bits"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit("second"), text).alias("h2"),
        ),
        "filter-facts",
    )
    content = ["part", "bits", "h1", "h2"]
    rows = rows.groupBy("doc_id", *content).agg(F.count(F.lit(1)).alias("n"))
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(
            F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
            F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
        )
    )
    # Rows without an id stay out of the join, where they would all have one key.
    known = rows.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    nameless = rows.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    rows = known.unionByName(nameless.select(*known.columns))
    by_text = rows.groupBy(*content, "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("h1", "h2"))
    firsts = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    counted = by_text.withColumn("smallest", smallest).withColumn("copies", F.col("n") - F.col("nameless") - firsts)
    split = F.explode(
        F.array(
            F.struct(F.col("bits").alias("mask"), (F.col("n") - F.col("copies")).alias("docs")),
            F.struct((F.col("bits") + 16).alias("mask"), F.col("copies").alias("docs")),
        )
    )
    sets = counted.select("part", "good", "toxic", split.alias("set")).where("set.docs > 0")
    return sets.groupBy("part", F.col("set.mask").alias("mask")).agg(
        F.sum("set.docs").alias("docs"),
        F.sum(F.col("set.docs") * F.col("good")).alias("good"),
        F.sum(F.col("set.docs") * F.col("toxic")).alias("toxic"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole texts; see ``failed_sets`` for odd rows."""
    return interaction_audit(failed_sets(docs, labels))


SQL = r"""
WITH facts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), fails AS (
  SELECT f.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         len(w) < 100 AS a, 100 * list_unique(w) < 80 * len(w) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(f.doc_id > min(f.doc_id) OVER (PARTITION BY t), false) AS e
  FROM facts f LEFT JOIN marks m ON f.doc_id = m.doc_id
), sets AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                      CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic
  FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, u.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
), per_set AS (
  SELECT s.part, o.filter_order, o.step, s.docs, s.good, s.toxic, s.failed, substr(o.filter_order, o.step::INT, 1) AS filter,
         list_min([instr(o.filter_order, x) FOR x IN string_split(s.failed, '') IF x <> '']) AS gone
  FROM sets s, steps o
), counted AS (
  SELECT part, filter_order, step, any_value(filter) AS filter,
         sum(CASE WHEN gone IS NULL OR gone > step THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN gone < step AND contains(failed, filter) THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = filter THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM per_set GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM counted
"""
