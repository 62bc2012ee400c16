"""Draws with and without replacement, deterministic in seed and id.

Independent draws are replaced by key-based ones: the same expected counts, the same result on
every engine and every partitioning, and no row loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions.hashing import hash52, open_uniform, uniform
from folioflow.operators.ordering import cut_place, running_sum, smallest

# Draws order rows by a hash of this many values, then by key. It bounds no task: equal values are split by the key.
HASH_PLACES = 1024

_UNIT = 1 << 20
_WEIGHT_SCALE = 1e9


def shuffle_order(seed: int) -> list[Column]:
    return [uniform(f"{seed}:shuffle", "id"), F.col("id")]


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """All rows in an order that depends on seed and id only."""
    return df.orderBy(*shuffle_order(seed))


def sample_background(unlabelled: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows of ``n`` ids without replacement; all rows when there are fewer ids.

    Ids are drawn first and their rows fetched by a join, so vectors never sit in a sort, and a repeated
    id is drawn once with all its rows, whatever ``n`` is.
    """
    known = unlabelled.where(F.col("id").isNotNull())
    order = [uniform(f"{seed}:bg", "id"), F.col("id")]
    return known.join(smallest(known.select("id").distinct(), n, order), "id", "left_semi")


def weighted_key(tag: str, weight: Column, *keys: Column | str) -> Column:
    """Exponential key: the k smallest are a weighted draw without replacement."""
    return -F.ln(open_uniform(tag, *keys)) / weight


def weighted_pick(df: DataFrame, k: int, weight: Column, seed: int) -> DataFrame:
    """``k`` rows without replacement, in proportion to ``weight``; rows without weight are never drawn."""
    return smallest(df.where(weight > 0), k, [weighted_key(f"{seed}:pick", weight, "id"), F.col("id")])


def systematic_draw(df: DataFrame, n: int, weight: Column, tag: str, key: Sequence[str] = ("id",)) -> DataFrame:
    """Exactly ``n`` draws with replacement in proportion to ``weight``; adds ``draw`` = 1, 2, ... per row.

    Row i gets ``floor(n*C_i/T + u) - floor(n*C_(i-1)/T + u)`` copies, with C the running sum of
    integer weights and T its total, so the expected copies are those of independent draws with less
    variance. All of it is integer arithmetic. Rows with one key go by weight; without any weight nothing is drawn.
    """
    offset = int(tag_fraction(tag) * _UNIT)
    weighed = df.withColumns(
        {
            "_w": F.round(weight * F.lit(_WEIGHT_SCALE)).cast("decimal(20,0)"),
            "_hash": F.pmod(hash52("bucket", *key), F.lit(HASH_PLACES)),
        }
    )
    order = [F.col(c) for c in ("_hash", *key, "_w")]
    placed = running_sum(weighed, F.col("_w"), order).where(F.col("_all") > 0)

    def mark(position: str) -> Column:
        return F.expr(
            f"cast(({n}L * ({position}) * {_UNIT}L + {offset}L * _all) as decimal(38,0)) div cast(_all * {_UNIT}L as decimal(38,0))"
        )

    copies = (mark("_end") - mark("_end - _w")).cast("int")
    drawn = placed.withColumn("_copies", copies).where(F.col("_copies") > 0)
    return drawn.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*df.columns, "draw")


def tag_fraction(tag: str) -> float:
    """The one uniform of a systematic draw, from its tag."""
    import hashlib

    return int(hashlib.md5(tag.encode()).hexdigest()[:5], 16) / 16**5


def quota_size(n: int, rate: float) -> int:
    """At least one row is shown."""
    return max(1, int(n * rate))


def quota_order(score: Column, high: float, boundary: float, seed: int) -> list[Column]:
    """Selection order: high scores at random, then the boundary by weight, then the rest at random."""
    tier = F.when(score >= high, 0).when(score >= boundary, 1).otherwise(2)
    weight = F.exp(F.lit(2.0) * (score - F.lit(boundary)) / F.lit(high - boundary))
    key = F.when(tier == 1, weighted_key(f"{seed}:quota", weight, "id")).otherwise(uniform(f"{seed}:quota", "id"))
    return [tier, key, F.col("id")]


def adaptive_quota(scored: DataFrame, rate: float, high: float, boundary: float, seed: int) -> DataFrame:
    """Flag a quota of rows: ``show`` is 1 for the first ``max(1, int(n*rate))`` in the selection order.

    The place of the last selected row becomes a one-row scalar subquery that every row is compared with, so
    no join by id is needed. Give a stored table: it is read for the count, the cut and the flag.
    """
    target = quota_size(scored.count(), rate)
    tier, key, row_id = quota_order(F.col("score"), high, boundary, seed)
    # One number for tier and key, so that a cut can be sought by quantiles; the exact key breaks its ties.
    order = [tier + key / (key + 1), tier, key, row_id]
    cut = cut_place(scored, target, order)
    if cut is None:
        return scored.withColumn("show", F.lit(1).cast("tinyint"))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return scored.withColumn("show", F.when(place <= cut, 1).otherwise(0).cast("tinyint"))
