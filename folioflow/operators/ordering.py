"""Ranks, neighbours and top-k without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.session import cut_lineage, materialise

# Rows around a cut among which it is looked up directly; they are a key and ties wide.
CUT_BAND = 20_000
# Cut points that one pass gives, and the share of rows by which they may be off.
_POINTS, _ACCURACY = 400, 10_000

_ROW_BITS = 33
_BLOCK = 10_000


def with_rank(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in ``order`` (inside ``group`` when given), ties broken by ``order`` itself.

    ``orderBy`` range-partitions on the whole key, so equal leading values are still split by the
    trailing id and a group holding a third of the rows spreads over many tasks. Positions then come
    from the row number inside each sorted partition plus the sizes of the partitions before it, a
    table of at most (partitions + groups) rows. The sorted rows are checkpointed first: range
    boundaries come from a sample, and both uses must see the same ones.
    """
    keys = [F.col(g) for g in group]
    placed = cut_lineage(df.orderBy(*keys, *order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumns(
        {
            "_part": F.shiftrightunsigned("_place", _ROW_BITS),
            "_row": F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_place")
    pieces = placed.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns(
        {
            "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            "_total": F.sum("_rows").over(whole),
        }
    ).drop("_rows")
    if not group:
        pieces = F.broadcast(pieces)  # one row per partition of the sort
    joined = placed.join(_null_safe(pieces, group), _join_on(placed, group), "inner")
    out = joined.withColumn(rank, (F.col("_row") - F.col("_first") + F.col("_before") + 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.select(*df.columns, rank, *([total] if total else []))


def _null_safe(pieces: DataFrame, group: Sequence[str]) -> DataFrame:
    renamed = pieces.withColumnRenamed("_part", "_piece_part")
    for g in group:
        renamed = renamed.withColumnRenamed(g, f"_piece_{g}")
    return renamed


def _join_on(placed: DataFrame, group: Sequence[str]) -> Column:
    condition = F.col("_part") == F.col("_piece_part")
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_piece_{g}"))
    return condition


def running_sum(df: DataFrame, value: Column, order: Sequence[Column], name: str = "_end", total: str = "_all") -> DataFrame:
    """Adds the sum of ``value``, a whole number, up to each row in ``order``, and the sum of all rows.

    Two passes: rows are range-partitioned on the whole order and stored, sums of whole partitions are put
    before the sums inside each, so a partition is one task and their number is that of the sort.
    """
    sorted_rows = df.withColumn("_value", value.cast("decimal(20,0)")).orderBy(*order)
    placed = cut_lineage(sorted_rows.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_place", _ROW_BITS))
    parts = placed.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("decimal(28,0)").alias("_start"),
        F.sum("_sum").over(Window.partitionBy(F.lit(0))).cast("decimal(28,0)").alias(total),
    )
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_inside", F.sum("_value").over(inside)).join(F.broadcast(parts), "_part")  # a row per partition
    return summed.withColumn(name, (F.col("_start") + F.col("_inside")).cast("decimal(28,0)")).select(*df.columns, name, total)


def smallest(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows in ``order``, ascending, whose first column is a number; all rows if there are fewer.

    No task holds ``k`` rows: the place of the k-th row is found by ``cut_place`` and every row is compared
    with it where it lies. Rows that share that place are numbered, and as many are taken as still fit.
    """
    if k <= 0:
        return df.limit(0)
    cut = cut_place(df, k, order)
    if cut is None:
        return df
    place = _place(order)
    before, equal = df.agg(F.count_if(place < cut), F.count_if(place == cut)).first()
    if before + equal == k:
        return df.where(place <= cut)
    last = with_rank(df.where(place == cut), order, rank="_k_rank").where(F.col("_k_rank") <= k - before).drop("_k_rank")
    return df.where(place < cut).unionByName(last)


def _place(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def cut_place(df: DataFrame, k: int, order: Sequence[Column]) -> Column | None:
    """The place, a struct of ``order``, of the ``k``-th row as a constant; None if there are not more than ``k`` rows.

    A pass over the numbers gives approximate quantiles, mergeable sketches of a fixed size; a count checks
    the two that enclose the k-th row, and the band between them is narrowed in the same way until it has few
    rows or a single number. Only then are rows ordered, a few directly, many of one number by range partitions.
    """
    places = df.select(_place(order).alias("place")).withColumn("key", F.col("place.o0"))
    shares = [i / _POINTS for i in range(_POINTS + 1)]
    band, need, rows = places, k, None
    while True:
        points = F.percentile_approx("key", F.array(*[F.lit(s) for s in shares]), F.lit(_ACCURACY)).alias("points")
        found = band.agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("known"), points).first()
        if rows is None and found["n"] <= need:
            return None
        if found["n"] <= CUT_BAND or found["known"] < found["n"] or found["n"] == rows:
            break
        rows = found["n"]
        points = sorted(set(found["points"]))
        sizes = band.agg(*[F.count_if(F.col("key") <= F.lit(p)) for p in points]).first()
        high = next((i for i, n in enumerate(sizes) if n >= need), None)
        if high is None:  # above all sketched numbers
            band, need = band.where(F.col("key") > F.lit(points[-1])), need - sizes[-1]
            continue
        inside = F.col("key") <= F.lit(points[high])
        if high:
            inside, need = inside & (F.col("key") > F.lit(points[high - 1])), need - sizes[high - 1]
        band = band.where(inside)
    if found["n"] <= CUT_BAND:
        last = band.orderBy("place").limit(need).agg(F.max("place").alias("place"))
    else:
        last = with_rank(band.select("place"), [F.col("place")], rank="_k_rank").where(F.col("_k_rank") == need).select("place")
    row = materialise(last, "cut")
    return row.select("place").scalar()


def top_per_key(df: DataFrame, k: int, key: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, with their position.

    Filtering the row number lets Spark cut to ``k`` rows per key inside each task before the shuffle.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).where(F.col(rank) <= k)


def neighbours(ranked: DataFrame, columns: Sequence[str], rank: str = "rank") -> DataFrame:
    """``prev_*`` and ``next_*`` of ``columns`` from consecutive ranks.

    Ranks are cut into blocks; the rows at a block's edge are also sent to the block beside it, so
    one shuffle with groups of bounded size is enough.
    """
    block = F.floor(F.col(rank) / F.lit(_BLOCK))
    spread = ranked.withColumn(
        "_block",
        F.explode(
            F.array_distinct(
                F.array(
                    block,
                    F.floor((F.col(rank) - 1) / F.lit(_BLOCK)),
                    F.floor((F.col(rank) + 1) / F.lit(_BLOCK)),
                )
            )
        ),
    )
    window = Window.partitionBy("_block").orderBy(rank)
    for c in columns:
        spread = spread.withColumn(f"prev_{c}", F.lag(c).over(window)).withColumn(f"next_{c}", F.lead(c).over(window))
    return spread.where(F.col("_block") == block).drop("_block")
