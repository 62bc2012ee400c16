"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.functions.hashing import open_uniform
from folioflow.operators.ordering import running_sum, with_rank
from folioflow.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
WORD = r"[^\x20\x09-\x0D]+"
TAG = "mix"


def word_count(text: Column) -> Column:
    """Words between ASCII white space, as a bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING
) -> DataFrame:
    """Adds ``target`` to rows of (``source, source_size``): ``share`` of all sizes, dealt by weight.

    Weights repeat over the sources in code point order, a null source last. A target over ``ceiling``
    times its source stops there and the excess is dealt again among the others until none is above.
    Each round is one aggregate over the sources; the driver keeps three numbers.
    """
    ranked = with_rank(sources, [F.col("source").asc_nulls_last()], rank="_place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("_weight", weight).drop("_place"), "mix-sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, limit = -1.0, ceiling * F.col("source_size")
    while True:
        over = limit < F.lit(level) * F.col("_weight")
        capped, left = ranked.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0))
        ).first()
        raised = (total - capped) / left if left else level
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least(limit, F.lit(max(level, 0.0)) * F.col("_weight"))).drop("_weight")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken`` and the columns of ``keep``.

    A source's ratio of target to size gives every document its certain whole copies; what is left is a
    Pareto sample: documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)),
    and taken in that order until the words reach the rest of the target, to half a document. ``u`` is an
    md5 uniform of the id, so runs agree; equal ids go by size, then by text, equal rows by a stored number.

    No task sees a whole source: documents lie in about the square root of the source's number of buckets
    by ``u`` (which has the order of the rank, since p is the same in a source), running sums over bucket
    totals find the one bucket that the cut falls into, and only its documents are ordered, by range
    partitions, which split a bucket that an often repeated id or rows without one have filled.

    Null texts have size 0, null sources are a source, a source without words has target 0 and each of its
    documents no copy. A null id is drawn as the empty id. Columns other than those named are not read.
    """
    sized = materialise(
        docs.select(
            "doc_id",
            "source",
            *keep,
            word_count(F.col("text")).alias("size"),
            open_uniform(TAG, "doc_id").alias("_u"),
            F.xxhash64("text").alias("_hash"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_documents"))
    targets = source_targets(sources, weights, share, ceiling)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumns(
        {
            "_source": _null_key("source"),
            "_whole": F.floor(ratio),
            "_chance": ratio - F.floor(ratio),
            "_rest": F.col("target") - F.floor(ratio) * F.col("source_size"),
            "_buckets": F.greatest(F.lit(1), F.floor(F.sqrt("_documents"))),
        }
    ).drop("source", "_documents")
    targets = materialise(targets, "mix-targets")
    placed = (
        sized.withColumn("_source", _null_key("source"))
        .join(targets, "_source")
        .withColumn("_bucket", F.floor(F.col("_u") * F.col("_buckets")))
    )

    sums = placed.where(F.col("_chance") > 0).groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_words")))
        .select("_source", F.col("_bucket").alias("_cut"), "_before")
    )
    placed = placed.join(materialise(cuts, "mix-cuts"), "_source", "left")

    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_chance") / (1 - F.col("_chance")))
    order = [F.col("_source"), odds, *[F.col(c) for c in ("_u", "doc_id", "size", "_hash", "_row")]]
    at_cut = running_sum(placed.where(F.col("_bucket") == F.col("_cut")), F.col("size"), order, "_end", "_sum")
    first = at_cut.groupBy("_source").agg(F.min(F.col("_end") - F.col("size")).alias("_first"))
    at_cut = at_cut.join(first, "_source")
    running = F.col("_before") + (F.col("_end") - F.col("_first")).cast("bigint") - F.col("size")
    at_cut = at_cut.withColumn("_in", (running + F.col("size") / 2 <= F.col("_rest")).cast("int"))
    at_cut = at_cut.drop("_end", "_sum", "_first")
    others = placed.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut")))
    drawn = (F.col("_chance") > 0) & (F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")))
    others = others.withColumn("_in", drawn.cast("int"))
    copies = (F.col("_whole") + F.col("_in")).cast("int")
    return at_cut.unionByName(others).select(
        "doc_id",
        "source",
        *keep,
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).cast("bigint").alias("taken"),
    )


def _null_key(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(name)))


SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
           (('0x' || substr(md5('{TAG}:' || doc_id), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE AS u
    FROM documents
), sources AS (
    SELECT source, SUM(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM sized GROUP BY source
), steps AS (
    SELECT ({SHARE} * SUM(source_size) OVER () - COALESCE(SUM({CEILING} * source_size) OVER below, 0))::DOUBLE
           / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER below, 0))::DOUBLE AS level
    FROM sources
    WINDOW below AS (ORDER BY {CEILING} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size, LEAST({CEILING} * source_size, level * weight)::DOUBLE AS target
    FROM sources, (SELECT MAX(level) AS level FROM steps)
), ratios AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets
), drawn AS (
    SELECT d.doc_id, d.source, d.size, r.source_size, r.target, floor(r.ratio)::BIGINT AS whole,
           r.ratio - floor(r.ratio) AS chance, r.target - floor(r.ratio) * r.source_size AS rest,
           COALESCE(SUM(d.size) OVER (
               PARTITION BY d.source
               ORDER BY (d.u / (1 - d.u)) / NULLIF((r.ratio - floor(r.ratio)) / (1 - (r.ratio - floor(r.ratio))), 0), d.u, d.doc_id, d.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running
    FROM sized d JOIN ratios r ON d.source IS NOT DISTINCT FROM r.source
), counted AS (
    SELECT *, (whole + CASE WHEN chance > 0 AND running + size / 2.0 <= rest THEN 1 ELSE 0 END)::INT AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM counted
"""
