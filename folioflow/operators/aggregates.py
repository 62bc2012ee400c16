"""Grouped reports and one-row-per-key rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.config import OTHER_REACTION_RANK, PREFERENCES, REACTION_RANK
from folioflow.functions import posts as P
from folioflow.functions import text as T
from folioflow.functions import vectors as V
from folioflow.operators.ordering import top_per_key
from folioflow.session import materialise

# Lower and upper bound of the score bands in the report; upper bounds are exclusive.
SCORE_BANDS = ((0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.0))


def dedupe_labels(log: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One preference per id: the last row in ``order``."""
    return log.groupBy("id").agg(F.max_by("preference", F.struct(*order)).alias("preference"))


def upsert_keep_last(existing: DataFrame, new: DataFrame, old_order: Sequence[Column], new_order: Sequence[Column]) -> DataFrame:
    """One preference per id: the last new row in ``new_order``, else the last old one in ``old_order``."""
    both = (
        dedupe_labels(existing, old_order)
        .withColumn("_src", F.lit(0))
        .unionByName(dedupe_labels(new, new_order).withColumn("_src", F.lit(1)))
    )
    return both.groupBy("id").agg(F.max_by("preference", "_src").alias("preference"))


def reaction_rank(content: Column) -> Column:
    chain = F
    for name, rank in REACTION_RANK.items():
        chain = chain.when(content == name, F.lit(rank))
    return chain.otherwise(F.lit(OTHER_REACTION_RANK))


def rank_to_preference(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PREFERENCES]), rank + 1)


def owner_reaction_ranks(reactions: DataFrame, owner: str, key: str = "id") -> DataFrame:
    """Lowest reaction rank of the owner per key."""
    own = reactions.where((F.col("login") == owner) & (F.col("content") != ""))
    return own.groupBy(key).agg(F.min(reaction_rank(F.col("content"))).alias("rank"))


def reaction_to_label(reactions: DataFrame, owner: str) -> DataFrame:
    return owner_reaction_ranks(reactions, owner).select("id", rank_to_preference(F.col("rank")).alias("preference"))


def vector_quality(papers: DataFrame, columns: Sequence[str], samples: int = 5) -> DataFrame:
    """Per year and vector column: rows, null vectors, vectors holding NaN, share removed, first bad ids."""
    checks = F.array(
        *[
            F.struct(F.lit(c).alias("vector"), F.col(c).isNull().alias("is_null"), V.has_nan(c).alias("has_nan"))
            for c in columns
        ]
    )
    rows = papers.select("id", F.substring("updated", 1, 4).cast("int").alias("year"), F.explode(checks).alias("c")).select(
        "id", "year", "c.*"
    )
    bad = F.col("is_null") | F.col("has_nan")
    rows = materialise(rows, "vector-checks")  # vectors are read once, flags twice
    first_bad = (
        top_per_key(rows.where(bad), samples, ["year", "vector"], [F.col("id")])
        .groupBy("year", "vector")
        .agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("bad_ids"))
    )
    counts = rows.groupBy("year", "vector").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_null").alias("null_vectors"),
        F.count_if("has_nan").alias("nan_vectors"),
        F.count_if(bad).alias("removed"),
    )
    return counts.join(first_bad, ["year", "vector"], "left").withColumn(
        "removed_pct", F.round(F.col("removed") * 100.0 / F.col("rows"), 2)
    )


def score_bands_report(predictions: DataFrame) -> DataFrame:
    """Shown and total per score band. Bands without rows are left out; 1.0 falls in none."""
    band = F
    for low, high in SCORE_BANDS:
        band = band.when((F.col("score") >= low) & (F.col("score") < high), F.lit(f"{low:.1f}-{high:.1f}"))
    return (
        predictions.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("show").cast("bigint").alias("shown"))
        .withColumn("ratio", F.col("shown") / F.col("total"))
    )


def value_stats(rows: DataFrame, value: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation of a column."""
    return rows.agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )


def resample_coverage(picks: DataFrame, parents: DataFrame, key: str = "id") -> DataFrame:
    """How many parents were picked at all, and how often."""
    per_parent = picks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_parent.agg(
        F.count(F.lit(1)).alias("distinct_picked"),
        F.min("n").alias("min_picks"),
        F.max("n").alias("max_picks"),
        F.avg("n").alias("mean_picks"),
    ).withColumn("parents", parents.agg(F.count(F.lit(1))).scalar()).withColumn(
        "coverage_pct", F.col("distinct_picked") * 100.0 / F.col("parents")
    )


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights: ``n / (classes * n_class)`` with two classes."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(Window.partitionBy(F.lit(0)))  # two rows
    return counts.withColumn("weight", total / (F.lit(2.0) * F.col("n_class")))


def archive_counts(posts: DataFrame, zone: str) -> DataFrame:
    """Posts that are no drafts, per year (``month`` null) and per month."""
    local = F.from_utc_timestamp("pub", zone)
    dated = posts.where(~F.col("draft")).select(F.year(local).alias("year"), F.month(local).alias("month"))
    return (
        dated.rollup("year", "month")
        .agg(F.count(F.lit(1)).alias("posts"), F.grouping_id().alias("level"))
        .where(F.col("level") < 3)
        .orderBy(F.desc("year"), F.desc_nulls_first("month"))
        .drop("level")
    )


def unique_tags(posts: DataFrame) -> DataFrame:
    """Distinct tag slugs with the spelling seen first, sorted by slug."""
    tags = posts.select("id", F.posexplode("tags").alias("pos", "tag"))
    return (
        tags.groupBy(T.slugify(F.col("tag")).alias("slug"))
        .agg(F.min_by("tag", F.struct("id", "pos")).alias("tag"))
        .orderBy("slug")
    )


def extraction_stats(extracted: DataFrame) -> DataFrame:
    """Papers per method, each with the overall rate of papers that got a text."""
    counts = extracted.groupBy("method").agg(F.count(F.lit(1)).alias("papers"))
    every = Window.partitionBy(F.lit(0))  # one row per method
    found = F.sum(F.when(F.col("method") != "failed", F.col("papers")).otherwise(0)).over(every)
    return counts.withColumn("extraction_rate", F.round(found * 100.0 / F.sum("papers").over(every), 1))


def pivot_long_to_wide(long: DataFrame, variables: Sequence[str]) -> DataFrame:
    return long.groupBy("id").pivot("variable", list(variables)).agg(F.first("value"))


def unpivot_wide_to_long(wide: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns but ``id`` as ``variable, value``; nulls kept."""
    names = list(columns) if columns else [c for c in wide.columns if c != "id"]
    return wide.unpivot("id", names, "variable", "value")


def month_posts(posts: DataFrame, zone: str) -> DataFrame:
    """Archive rows with their year and month in the site's zone."""
    local = F.from_utc_timestamp("pub", zone)
    return posts.where(~F.col("draft")).withColumns(
        {"year": F.year(local), "month": F.month(local), "seconds": P.post_seconds()}
    )
