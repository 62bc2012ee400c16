"""The nightly chain: labels, split, training, scoring, quota."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from folioflow.config import Settings
from folioflow.functions import vectors as V
from folioflow.operators import filters, joins, model, sampling
from folioflow.plans.bindings import COEFFICIENTS, INTERCEPT, SETTINGS, SQL_CLEAN, SQL_SCORE, Bound, sql_open_uniform, sql_uniform, with_ctes
from folioflow.plans.predicates import CATEGORY_SQL
from folioflow.plans.registry import query
from folioflow.session import materialise


def candidates(papers: DataFrame, labels: DataFrame, published: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Labelled papers, and unlabelled ones that are recent enough and not yet published; both with vectors."""
    known = filters.category_filter(papers, settings.categories)
    known = filters.null_vector_filter(known, settings.embedding_columns)
    labelled, rest = joins.split_labelled(known, labels)
    scan_start = min(settings.background_start_year, settings.preference_start_year)
    rest = filters.year_filter(rest, scan_start, settings.background_start_year)
    return joins.labelled_join(labelled, labels), joins.remove_published(rest, published)


def train(labelled: DataFrame, rest: DataFrame, settings: Settings):
    """First fit, confidence draw, difficulty draw with synthesis, final fit.

    With ``confidence_weighting`` off the positives go on as they are, with ``difficulty_sampling`` off
    they are not replaced; with both off there is one fit.
    """
    # The labelled papers are few; taking them out of the paper table once saves scans of all vectors.
    labelled = materialise(labelled.select("id", "preference", *settings.embedding_columns), "labelled")
    rows = materialise(model.training_set(labelled, rest, settings), "training")
    if not (settings.confidence_weighting or settings.difficulty_sampling):
        return model.fit_logistic(rows, settings)
    positives = rows.where("label = 1").select("id", F.col("features").alias("vector"))
    if settings.confidence_weighting:
        rated = model.score_rows(model.fit_logistic(rows, settings), positives, "vector")
        draws = model.confidence_resample(materialise(rated, "rated-positives"), settings).select("id", "draw", "vector")
    else:
        draws = positives.select("id", F.lit(1).cast("bigint").alias("draw"), "vector")
    draws = materialise(draws, "draws")
    columns = settings.embedding_columns
    background = filters.nan_to_zero(rest.select("id", *columns), columns).select("id", V.concat_features(columns, "float").alias("vector"))
    balanced = model.balanced_positives(draws, background, settings) if settings.difficulty_sampling else draws
    final = rows.where("label = 0").select("label", "features").unionByName(
        balanced.select(F.lit(1).alias("label"), F.col("vector").alias("features"))
    )
    return model.fit_logistic(materialise(final, "balanced"), settings)


def predict(rest: DataFrame, settings: Settings, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score the papers of the date window and flag the quota; vectors are dropped before rows are stored."""
    columns = settings.embedding_columns
    window = filters.nan_vector_filter(filters.date_window(rest, settings), columns)
    scored = score(filters.concat_features(window, columns)).drop(*columns, "features")
    stored = materialise(scored, "scored")
    return sampling.adaptive_quota(
        stored, settings.sample_rate, settings.high_threshold, settings.boundary_threshold, settings.seed
    )


def recommend(papers: DataFrame, labels: DataFrame, published: DataFrame, settings: Settings) -> DataFrame:
    labelled, rest = candidates(papers, labels, published, settings)
    fitted = train(labelled, rest, settings)
    return predict(rest, settings, lambda rows: model.score_rows(fitted, rows))


def _report(flagged: DataFrame) -> DataFrame:
    return flagged.select("id", "title", "updated", F.round("score", 6).alias("score"), F.col("show").cast("int").alias("show"))


@query("recommend")
def recommend_trained(b: Bound) -> DataFrame:
    return _report(recommend(b.papers.drop("abstract"), b.labels.select("id", "preference"), b.published_ids, SETTINGS))


TIER_WINDOW_SQL = f""", window_ AS (SELECT id FROM unlabelled WHERE list_has_any(categories, {CATEGORY_SQL})
        AND updated BETWEEN '{SETTINGS.start_date}' AND '{SETTINGS.end_date}' AND updated >= '2024' AND id NOT IN (SELECT id FROM published_ids) AND {SQL_CLEAN}),
    n AS (SELECT count(*) AS n FROM window_), switch AS (SELECT * FROM (VALUES (false), (true)) v(flag))"""


@query(
    "recommend_tiers",
    with_ctes("unlabelled", "published_ids")
    + TIER_WINDOW_SQL
    + f""" SELECT a.flag AS confidence_weighting, b.flag AS difficulty_sampling, n AS papers, greatest(1, floor(n * {SETTINGS.sample_rate}::DOUBLE))::BIGINT AS flagged,
        0::BIGINT AS unscored, 0::BIGINT AS passed_over FROM switch a, switch b, n""",
)
def recommend_tiers(b: Bound) -> DataFrame:
    """The trained chain with each setting of its two switches: papers, flags, rows without a probability, and
    papers without a flag that lie in a higher tier than one with a flag."""
    papers, labels = b.papers.drop("abstract"), b.labels.select("id", "preference")
    tier = F.when(F.col("score") >= SETTINGS.high_threshold, 0).when(F.col("score") >= SETTINGS.boundary_threshold, 1).otherwise(2)
    reports = []
    for confidence in (False, True):
        for difficulty in (False, True):
            chosen = replace(SETTINGS, confidence_weighting=confidence, difficulty_sampling=difficulty)
            flagged = materialise(recommend(papers, labels, b.published_ids, chosen).select("id", "score", "show", tier.alias("tier")), "tiers")
            last = flagged.where("show = 1").agg(F.max("tier").alias("last"))  # one row
            counts = flagged.crossJoin(F.broadcast(last)).agg(
                F.count(F.lit(1)).alias("papers"),
                F.count_if(F.col("show") == 1).alias("flagged"),
                F.count_if(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("unscored"),
                F.count_if((F.col("show") == 0) & (F.col("tier") < F.col("last"))).alias("passed_over"),
            )
            reports.append(counts.select(F.lit(confidence).alias("confidence_weighting"), F.lit(difficulty).alias("difficulty_sampling"), "*"))
    return reduce(DataFrame.unionByName, reports)


_WEIGHT = f"exp(2.0 * (score - {SETTINGS.boundary_threshold}) / {SETTINGS.high_threshold - SETTINGS.boundary_threshold!r})"


@query(
    "recommend_fixed",
    with_ctes("unlabelled", "published_ids")
    + f""", window_ AS (SELECT *, list_concat(v1, v2)::DOUBLE[] AS vector FROM unlabelled WHERE list_has_any(categories, {CATEGORY_SQL})
        AND updated BETWEEN '{SETTINGS.start_date}' AND '{SETTINGS.end_date}' AND updated >= '2024' AND id NOT IN (SELECT id FROM published_ids) AND {SQL_CLEAN}),
    s AS (SELECT id, title, updated, {SQL_SCORE} AS score FROM window_),
    placed AS (SELECT *, CASE WHEN score >= {SETTINGS.high_threshold} THEN 0 WHEN score >= {SETTINGS.boundary_threshold} THEN 1 ELSE 2 END AS tier FROM s),
    keyed AS (SELECT *, CASE WHEN tier = 1 THEN -ln({sql_open_uniform('42:quota', 'id')}) / {_WEIGHT} ELSE {sql_uniform('42:quota', 'id')} END AS key FROM placed),
    numbered AS (SELECT *, row_number() OVER (ORDER BY tier, key, id) AS place, count(*) OVER () AS n FROM keyed)
    SELECT id, title, updated, round(score, 6) AS score, CASE WHEN place <= greatest(1, floor(n * {SETTINGS.sample_rate}::DOUBLE)) THEN 1 ELSE 0 END AS "show" FROM numbered""",
)
def recommend_fixed(b: Bound) -> DataFrame:
    """The chain with given coefficients instead of a trained model."""
    _, rest = candidates(b.papers.drop("abstract"), b.labels.select("id", "preference"), b.published_ids, SETTINGS)
    return _report(predict(rest, SETTINGS, lambda rows: model.score_fixed(rows, COEFFICIENTS, INTERCEPT)))
