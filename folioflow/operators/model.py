"""Training set, re-sampling of positives, logistic model and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from folioflow.config import Settings
from folioflow.functions import vectors as V
from folioflow.functions.hashing import uniform
from folioflow.operators.aggregates import class_counts
from folioflow.operators.filters import label_column
from folioflow.operators.knn import knn_join
from folioflow.operators.sampling import sample_background, systematic_draw
from folioflow.session import materialise

_SOFTENING = 1e-6
_FLAT_RANGE = 1e-10


def training_set(labelled: DataFrame, unlabelled: DataFrame, settings: Settings) -> DataFrame:
    """``id, label, features``: labelled rows and a background draw; rows with null or NaN vectors left out."""
    columns = list(settings.embedding_columns)
    known = label_column(labelled).select("id", "label", *columns)
    n_background = int(settings.neg_sample_ratio * known.where("label = 1").count())
    background = sample_background(unlabelled.select("id", *columns), n_background, settings.seed)
    rows = known.unionByName(background.withColumn("label", F.lit(0)))
    return rows.where(V.all_clean(columns)).select("id", "label", V.concat_features(columns).alias("features"))


def fit_logistic(rows: DataFrame, settings: Settings, label: str = "label", features: str = "features") -> LogisticRegressionModel:
    """L2 logistic regression with balanced classes.

    The objective ``C * sum(w * loss) + |b|^2 / 2`` divided by ``C * sum(w)`` is Spark's with
    ``regParam = 1 / (C * n)``, since balanced weights sum to n.
    """
    weights = {row[label]: row for row in class_counts(rows, label).collect()}
    if len(weights) < 2:
        raise ValueError("training needs rows of both classes")
    n = sum(row["n_class"] for row in weights.values())
    weight = F.when(F.col(label) == 1, weights[1]["weight"]).otherwise(weights[0]["weight"])
    train = rows.select(
        F.col(label).cast("double").alias("label"),
        weight.alias("weight"),
        array_to_vector(F.col(features)).alias("features"),
    )
    estimator = LogisticRegression(
        weightCol="weight",
        regParam=1.0 / (settings.regularisation_c * n),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        maxIter=settings.max_iter,
    )
    return estimator.fit(train)


def optimality(model: LogisticRegressionModel, rows: DataFrame, settings: Settings, label: str = "label", features: str = "features") -> DataFrame:
    """``part, position, value``: rows and weight of each class, and the objective's gradient at the model.

    The objective is convex, so a gradient of zero proves the fit. Position -1 is the intercept, the others
    are those of the coefficients. Partial sums are taken where the rows lie; one row per position is moved.
    """
    classes = class_counts(rows, label)
    wide = classes.select(F.col(label).cast("bigint").alias("position"), F.col("n_class").cast("double").alias("class_rows"), "weight")
    long = wide.unpivot(["position"], ["class_rows", "weight"], "part", "value")
    weight = classes.select(F.col(label).alias("_label"), "weight")  # two rows
    scored = score_rows(model, rows, features, "_score").join(weight, F.col(label) == F.col("_label"))
    pull = scored.select((F.col("weight") * (F.col("_score") - F.col(label))).alias("pull"), F.col(features).alias("x"))
    pull = pull.select("pull", F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("x").cast("array<double>"))).alias("at", "x"))
    sums = pull.groupBy("at").agg(F.sum(F.col("pull") * F.col("x")).alias("total"))
    n = rows.count()
    penalty = F.array(F.lit(0.0), *(F.lit(float(b) / settings.regularisation_c) for b in model.coefficients))
    at_model = F.get(penalty, F.col("at")) + F.col("total")
    gradient = sums.select((F.col("at") - 1).cast("bigint").alias("position"), F.lit("gradient").alias("part"), (at_model / n).alias("value"))
    return long.select("part", "position", "value").unionByName(gradient)


def score_rows(model: LogisticRegressionModel, rows: DataFrame, features: str = "features", name: str = "score") -> DataFrame:
    """P(like) per row."""
    ready = rows.withColumn("_x", array_to_vector(F.col(features)))
    fitted = model.copy().setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
    return fitted.transform(ready).withColumn(name, vector_to_array("_p")[1]).drop("_x", "_p")


def score_fixed(rows: DataFrame, coefficients: Sequence[float], intercept: float, features: str = "features") -> DataFrame:
    """P(like) from given coefficients."""
    return rows.withColumn("score", V.logistic_probability(F.col(features), coefficients, intercept))


def confidence_resample(positives: DataFrame, settings: Settings, n: int | None = None, score: str = "score") -> DataFrame:
    """As many draws as positives; confident ones count double."""
    count = positives.count() if n is None else n
    weight = F.when(F.col(score) >= settings.confidence_threshold, settings.confidence_weight).otherwise(1.0)
    return systematic_draw(positives, count, weight, f"{settings.seed}:confidence")


def difficulty_weights(positives: DataFrame, background: DataFrame, n_neighbors: int, **options) -> DataFrame:
    """``id, distance, difficulty, weight`` per positive.

    Distance is the mean over the nearest background rows; difficulty its softened inverse (1 for all
    when the distances are equal) and weight the difficulty divided by the total.
    """
    near = knn_join(positives, background, n_neighbors, **options)
    mean = near.groupBy(F.col("q_id").alias("id")).agg((F.sum("dist") / F.count(F.lit(1))).alias("distance"))
    return with_difficulty(materialise(mean, "distances"))  # read three times; the search must run once


def with_difficulty(distances: DataFrame) -> DataFrame:
    spread = distances.agg(F.max("distance") - F.min("distance")).scalar()
    raw = F.lit(1.0) / (F.col("distance") + F.lit(_SOFTENING))
    rated = distances.withColumn("difficulty", F.when(spread < _FLAT_RANGE, F.lit(1.0)).otherwise(raw))
    return rated.withColumn("weight", F.col("difficulty") / rated.agg(F.sum("difficulty")).scalar())


def target_sizes(n_pos: int, settings: Settings) -> tuple[int, int]:
    """Number of re-drawn and of synthetic rows."""
    total = int(n_pos * settings.pos_sampling_ratio)
    synthetic = int(total * settings.synthetic_ratio)
    return total - synthetic, synthetic


def difficulty_resample(rated: DataFrame, n: int, seed: int, key: Sequence[str] = ("id",)) -> DataFrame:
    return systematic_draw(rated, n, F.col("difficulty"), f"{seed}:resample", key)


def synthesis_plan(rated: DataFrame, n: int, n_distinct: int, settings: Settings, key: Sequence[str] = ("id",)) -> DataFrame:
    """``n`` parents with the rank of the neighbour to move towards and how far."""
    k = min(settings.smote_neighbors, n_distinct - 1)
    if k <= 0 or n <= 0:
        return rated.limit(0).withColumns({"draw": F.lit(0), "pick": F.lit(0).cast("bigint"), "alpha": F.lit(0.0)})
    parents = systematic_draw(rated, n, F.col("difficulty"), f"{settings.seed}:parents", key)
    return parents.withColumns(
        {
            "pick": (F.lit(1) + F.floor(uniform(f"{settings.seed}:nn", *key, "draw") * F.lit(k))).cast("bigint"),
            "alpha": uniform(f"{settings.seed}:alpha", *key, "draw"),
        }
    )


def smote_synthesize(
    rated: DataFrame, vectors: DataFrame, n: int, settings: Settings, key: Sequence[str] = ("id",), **options
) -> DataFrame:
    """``n`` synthetic vectors between a parent and one of its nearest other positives.

    ``rated`` holds the key, ``id`` and ``difficulty``; ``vectors`` one ``vector`` per distinct id.
    """
    n_distinct = vectors.count()
    plan = synthesis_plan(rated, n, n_distinct, settings, key)
    near = knn_join(vectors, vectors, min(settings.smote_neighbors, n_distinct - 1), exclude_self=True, **options)
    chosen = near.select(F.col("q_id").alias("id"), F.col("id").alias("neighbor"), F.col("rank").alias("pick"))
    ends = vectors.select(F.col("id").alias("neighbor"), F.col("vector").alias("_end"))
    starts = vectors.select("id", F.col("vector").alias("_start"))
    joined = plan.join(chosen, ["id", "pick"]).join(ends, "neighbor").join(starts, "id")
    return joined.withColumn("vector", V.interpolate(F.col("_start"), F.col("_end"), F.col("alpha"))).select(
        *dict.fromkeys([*key, "id", "draw", "neighbor", "alpha", "vector"])
    )


def balanced_positives(positives: DataFrame, background: DataFrame, settings: Settings, **options) -> DataFrame:
    """Re-drawn and synthetic positives that replace the originals: ``id, kind, vector``.

    ``positives`` holds one row per draw: ``id, draw, vector``. No positives, or a target of none, leaves them as they are.
    """
    n_pos = positives.count()
    n_resample, n_synthetic = target_sizes(n_pos, settings)
    if n_pos == 0 or n_resample + n_synthetic <= 0:
        return positives.select("id", F.lit("original").alias("kind"), "vector")
    # The vectors of an id are the same in all its draws.
    vectors = materialise(positives.groupBy("id").agg(F.first("vector").alias("vector")), "vectors")
    rated = difficulty_weights(vectors, background, settings.difficulty_neighbors, **options)
    rated_draws = positives.select("id", F.col("draw").alias("source_draw")).join(rated.select("id", "difficulty"), "id")
    rated_draws = materialise(rated_draws, "rated-draws")
    key = ["id", "source_draw"]
    resampled = difficulty_resample(rated_draws, n_resample, settings.seed, key).join(vectors, "id")
    synthetic = smote_synthesize(rated_draws, vectors, n_synthetic, settings, key, **options)
    return resampled.select("id", F.lit("resampled").alias("kind"), "vector").unionByName(
        synthetic.select("id", F.lit("synthetic").alias("kind"), "vector")
    )
