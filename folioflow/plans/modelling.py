"""Draws, difficulty, synthesis and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.operators import model, sampling
from folioflow.plans.bindings import (
    COEFFICIENTS,
    INTERCEPT,
    SETTINGS,
    SQL_CLEAN,
    SQL_SCORE,
    Bound,
    sql_hash52,
    sql_open_uniform,
    sql_uniform,
    with_ctes,
)
from folioflow.plans.joining import quota_sql
from folioflow.plans.registry import query
from folioflow.session import materialise

UNIT = 1 << 20


def draw_sql(rows: str, n: str, weight: str, tag: str, name: str, key: tuple[str, ...] = ("id",)) -> str:
    """CTEs of a systematic draw over ``rows``; ``name`` holds one row per copy."""
    offset = int(sampling.tag_fraction(tag) * UNIT)
    keys = ", ".join(key)
    return f""", {name}_w AS (SELECT *, round({weight} * 1e9)::HUGEINT AS w, {sql_hash52('bucket', *key)} % {sampling.HASH_PLACES} AS bucket FROM {rows}),
    {name}_c AS (SELECT *, sum(w) OVER (ORDER BY bucket, {keys} ROWS UNBOUNDED PRECEDING)::HUGEINT AS c, (sum(w) OVER ())::HUGEINT AS t FROM {name}_w),
    {name}_k AS (SELECT *, ({n} * c * {UNIT} + {offset} * t) // (t * {UNIT}) - ({n} * (c - w) * {UNIT} + {offset} * t) // (t * {UNIT}) AS copies FROM {name}_c),
    {name} AS (SELECT * EXCLUDE (w, bucket, c, t, copies), unnest(range(1, copies::BIGINT + 1)) AS draw FROM {name}_k)"""


def distance_sql(positives: str, background: str, k: int = 5, prefix: str = "") -> str:
    return f""", {prefix}pairs AS (SELECT q.id AS q_id, b.id AS id, list_distance(q.vector, b.vector) AS dist FROM {positives} q, {background} b),
    {prefix}near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM {prefix}pairs) WHERE rank <= {k}),
    {prefix}mean AS (SELECT q_id AS id, sum(dist) / count(*) AS distance FROM {prefix}near GROUP BY q_id),
    {prefix}raw AS (SELECT id, distance, CASE WHEN (SELECT max(distance) - min(distance) FROM {prefix}mean) < 1e-10 THEN 1.0::DOUBLE ELSE 1.0 / (distance + 1e-6) END AS difficulty FROM {prefix}mean),
    {prefix}rated AS (SELECT *, difficulty / (SELECT sum(difficulty) FROM {prefix}raw) AS weight FROM {prefix}raw)"""


DISTANCE_SQL = distance_sql("positives", "background")


@query(
    "sample_background",
    with_ctes("unlabelled", "label_rows")
    + f""" SELECT id, title FROM unlabelled ORDER BY {sql_uniform('42:bg', 'id')}, id LIMIT (SELECT count(*) FROM label_rows WHERE preference = 'like')""",
)
def sample_background(b: Bound) -> DataFrame:
    n = int(SETTINGS.neg_sample_ratio * b.labels.where("preference = 'like'").count())
    return sampling.sample_background(b.unlabelled, n, SETTINGS.seed).select("id", "title")


TRAINING_SQL = f""", liked AS (SELECT count(*) AS n FROM papers p JOIN label_rows l ON p.id = l.id WHERE l.preference = 'like'),
    drawn_bg AS (SELECT id, v1, v2 FROM unlabelled ORDER BY {sql_uniform('42:bg', 'id')}, id LIMIT (SELECT n FROM liked)),
    training AS (SELECT *, list_concat(v1, v2)::DOUBLE[] AS vector FROM (SELECT p.id, (l.preference = 'like')::BIGINT AS label, p.v1, p.v2 FROM papers p JOIN label_rows l ON p.id = l.id
        UNION ALL SELECT id, 0, v1, v2 FROM drawn_bg) WHERE {SQL_CLEAN})"""


@query(
    "training_set",
    with_ctes("papers", "label_rows", "unlabelled")
    + TRAINING_SQL
    + " SELECT id, label, len(vector) AS dims, round(list_sum(vector), 6) AS total FROM training",
)
def training_set(b: Bound) -> DataFrame:
    rows = model.training_set(b.papers.join(b.labels.select("id", "preference"), "id"), b.unlabelled, SETTINGS)
    return rows.select(
        "id",
        F.col("label").cast("bigint").alias("label"),
        F.size("features").cast("bigint").alias("dims"),
        F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query("fit_logistic")
def fit_logistic(b: Bound) -> DataFrame:
    """Coefficients of the model trained on the bound tables."""
    rows = materialise(
        model.training_set(b.papers.join(b.labels.select("id", "preference"), "id"), b.unlabelled, SETTINGS), "training"
    )
    fitted = model.fit_logistic(rows, SETTINGS)
    values = [(-1, float(fitted.intercept)), *enumerate(float(c) for c in fitted.coefficients)]
    return b.spark.createDataFrame(values, "position bigint, coefficient double")


@query(
    "fit_logistic_optimum",
    with_ctes("papers", "label_rows", "unlabelled")
    + TRAINING_SQL
    + """, per AS (SELECT label, count(*) AS n FROM training GROUP BY label)
    SELECT 'class_rows' AS part, label AS position, n::DOUBLE AS value FROM per
    UNION ALL SELECT 'weight', label, round((SELECT sum(n) FROM per) / (2.0 * n), 6)::DOUBLE FROM per
    UNION ALL SELECT 'gradient', unnest(range(-1, (SELECT max(len(vector)) FROM training))), 0.0::DOUBLE""",
)
def fit_logistic_optimum(b: Bound) -> DataFrame:
    """Class weights of the fit, and the gradient at its model, which SQL knows to be zero."""
    rows = materialise(
        model.training_set(b.papers.join(b.labels.select("id", "preference"), "id"), b.unlabelled, SETTINGS), "training"
    )
    found = model.optimality(model.fit_logistic(rows, SETTINGS), rows, SETTINGS)
    digits = F.when(F.col("part") == "gradient", F.round("value", 3)).otherwise(F.round("value", 6))
    return found.select("part", "position", (digits + F.lit(0.0)).alias("value"))


@query("score_papers", with_ctes("scored") + " SELECT id, title, round(score, 6) AS score FROM scored")
def score_papers(b: Bound) -> DataFrame:
    clean = b.clean_papers.select("id", "title", "vector")
    return model.score_fixed(clean, COEFFICIENTS, INTERCEPT, "vector").select("id", "title", F.round("score", 6).alias("score"))


@query(
    "confidence_resample",
    with_ctes("positives")
    + f", rated AS (SELECT id, {SQL_SCORE} AS score FROM positives)"
    + draw_sql("rated", "(SELECT count(*) FROM rated)", "(CASE WHEN score >= 0.9 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)", "42:confidence", "drawn")
    + " SELECT id, draw, round(score, 6) AS score FROM drawn",
)
def confidence_resample(b: Bound) -> DataFrame:
    scored = model.score_fixed(b.positives, COEFFICIENTS, INTERCEPT, "vector").select("id", "score")
    return model.confidence_resample(materialise(scored, "positives"), SETTINGS).select(
        "id", F.col("draw").cast("bigint").alias("draw"), F.round("score", 6).alias("score")
    )


@query(
    "difficulty_weights",
    with_ctes("positives", "background") + DISTANCE_SQL + " SELECT id, round(distance, 6) AS distance, round(weight, 6) AS weight FROM rated",
)
def difficulty_weights(b: Bound) -> DataFrame:
    rated = model.difficulty_weights(b.positives, b.background, SETTINGS.difficulty_neighbors)
    return rated.select("id", F.round("distance", 6).alias("distance"), F.round("weight", 6).alias("weight"))


@query(
    "difficulty_resample",
    with_ctes("positives", "background")
    + DISTANCE_SQL
    + draw_sql("rated", "(SELECT count(*) FROM rated)", "difficulty", "42:resample", "drawn")
    + " SELECT id, draw, round(distance, 6) AS distance FROM drawn",
)
def difficulty_resample(b: Bound) -> DataFrame:
    rated = model.difficulty_weights(b.positives, b.background, SETTINGS.difficulty_neighbors)
    n_resample, _ = model.target_sizes(rated.count(), SETTINGS)
    drawn = model.difficulty_resample(rated, n_resample, SETTINGS.seed)
    return drawn.select("id", F.col("draw").cast("bigint").alias("draw"), F.round("distance", 6).alias("distance"))


def smote_sql(rated: str, vectors: str, n: str, key: tuple[str, ...] = ("id",)) -> str:
    """CTEs of the synthesis; ``synthetic`` holds the new vectors."""
    k = f"least(16, (SELECT count(*) FROM {vectors}) - 1)"
    return (
        draw_sql(rated, n, "difficulty", "42:parents", "parents", key)
        + f""", planned AS (SELECT *, (1 + floor({sql_uniform('42:nn', *key, 'draw')} * {k}))::BIGINT AS pick, {sql_uniform('42:alpha', *key, 'draw')} AS alpha FROM parents),
    self_pairs AS (SELECT q.id AS q_id, b.id AS n_id, list_distance(q.vector, b.vector) AS dist FROM {vectors} q, {vectors} b WHERE q.id <> b.id),
    self_near AS (SELECT q_id, n_id, row_number() OVER (PARTITION BY q_id ORDER BY dist, n_id) AS pick FROM self_pairs),
    synthetic AS (SELECT p.*, s.n_id AS neighbor, a.vector AS a, c.vector AS c,
        list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] + p.alpha * (c.vector[i] - a.vector[i])) AS vector
        FROM planned p JOIN self_near s ON p.id = s.q_id AND p.pick = s.pick JOIN {vectors} a ON a.id = p.id JOIN {vectors} c ON c.id = s.n_id)"""
    )


@query(
    "smote_synthesize",
    with_ctes("positives", "background")
    + DISTANCE_SQL
    + smote_sql("rated", "positives", "(SELECT count(*) FROM rated)")
    + """ SELECT id, draw, neighbor, round(alpha, 6) AS alpha, round(vector[1], 6) AS first_value, round(vector[128], 6) AS last_value,
        round(list_sum(vector), 6) AS total FROM synthetic""",
)
def smote_synthesize(b: Bound) -> DataFrame:
    positives = materialise(b.positives, "positives")
    rated = model.difficulty_weights(positives, b.background, SETTINGS.difficulty_neighbors)
    _, n_synthetic = model.target_sizes(rated.count(), SETTINGS)
    made = model.smote_synthesize(rated.select("id", "difficulty"), positives, n_synthetic, SETTINGS)
    v = F.col("vector")
    return made.select(
        "id",
        F.col("draw").cast("bigint").alias("draw"),
        "neighbor",
        F.round("alpha", 6).alias("alpha"),
        F.round(v[0], 6).alias("first_value"),
        F.round(v[127], 6).alias("last_value"),
        F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(
    "balanced_positives",
    with_ctes("positives", "background")
    + f", scored_pos AS (SELECT id, {SQL_SCORE} AS score FROM positives)"
    + draw_sql("scored_pos", "(SELECT count(*) FROM scored_pos)", "(CASE WHEN score >= 0.9 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)", "42:confidence", "confident")
    + """, chosen AS (SELECT id, vector FROM positives WHERE id IN (SELECT id FROM confident))"""
    + distance_sql("chosen", "background")
    + """, rated_draws AS (SELECT c.id, c.draw AS source_draw, r.difficulty FROM confident c JOIN rated r ON c.id = r.id)"""
    + draw_sql("rated_draws", "(SELECT count(*) FROM confident)", "difficulty", "42:resample", "redrawn", ("id", "source_draw"))
    + smote_sql("rated_draws", "chosen", "(SELECT count(*) FROM confident)", ("id", "source_draw"))
    + """ SELECT id, 'resampled' AS kind, round(list_sum(p.vector), 6) AS total FROM redrawn JOIN positives p USING (id)
    UNION ALL SELECT id, 'synthetic', round(list_sum(vector), 6) FROM synthetic""",
)
def balanced_positives(b: Bound) -> DataFrame:
    scored = materialise(model.score_fixed(b.positives, COEFFICIENTS, INTERCEPT, "vector"), "positives")
    draws = materialise(model.confidence_resample(scored, SETTINGS).select("id", "draw", "vector"), "draws")
    balanced = model.balanced_positives(draws, b.background, SETTINGS)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return balanced.select("id", "kind", F.round(total, 6).alias("total"))


@query(
    "weighted_pick",
    with_ctes("scored")
    + f""" SELECT id, round(score, 6) AS score FROM scored ORDER BY -ln({sql_open_uniform('42:pick', 'id')}) / score, id LIMIT (SELECT count(*) // 4 FROM scored)""",
)
def weighted_pick(b: Bound) -> DataFrame:
    """A quarter of the papers, likely ones preferred."""
    scored = materialise(b.scored.select("id", "score"), "scored")
    return sampling.weighted_pick(scored, scored.count() // 4, F.col("score"), SETTINGS.seed).withColumn("score", F.round("score", 6))


def _register_quota(name: str, rate: float) -> None:
    @query(name, quota_sql(rate) + ' SELECT id, round(score, 6) AS score, "show" FROM flagged')
    def run(b: Bound) -> DataFrame:
        scored = materialise(b.scored.select("id", "score"), "scored")
        flagged = sampling.adaptive_quota(scored, rate, SETTINGS.high_threshold, SETTINGS.boundary_threshold, SETTINGS.seed)
        return flagged.select("id", F.round("score", 6).alias("score"), F.col("show").cast("int").alias("show"))


# A quota inside the high scores, one reaching into the boundary, one beyond it.
for _name, _rate in (("adaptive_quota", 0.05), ("adaptive_quota_boundary", 0.3), ("adaptive_quota_rest", 0.8)):
    _register_quota(_name, _rate)
