import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.config import Settings
from folioflow.operators import knn, model
from folioflow.plans.recommend import train
from tests.conftest import rows


def frame(spark, matrix, prefix="p"):
    return spark.createDataFrame(
        [(f"{prefix}{i:04d}", [float(x) for x in row]) for i, row in enumerate(matrix)], "id string, vector array<double>"
    )


def brute(queries, base, k, q_prefix, b_prefix, metric="euclidean", exclude_self=False):
    out = set()
    for i, q in enumerate(queries):
        found = []
        for j, b in enumerate(base):
            if exclude_self and q_prefix == b_prefix and i == j:
                continue
            if metric == "cosine":
                d = 1 - q @ b / np.sqrt((q @ q) * (b @ b))
            else:
                d = np.sqrt(((q - b) ** 2).sum())
            found.append((round(float(d), 12), f"{b_prefix}{j:04d}", float(d)))
        for rank, (_, name, d) in enumerate(sorted(found)[:k], 1):
            out.add((f"{q_prefix}{i:04d}", name, round(d, 6) + 0.0, rank))
    return out


def answer(near):
    return {(r["q_id"], r["id"], round(r["dist"], 6) + 0.0, r["rank"]) for r in near.collect()}


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 6))
    base[100:240] = base[0]  # a third of the rows are copies
    queries = np.vstack([rng.normal(size=(40, 6)), base[:5]])
    return queries, base


PLANS = {
    "scan": {},
    "cells": {"broadcast_bytes": 0, "cells_below": 2},
    "blocks": {"broadcast_bytes": 0, "cells_below": 0, "block_bytes": 12_000},
    "sampled": {"broadcast_bytes": 0},
}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("plan", PLANS)
def test_knn_equals_brute_force(spark, clouds, metric, plan):
    queries, base = clouds
    near = knn.knn_join(frame(spark, queries, "q"), frame(spark, base, "b"), 7, metric, **PLANS[plan])
    assert answer(near) == brute(queries, base, 7, "q", "b", metric)


@pytest.mark.parametrize("plan", PLANS)
def test_knn_leaves_out_the_row_itself(spark, clouds, plan):
    _, base = clouds
    points = frame(spark, base)
    near = knn.knn_join(points, points, 3, exclude_self=True, **PLANS[plan])
    assert answer(near) == brute(base, base, 3, "p", "p", exclude_self=True)


def test_cells_with_many_chunks(spark, clouds, monkeypatch):
    """Small chunks force several base and query chunks per cell."""
    queries, base = clouds
    monkeypatch.setattr(knn, "BLOCK_BYTES", 6 * 8 * 12)
    monkeypatch.setattr(knn, "MIN_CHUNK_ROWS", 16)
    near = knn.knn_join(frame(spark, queries, "q"), frame(spark, base, "b"), 5, broadcast_bytes=0, cells_below=2)
    assert answer(near) == brute(queries, base, 5, "q", "b")


def test_a_task_holds_bounded_queries(spark, clouds, monkeypatch):
    """What is held for a query counts, not its vector alone, and a query of the cells is not copied once a cell."""
    queries, base = clouds
    sides, held, told = [], [], knn._sides
    monkeypatch.setattr(knn, "_scan_base", lambda *a: held.append(a) or pytest.fail("all queries in every task"))
    monkeypatch.setattr(knn, "_sides", lambda *a: sides.append(told(*a)) or sides[-1])
    asked, vectors = len(queries), len(queries) * 6 * 8
    for below in (0, 2):
        near = knn.knn_join(frame(spark, queries, "q"), frame(spark, base, "b"), 7, broadcast_bytes=2 * vectors, block_bytes=2 * vectors, cells_below=below)
        assert answer(near) == brute(queries, base, 7, "q", "b")
    for q_blocks, b_shares in sides:
        assert -(-asked // q_blocks) * knn._held_bytes(6, 7) <= 2 * vectors + knn._held_bytes(6, 7) and b_shares == 1


def test_rows_of_one_id_are_all_left_out():
    """A query's own id may stand in several rows of a block."""
    near = knn._Nearest(np.array(["a", "b"]), np.zeros((2, 2)), 3, "euclidean", True)
    near.add(np.array(["a", "a", "b", "c"]), np.arange(8.0).reshape(4, 2))
    assert [b.to_pydict()["id"] for b in near.batches()] == [["b", "c", "a", "a", "c"]]


def test_a_sample_tells_whether_cells_rule_anything_out(spark):
    rng = np.random.default_rng(5)
    flat, deep = rng.uniform(size=(3000, 2)), rng.normal(size=(3000, 64))
    assert knn._Cells(frame(spark, flat), 5, "euclidean", 2).visited(frame(spark, flat[:50])) < 0.2
    assert knn._Cells(frame(spark, deep), 5, "euclidean", 64).visited(frame(spark, deep[:50])) > 0.8


def test_k_is_clipped_and_nothing_asked_gives_nothing(spark):
    base = frame(spark, np.eye(3))
    assert knn.knn_join(base, base, 10).count() == 9
    assert [knn.knn_join(base, base, 10, **plan).count() for plan in PLANS.values()] == [9] * len(PLANS)
    assert [knn.knn_join(base, base.limit(0), 10, **plan).count() for plan in PLANS.values()] == [0] * len(PLANS)
    assert knn.knn_join(base.limit(0), base, 10).count() == 0


def test_logistic_reaches_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (x @ [2.0, -1.0, 0.5, 0.0] + rng.normal(size=300) > 1).astype(int)
    df = frame(spark, x).withColumnRenamed("vector", "features").join(
        spark.createDataFrame([(f"p{i:04d}", int(v)) for i, v in enumerate(y)], "id string, label int"), "id"
    )
    fitted = model.fit_logistic(df, Settings(regularisation_c=0.7))
    w, b = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    assert np.abs(0.7 * x.T @ (weight * (p - y)) + w).max() < 1e-3
    assert abs((weight * (p - y)).sum()) < 1e-3
    scored = model.score_rows(fitted, df).orderBy("id").collect()
    assert [r["score"] for r in scored] == pytest.approx(list(p))
    assert rows(model.score_fixed(df, list(w), b).select(F.round("score", 6))) == sorted(
        [(round(float(v), 6),) for v in p], key=repr
    )


def test_training_needs_both_classes(spark):
    df = frame(spark, np.eye(3)).select("id", F.lit(1).alias("label"), F.col("vector").alias("features"))
    with pytest.raises(ValueError):
        model.fit_logistic(df, Settings())


def draws(spark, matrix):
    return frame(spark, matrix).withColumn("draw", F.lit(1))


@pytest.mark.parametrize("n, kinds", [(0, {}), (1, {"resampled": 1}), (2, {"resampled": 2, "synthetic": 2})])
def test_balanced_positives_of_few_rows(spark, n, kinds):
    background = frame(spark, np.random.default_rng(3).normal(size=(30, 3)), "b")
    made = model.balanced_positives(draws(spark, np.eye(3)[:n]) if n else draws(spark, np.eye(3)).limit(0), background, Settings())
    found = {r["kind"]: r["n"] for r in made.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert found == kinds


def test_synthetic_rows_lie_between_their_ends(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(20, 3))
    background = frame(spark, rng.normal(size=(50, 3)), "b")
    rated = model.difficulty_weights(frame(spark, points), background, 5)
    made = model.smote_synthesize(rated, frame(spark, points), 15, Settings()).collect()
    assert len(made) == 15
    for r in made:
        a, c = points[int(r["id"][1:])], points[int(r["neighbor"][1:])]
        assert r["id"] != r["neighbor"] and 0 <= r["alpha"] < 1
        assert r["vector"] == pytest.approx(list(a + r["alpha"] * (c - a)))


def test_background_ratio_beyond_the_table(spark):
    nan = float("nan")
    labelled = spark.createDataFrame([("1", "like", [1.0], [1.0]), ("2", "dislike", [0.0], [2.0])], "id string, preference string, v1 array<float>, v2 array<float>")
    rest = spark.createDataFrame([("3", [0.5], [0.5]), ("4", [nan], [0.5]), ("5", None, [0.5])], "id string, v1 array<float>, v2 array<float>")
    made = model.training_set(labelled, rest, Settings(embedding_columns=("v1", "v2")))
    assert rows(made, "id", "label") == [("1", 1), ("2", 0), ("3", 0)]


@pytest.mark.parametrize("confidence", [True, False])
@pytest.mark.parametrize("difficulty", [True, False])
def test_resampling_steps_can_be_switched_off(spark, confidence, difficulty):
    labelled = spark.createDataFrame(
        [(str(i), "like" if i < 12 else "dislike", [float(i), 1.0, float(i % 5)]) for i in range(40)], "id string, preference string, v array<double>"
    )
    rest = spark.createDataFrame([(f"r{i}", [30.0 + i, 2.0, float(i % 3)]) for i in range(60)], "id string, v array<double>")
    settings = Settings(embedding_columns=("v",), confidence_weighting=confidence, difficulty_sampling=difficulty)
    fitted = train(labelled, rest, settings)
    scored = model.score_rows(fitted, spark.createDataFrame([("a", [1.0, 1.0, 1.0]), ("b", [60.0, 2.0, 1.0])], "id string, features array<double>"))
    by = {r.id: r.score for r in scored.collect()}
    assert 0 <= by["b"] < by["a"] <= 1


def test_optimality_is_the_gradient_of_the_objective(spark):
    """At the fit the gradient is nothing; at another model it is that of numpy."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(60, 4))
    y = (x[:, 0] + draw.normal(size=60) > 0.8).astype(int)
    rows = spark.createDataFrame([(int(t), v.tolist()) for t, v in zip(y, x, strict=True)], "label int, features array<double>")
    settings = Settings(regularisation_c=0.5)
    fitted = model.fit_logistic(rows, settings)
    found = {(r["part"], r["position"]): r["value"] for r in model.optimality(fitted, rows, settings).collect()}
    assert [found["class_rows", k] for k in (0, 1)] == np.bincount(y).tolist()
    assert [found["weight", k] for k in (0, 1)] == pytest.approx((60 / 2 / np.bincount(y)).tolist())
    assert max(abs(found["gradient", j]) for j in range(-1, 4)) < 1e-4
    other = Settings(regularisation_c=50.0)
    found = {r["position"]: r["value"] for r in model.optimality(fitted, rows, other).where("part = 'gradient'").collect()}
    b = fitted.coefficients.toArray()
    pull = (60 / 2 / np.bincount(y))[y] * (1 / (1 + np.exp(-(x @ b + fitted.intercept))) - y)
    whole = np.concatenate([[pull.sum()], x.T @ pull + b / 50.0]) / 60
    assert [found[j] for j in range(-1, 4)] == pytest.approx(whole.tolist(), abs=1e-12) and max(abs(whole)) > 1e-3
