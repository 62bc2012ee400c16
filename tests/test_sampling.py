import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.config import Settings
from folioflow.operators import model, ordering, sampling
from tests.conftest import rows


def scored(spark, values):
    return spark.createDataFrame([(f"{i:03d}", float(s)) for i, s in enumerate(values)], "id string, score double")


def shown(spark, values, rate):
    flagged = sampling.adaptive_quota(scored(spark, values), rate, 0.85, 0.6, 42)
    return sorted(r["score"] for r in flagged.where("show = 1").collect())


def test_quota_shows_at_least_one(spark):
    assert len(shown(spark, [0.1] * 10, 0.004)) == 1


@pytest.mark.parametrize("rate, n", [(0.2, 2), (0.3, 3)])
def test_quota_with_enough_high_scores(spark, rate, n):
    found = shown(spark, [0.9, 0.95, 0.99] + [0.7] * 3 + [0.1] * 4, rate)
    assert len(found) == n and min(found) >= 0.85


def test_quota_fills_from_the_boundary_then_from_the_rest(spark):
    values = [0.9] + [0.6, 0.7, 0.8] + [0.1] * 6
    assert shown(spark, values, 0.3)[-1] == 0.9 and min(shown(spark, values, 0.3)) >= 0.6
    found = shown(spark, values, 0.6)
    assert [s for s in found if s >= 0.6] == [0.6, 0.7, 0.8, 0.9] and len(found) == 6


def test_quota_without_boundary(spark):
    assert shown(spark, [0.9] + [0.1] * 9, 0.3) == [0.1, 0.1, 0.9]


def test_quota_of_a_single_flagged_place_is_exact_with_equal_scores(spark):
    assert len(shown(spark, [0.5] * 100, 0.37)) == 37


def test_weighted_pick_prefers_weight(spark):
    df = spark.range(2000).select(F.format_string("%04d", "id").alias("id"), F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("w"))
    heavy = sampling.weighted_pick(df, 200, F.col("w"), 42).where("w = 9").count()
    assert 150 < heavy <= 200
    assert sampling.weighted_pick(df.withColumn("w", F.lit(0.0)), 5, F.col("w"), 42).count() == 0


@pytest.mark.parametrize("band, points", [(20_000, 400), (10, 4)])
def test_the_smallest_rows_without_a_funnel(spark, monkeypatch, band, points):
    monkeypatch.setattr(ordering, "CUT_BAND", band)
    monkeypatch.setattr(ordering, "_POINTS", points)
    keys = [(float(i * 7919 % 1000) if i % 5 else 3.0, f"{i:04d}") for i in range(1500)] + [(3.0, "0005")] * 4 + [(None, "null")]
    df = spark.createDataFrame(keys, "key double, id string").repartition(6)
    order = [F.col("key"), F.col("id")]
    expected = sorted(keys, key=lambda r: (r[0] is not None, r))
    for frame, listed in ((df, expected), (df.where("key IS NOT NULL"), expected[1:])):
        for k in (0, 1, 3, 6, 300, len(listed) // 2, len(listed) - 1, len(listed), len(listed) + 5):
            found = ordering.smallest(frame, k, order).collect()
            assert sorted(map(tuple, found), key=lambda r: (r[0] is not None, r)) == listed[:k]


def test_background_sample_is_clipped(spark):
    df = scored(spark, [0.1] * 5).unionByName(spark.createDataFrame([(None, 0.1)], "id string, score double"))
    assert sampling.sample_background(df, 50, 42).count() == 5
    assert sampling.sample_background(df, 2, 42).count() == 2


@pytest.mark.parametrize("n", [1, 7, 100, 1000])
def test_systematic_draw_has_exactly_n_rows(spark, n):
    df = scored(spark, np.linspace(0.01, 1, 57))
    counts = {r["id"]: r["n"] for r in sampling.systematic_draw(df, n, F.col("score"), "t").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == n
    total = sum(np.linspace(0.01, 1, 57))
    for i, w in enumerate(np.linspace(0.01, 1, 57)):
        assert abs(counts.get(f"{i:03d}", 0) - n * w / total) < 1


def test_systematic_draw_ignores_partitioning(spark):
    df = scored(spark, np.linspace(0.01, 1, 57))
    assert rows(sampling.systematic_draw(df, 40, F.col("score"), "t")) == rows(
        sampling.systematic_draw(df.repartition(5), 40, F.col("score"), "t")
    )


def test_running_sums_go_on_over_partitions(spark):
    values = [(i * 7919) % 1009 for i in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int").repartition(7)
    found = ordering.running_sum(df, F.col("v"), [F.col("id")]).orderBy("id").collect()
    assert [int(r["_end"]) for r in found] == np.cumsum(values).tolist()
    assert {int(r["_all"]) for r in found} == {sum(values)}


def test_draws_without_rows_weights_or_with_repeats(spark):
    df = scored(spark, [0.0, 0.0])
    assert sampling.systematic_draw(df, 5, F.col("score"), "t").count() == 0
    assert sampling.systematic_draw(df.limit(0), 5, F.col("score"), "t").count() == 0
    repeated = scored(spark, [0.5] * 3).union(scored(spark, [0.1] * 3))
    assert sampling.systematic_draw(repeated, 11, F.col("score"), "t").count() == 11


def test_ranks_match_a_sort_even_with_one_hot_value(spark):
    df = spark.range(5000).select(
        F.format_string("%05d", (F.col("id") * 37) % 5000).alias("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("v")
    )
    ranked = ordering.with_rank(df, [F.col("v").desc(), F.col("id").asc()], total="total").collect()
    expected = sorted(((r["v"], r["id"]) for r in ranked), key=lambda t: (-t[0], t[1]))
    assert [(r["v"], r["id"]) for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    assert {r["total"] for r in ranked} == {5000}
    grouped = ordering.with_rank(df, [F.col("id").asc()], group=["v"], total="total").collect()
    for v in {r["v"] for r in grouped}:
        part = sorted((r for r in grouped if r["v"] == v), key=lambda r: r["id"])
        assert [r["rank"] for r in part] == list(range(1, len(part) + 1))
        assert {r["total"] for r in part} == {len(part)}


def test_ranks_of_a_null_group(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "g")], "id string, g string")
    assert rows(ordering.with_rank(df, [F.col("id").asc()], group=["g"]), "id", "rank") == [("a", 1), ("b", 2), ("c", 1)]


def test_smallest_beyond_the_heap(spark, monkeypatch):
    df = spark.range(300)
    monkeypatch.setattr(ordering, "CUT_BAND", 10)
    assert [r[0] for r in ordering.smallest(df, 50, [F.col("id")]).orderBy("id").collect()] == list(range(50))
    assert ordering.smallest(df, 0, [F.col("id")]).count() == 0


def test_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_BLOCK", 7)
    ranked = spark.range(1, 31).select(F.col("id").alias("rank"), F.col("id").cast("string").alias("id"))
    found = ordering.neighbours(ranked, ["id"]).orderBy("rank").collect()
    assert [(r["prev_id"], r["next_id"]) for r in found] == [
        (str(i - 1) if i > 1 else None, str(i + 1) if i < 30 else None) for i in range(1, 31)
    ]


def test_equal_distances_give_equal_weights(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "id string, distance double")
    assert rows(model.with_difficulty(df), "difficulty", "weight") == [(1.0, 0.5), (1.0, 0.5)]


def test_target_sizes():
    assert model.target_sizes(169, Settings()) == (169, 169)
    assert model.target_sizes(3, Settings(pos_sampling_ratio=1.0)) == (2, 1)


def test_background_draws_mean_ids_at_every_size(spark, monkeypatch):
    df = scored(spark, [0.1] * 50)
    twice = df.unionByName(df.where("id LIKE '%1'"))
    whole = rows(sampling.sample_background(twice, 20, 42))
    assert len({r[0] for r in whole}) == 20
    monkeypatch.setattr(ordering, "CUT_BAND", 5)
    assert rows(sampling.sample_background(twice, 20, 42)) == whole
