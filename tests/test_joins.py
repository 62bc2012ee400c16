import pytest
from pyspark.sql import functions as F

from folioflow.config import Settings
from folioflow.operators import aggregates, filters, joins
from tests.conftest import rows


def labels(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, preference string")


def test_rows_without_id_are_in_neither_side(spark):
    papers = labels(spark, ("1", "x"), ("2", "x"), (None, "x"))
    known, rest = joins.split_labelled(papers, labels(spark, ("1", "like"), (None, "like")))
    assert rows(known, "id") == [("1",)] and rows(rest, "id") == [("2",)]
    assert rows(joins.remove_published(papers, labels(spark, ("1", "x"))), "id") == [("2",)]


def test_enrich_overwrites_with_null_and_takes_the_last(spark):
    digests = spark.createDataFrame([("1", "old", 0.1), ("2", "old", 0.2)], "id string, abstract string, score double")
    preds = spark.createDataFrame([("1", "early", 0.5, 1), ("1", None, 0.9, 2)], "id string, abstract string, score double, step int")
    made = joins.enrich_metadata(digests, preds, ["abstract", "score"], F.col("step"))
    assert rows(made, "id", "abstract", "score", "enriched") == [("1", None, 0.9, True), ("2", "old", 0.2, False)]


def test_patch_keeps_rows_without_news(spark):
    made = joins.patch_labels(labels(spark, ("1", "unknown"), ("2", "like")), labels(spark, ("1", "dislike")))
    assert rows(made) == [("1", "dislike"), ("2", "like")]


def test_merge_prefers_local_values(spark):
    local = spark.createDataFrame([("1", None, "l1"), ("2", "mine", "l2")], "id string, title string, only_local string")
    remote = spark.createDataFrame([("1", "theirs", 1), ("2", "theirs", 2), ("3", "theirs", 3)], "id string, title string, only_remote int")
    made = joins.merge_tables(local, remote)
    assert made.columns == ["id", "title", "only_local", "only_remote"]
    assert rows(made) == [("1", "theirs", "l1", 1), ("2", "mine", "l2", 2), ("3", "theirs", None, 3)]


def test_merge_with_nothing_or_without_ids(spark):
    local = labels(spark, ("1", "like"))
    empty = local.limit(0)
    assert rows(joins.merge_tables(local, empty)) == [("1", "like")]
    assert rows(joins.merge_tables(local, empty.drop("id"))) == [("1", "like")]
    with pytest.raises(ValueError):
        joins.merge_tables(local.drop("id"), local)


def test_responses_without_request_or_sense(spark):
    ok = '{"response": {"candidates": [{"content": {"parts": [{"text": "{\\"slug\\": \\"s\\", \\"keywords\\": [\\"k\\"]}"}]}}]}}'
    cut = ok.replace("]}\\\"", "").replace('\\"]}"', '\\""')
    responses = spark.createDataFrame([(0, ok), (7, ok), (1, cut), (2, '{"error": "x"}')], "idx int, line string")
    requests = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, id string")
    good, bad = joins.correlate_responses(responses, requests, "m", "en", "now")
    assert rows(good, "idx", "id", "slug", "preference") == [(0, "a", "s", "unknown"), (7, "unknown_7", "s", "unknown")]
    assert rows(bad) == [(1, "b", "malformed"), (2, "c", "error")]


def test_fallback_order(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    texts = lambda *p: spark.createDataFrame(list(p), "id string, text string")
    cached, latex, pdf = texts(("1", "c")), texts(("1", "l"), ("2", "l")), texts(("2", "p"), ("3", "p"))
    made = joins.extraction_fallback(ids, cached, latex, pdf)
    assert rows(made) == [("1", "c", "cached"), ("2", "l", "latex"), ("3", "p", "pdf"), ("4", None, "failed")]
    forced = joins.extraction_fallback(ids, cached, latex, pdf, force_pdf=True)
    assert rows(forced, "id", "method") == [("1", "cached"), ("2", "pdf"), ("3", "pdf"), ("4", "failed")]
    assert rows(joins.failed_ids(ids, made.where("text is not null"))) == [("4",)]


def test_pending_work(spark):
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("3",)], "id string")
    done = spark.createDataFrame([("1", True), ("2", False)], "id string, ok boolean")
    assert rows(joins.pending_work(asked, done)) == [("1", "skipped"), ("2", "failed"), ("3", "pending")]
    assert rows(joins.still_pending(asked, done)) == [("2",), ("3",)]


def test_stack_needs_equal_columns(spark):
    with pytest.raises(Exception):
        joins.stack_tables(labels(spark, ("1", "x")), spark.range(1)).collect()


def test_titles_of_discussions(spark):
    titles = ["a/b/2504.18116/", "2504.18116v2", "2504.181", "", None, " 2504.18116 ", "x/2504.18116//"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    made = [r[0] for r in df.select(filters.paper_id_of_title(F.col("title"))).collect()]
    assert made == ["2504.18116", "2504.18116v2", None, None, None, "2504.18116", None]
    published = spark.createDataFrame([("2504.18116",)], "id string")
    assert filters.paper_id_filter(df, published).count() == 2


def test_category_filter(spark):
    df = spark.createDataFrame(
        [("two", ["a", "b"]), ("none", ["z"]), ("null", None), ("hole", ["z", None]), ("hit", [None, "a"])], "id string, categories array<string>"
    )
    assert rows(filters.category_filter(df, ["a", "b"]), "id") == [("hit",), ("two",)]


def test_date_window(spark):
    df = spark.createDataFrame([("2024-12-23",), ("2024-12-24",), ("2024-12-31",)], "updated string")
    assert filters.date_window(df, Settings()).count() == 2
    assert filters.date_window(df, Settings(start_date="2024-12-24")).count() == 2
    both = Settings(start_date="2024-12-23", end_date="2024-12-24")
    assert rows(filters.date_window(df, both)) == [("2024-12-23",), ("2024-12-24",)]


def test_year_filter_only_when_the_scan_starts_earlier(spark):
    df = spark.createDataFrame([("2023-05-01",), ("2024-05-01",)], "updated string")
    assert filters.year_filter(df, 2023, 2024).count() == 1
    assert filters.year_filter(df, 2024, 2024).count() == 2


def test_reactions_of_the_owner(spark):
    df = spark.createDataFrame(
        [("1", "THUMBS_UP", "o"), ("1", "EYES", "o"), ("2", "EYES", "o"), ("2", "THUMBS_DOWN", "o"), ("3", "ROCKET", "o"),
         ("4", "HEART", "other"), ("5", "", "o")],
        "id string, content string, login string",
    )
    assert rows(aggregates.reaction_to_label(df, "o")) == [("1", "like"), ("2", "dislike"), ("3", "unknown")]


def test_upsert_keeps_the_last(spark):
    new = spark.createDataFrame([("b", "like", 1), ("b", "neutral", 2), ("c", "like", 1)], "id string, preference string, step int")
    old = spark.createDataFrame([("a", "unknown", 1), ("a", "like", 2), ("b", "dislike", 1)], "id string, preference string, step int")
    made = aggregates.upsert_keep_last(old, new, [F.col("step")], [F.col("step")])
    assert rows(made, "id", "preference") == [("a", "like"), ("b", "neutral"), ("c", "like")]


def test_score_bands_leave_out_one(spark):
    df = spark.createDataFrame([(0.3, 1), (0.9, 0), (1.0, 1)], "score double, show int")
    assert rows(aggregates.score_bands_report(df)) == [("0.3-0.5", 1, 1, 1.0), ("0.9-1.0", 1, 0, 0.0)]


def test_vector_quality(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(str(i), "2024-01-01", [nan] if i < 7 else None if i < 9 else [1.0]) for i in range(10)], "id string, updated string, v array<float>"
    )
    (found,) = aggregates.vector_quality(df, ["v"]).collect()
    assert (found["rows"], found["nan_vectors"], found["null_vectors"], found["removed"], found["removed_pct"]) == (10, 7, 2, 9, 90.0)
    assert found["bad_ids"] == "0,1,2,3,4"


def test_unique_tags_keep_the_first_spelling(spark):
    df = spark.createDataFrame([("2", ["big model", "x"]), ("1", ["y", "Big Model"])], "id string, tags array<string>")
    assert rows(aggregates.unique_tags(df)) == [("big-model", "Big Model"), ("x", "x"), ("y", "y")]


def test_schema_diff(spark):
    found = joins.schema_diff(labels(spark, ("1", "x")), spark.createDataFrame([("1", 2), ("2", 2)], "id string, n int"))
    assert rows(found) == [("id", "common", 1, 2), ("n", "remote_only", 1, 2), ("preference", "local_only", 1, 2)]
