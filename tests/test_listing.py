from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.config import Settings
from folioflow.operators import aggregates, filters, quality, ranking, search
from tests.conftest import rows

AS_OF = datetime(2024, 12, 31)
SETTINGS = Settings(as_of=AS_OF)
SCHEMA = (
    "id string, title string, pub timestamp, mod timestamp, score double, preference string, draft boolean, "
    "tags array<string>, featured boolean, description string, file_path string"
)


def posts(spark, *changes):
    base = {
        "title": "t", "pub": datetime(2024, 1, 1), "mod": None, "score": 0.5, "preference": "unknown", "draft": False,
        "tags": ["x"], "featured": False, "description": "d", "file_path": None,
    }
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    made = [{**base, "id": f"p{i}", **change} for i, change in enumerate(changes)]
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], SCHEMA)


def ranked_ids(spark, rule, *changes):
    found = ranking.ranked_posts(posts(spark, *changes), SETTINGS, rule)
    return [r["id"] for r in found.orderBy("rank").collect()]


def test_posts_due_within_the_margin_are_visible(spark):
    df = posts(spark, {"pub": AS_OF + timedelta(minutes=14)}, {"pub": AS_OF + timedelta(minutes=16)}, {"draft": True})
    assert rows(filters.visible_posts(df, SETTINGS), "id") == [("p0",)]
    assert rows(filters.visible_posts(df, SETTINGS, preview=True), "id") == [("p0",), ("p1",)]


def test_orders_and_ties(spark):
    day = lambda n: datetime(2024, 1, n)
    assert ranked_ids(spark, "date_desc", {"pub": day(1)}, {"pub": day(2)}, {"pub": day(1)}, {"pub": day(1), "mod": day(3)}) == ["p3", "p1", "p0", "p2"]
    assert ranked_ids(spark, "date_asc", {"pub": day(2)}, {"pub": day(1)}) == ["p1", "p0"]
    assert ranked_ids(spark, "score_desc", {"score": None}, {"score": 0.0}, {"score": 0.9}) == ["p2", "p1", "p0"]
    kinds = [{"preference": p} for p in ("unknown", "dislike", "like", None, "neutral", "odd")]
    assert ranked_ids(spark, "preference", *kinds) == ["p2", "p4", "p1", "p0", "p3", "p5"]
    assert ranked_ids(spark, "smart", {"preference": "like"}, {"preference": None}, {"preference": "unknown"}, {"preference": "odd"}) == ["p1", "p2", "p3", "p0"]
    by_paper = ranked_ids(spark, "paper_date_desc", {"id": "none"}, {"id": "2401.2"}, {"id": "2412.1"})
    assert by_paper == ["2412.1", "2401.2", "none"]


@pytest.mark.parametrize("n, pages", [(0, []), (1, [1]), (5, [1] * 5), (6, [1] * 5 + [2])])
def test_pages(spark, n, pages):
    df = posts(spark, *[{}] * n) if n else posts(spark, {}).limit(0)
    found = ranking.paginate(ranking.ranked_posts(df, SETTINGS, total="total"), 5).orderBy("rank").collect()
    assert [r["page"] for r in found] == pages
    assert {r["last_page"] for r in found} == ({pages[-1]} if pages else set())


def test_neighbours_end_in_null(spark):
    df = posts(spark, {"score": 0.9}, {"score": 0.5}, {"score": 0.1})
    found = ranking.prev_next(df, SETTINGS, "score_desc").orderBy("rank").collect()
    assert [(r["prev_id"], r["id"], r["next_id"]) for r in found] == [(None, "p0", "p1"), ("p0", "p1", "p2"), ("p1", "p2", None)]


def test_tags_share_a_slug(spark):
    df = posts(spark, {"tags": ["Big Model", "big-model"]}, {"tags": ["y"]}, {"tags": ["bigModel"]})
    assert rows(ranking.posts_by_tag(df, "big-model", SETTINGS, "date_desc"), "id") == [("p0",), ("p2",)]
    tagged = ranking.posts_of_tags(df, SETTINGS, "date_desc")
    assert rows(tagged, "tag", "id", "rank", "total") == [("big-model", "p0", 1, 2), ("big-model", "p2", 2, 2), ("y", "p1", 1, 1)]


def test_featured_and_recent(spark):
    df = posts(spark, {"featured": True}, *[{"score": i / 10} for i in range(5)])
    found = ranking.featured_recent(df, SETTINGS, "score_desc")
    assert rows(found, "section", "rank", "id") == [("featured", 1, "p0"), ("recent", 1, "p5"), ("recent", 2, "p4"), ("recent", 3, "p3")]


def test_archive_counts_use_the_zone_of_the_site(spark):
    df = posts(spark, {"pub": datetime(2023, 12, 31, 17)}, {"pub": datetime(2024, 2, 1)}, {"draft": True})
    assert [tuple(r) for r in aggregates.archive_counts(df, "Asia/Shanghai").collect()] == [(2024, None, 2), (2024, 2, 1), (2024, 1, 1)]


def test_feed_links(spark):
    df = posts(spark, {"file_path": "../content/My Dir/p0.md"})
    assert rows(ranking.feed(df, SETTINGS, "https://s"), "link") == [("https://s/posts/my-dir/p0/",)]


def test_post_rules(spark):
    df = posts(spark, {}, {"title": None, "score": 1.5}, {"preference": "odd", "tags": None}, {"pub": None, "description": None})
    checked = quality.validate_posts(df.withColumn("author", F.lit(None).cast("string")), "me")
    assert rows(checked, "id", "violations") == [
        ("p0", []), ("p1", ["title_required", "score_range"]), ("p2", ["preference_value"]), ("p3", ["description_required", "pub_required"]),
    ]
    assert rows(checked.where("id = 'p2'"), "tags", "author") == [(["others"], "me")]


def test_keywords_against_the_vocabulary(spark):
    df = spark.createDataFrame([("1", ["A", "B", "Z", "Y"]), ("2", [])], "id string, keywords array<string>")
    found = quality.keyword_conformance(df, {"g": ["A"], "h": ["B", "A"]}, limit=3)
    assert rows(found) == [("1", 4, 2, ["Y", "Z"], False), ("2", 0, 0, [], True)]


GOOD = '{"institution": [], "reasoning_step": "", "problem_background": "b", "method": "m", "experiment": "e", "one_sentence_summary": "o", "slug": "s", "keywords": ["k"], "further_thoughts": "f"}'


def test_summaries_with_wrong_types_are_split_off(spark):
    nested = GOOD.replace('"method": "m"', '"method": {"core": "m"}')
    df = spark.createDataFrame(
        [("good", GOOD), ("nested", nested), ("short", GOOD.replace('"slug": "s", ', "")), ("cut", GOOD[:-1]), ("list", "[1]"), ("none", None)],
        "id string, payload string",
    )
    good, bad = quality.summary_conformance(df)
    assert rows(good, "id", "slug", "keywords") == [("good", "s", ["k"])]
    assert rows(bad) == [("cut", ["malformed"]), ("list", ["malformed"]), ("nested", ["method"]), ("none", ["malformed"]), ("short", ["slug"])]


def test_search_scores(spark):
    pages = spark.createDataFrame([("1", "a a b"), ("2", "b  A"), ("3", "c")], "id string, text string")
    assert rows(search.inverted_index(pages)) == [("a", "1", 2), ("a", "2", 1), ("b", "1", 1), ("b", "2", 1), ("c", "3", 1)]
    found = search.scan_search(pages, ["a", "A", "zzz"], 1).collect()
    assert [(r["id"], round(r["score"], 6)) for r in found] == [("1", 0.81093)]


def test_rescoring_prefers_common_words(spark):
    papers = spark.createDataFrame([("q", "x y", "z"), ("near", "x y", "z"), ("far", "u", "v")], "id string, title string, abstract string")
    pairs = spark.createDataFrame([("q", "near"), ("q", "far")], "q_id string, id string")
    found = search.rescore_topn(pairs, papers, 2).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in found] == [("near", 0.731059), ("far", 0.5)]


def test_terms_are_counted_in_the_row_and_repeated_ids_are_merged(spark):
    """White space is that of the pattern; a null id is an id; without repeated ids no posting is shuffled."""
    pages = spark.createDataFrame(
        [("1", "É x y\tx\x0bX\x1cq \n"), ("2", None), ("3", ""), ("4", "a"), ("4", "A b"), (None, "a"), (None, "a")], "id string, text string"
    )
    plain = pages.select("id", F.explode(search.terms_of(F.col("text"))).alias("term")).groupBy("term", "id").count()
    assert rows(search.inverted_index(pages), "term", "id", "tf") == rows(plain, "term", "id", "count")
    single = search.inverted_index(pages.where("id < '4'"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
