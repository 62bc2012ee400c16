from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions import posts as P
from folioflow.functions import text as T
from folioflow.functions import vectors as V
from folioflow.functions.hashing import open_uniform, uniform
from tests.conftest import rows


def values(spark, texts, make, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_slugify_splits_at_borders(spark):
    texts = ["LLM Agents-GPT4 Meta-Learning", "Few-Shot Learning", "don't", "Über Straße", "fooBar2", "", "大模型 X"]
    assert values(spark, texts, T.slugify) == [
        "llm-agents-gpt-4-meta-learning", "few-shot-learning", "dont", "uber-strasse", "foo-bar-2", "", "大模型-x",
    ]


def test_post_path(spark):
    df = spark.createDataFrame(
        [("a", "../content/a.md"), ("x/b", "../content/My Notes/_old/deep dir/b.md"), ("c", None)], "id string, p string"
    )
    made = df.select(T.post_path(F.col("id"), F.col("p"), "../content"))
    assert [r[0] for r in made.collect()] == ["/posts/a", "/posts/my-notes/deep-dir/b", "/posts/c"]


def test_strip_references_uses_the_first_heading(spark):
    assert values(spark, ["a\n# Reference b # Reference c", "plain"], T.strip_references) == ["a\n", "plain"]


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 10])
def test_truncate_middle_at_the_limit(spark, limit):
    exact, longer = " ".join(["w"] * limit), " ".join(["w"] * (limit + 1))
    kept, cut = values(spark, [exact, longer], lambda x: T.truncate_middle(x, limit))
    assert kept == exact
    assert "omitted" in cut


def test_truncate_middle_cuts_both_sides_for_a_long_marker(spark):
    # 20 tokens allowed: 8 + 6 stay, a marker of 9 leaves -3, so 2 go on each side.
    text = " ".join(f"t{i}" for i in range(30))
    marker = " " + "m " * 9
    (cut,) = values(spark, [text], lambda x: T.truncate_middle(x, 20, marker=marker))
    assert cut == "t0 t1 t2 t3 t4 t5 " + marker + "t26 t27 t28 t29"


def test_count_tokens_and_budget(spark):
    assert values(spark, [" a  b\nc ", ""], T.count_tokens) == [3, 0]
    assert T.paper_token_budget(1000) == 47000


def test_list_text_forms(spark):
    lists = [None, [], ["a"], ["a,b", "c"]]
    joined = values(spark, lists, T.list_join, "array<string>")
    assert joined == [None, "", "a", "a,b\x1fc"]
    assert values(spark, joined, T.list_split) == [None, [""], ["a"], ["a,b", "c"]]


def test_float_text_has_plain_digits(spark):
    assert values(spark, [0.00012, 1.0, None], T.float_text, "double") == ["0.000120", "1.000000", None]


def test_equations_and_styles(spark):
    block = values(spark, [" a$b$$ \\cmd[x]{y}{z} "], lambda x: T.clean_equation(x, F.lit(True), clean=True))
    assert block == ["$$ ab  $$\n"]
    assert values(spark, [" x "], lambda x: T.clean_equation(x, F.lit(False))) == ["$x$"]
    styled = values(spark, [["bold", "italic"], ["bold"], ["italic"], [], None], lambda s: T.style_text(F.lit("t"), s), "array<string>")
    assert styled == ["<b><i>t</i></b>", "<b>t</b>", "<i>t</i>", "t", "t"]


def test_preferences_and_scores(spark):
    assert values(spark, ["like", "odd", None], P.preference_symbol) == ["👍", "", ""]
    assert values(spark, [-1.0, 0.3, 0.7, 2.0, None], P.score_band, "double") == ["low", "medium", "high", "high", ""]
    assert values(spark, [0.12345, None], P.score_percent, "double") == ["12.35", None]


def test_paper_month(spark):
    made = values(spark, ["2412.10133", "x/2501.1v2", "none", "2413.1"], P.paper_month)
    assert [str(d) for d in made] == ["2024-12-01", "2025-01-01", "1970-01-01", "2025-01-01"]


def test_smart_score_at_the_edges_of_freshness(spark):
    as_of = datetime(2024, 12, 31)
    days = [7, 8, 37, 38]
    df = spark.createDataFrame([(d, datetime(2024, 12, 31) , None, 0.0, "odd") for d in days], "d int, pub timestamp, mod timestamp, score double, preference string")
    df = df.withColumn("pub", F.timestamp_seconds(F.unix_timestamp("pub") - F.col("d") * 86400))
    made = [r[0] for r in df.orderBy("d").select(P.smart_score(F.lit(str(as_of)).cast("timestamp"))).collect()]
    assert made == pytest.approx([0.4, 0.4 * (1 - 1 / 30), 0.0, 0.0], abs=1e-12)


def test_display_time_takes_the_later_one(spark):
    df = spark.createDataFrame(
        [(datetime(2025, 3, 22, 12, 30), None), (datetime(2025, 3, 22, 12, 30), datetime(2025, 3, 22, 17, 0))],
        "pub timestamp, mod timestamp",
    )
    made = df.select(P.display_date("Asia/Shanghai"), P.display_clock("Asia/Shanghai"))
    assert rows(made) == [("22 Mar, 2025", "08:30 PM"), ("23 Mar, 2025", "01:00 AM")]


def test_uniforms_depend_on_seed_and_key_only(spark):
    df = spark.range(1000).withColumn("u", uniform("a", "id")).withColumn("v", open_uniform("a", "id"))
    again = spark.range(1000).repartition(7).withColumn("u", uniform("a", "id")).withColumn("v", open_uniform("a", "id"))
    assert rows(df) == rows(again)
    low, high, mean = df.agg(F.min("v"), F.max("v"), F.avg("u")).head()
    assert 0 < low < high < 1 and abs(mean - 0.5) < 0.05
    assert df.where(F.col("u") == uniform("b", "id")).count() == 0


def test_vector_defects(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("null", None), ("all", [nan, nan]), ("one", [1.0, nan]), ("good", [1.0, 2.0])], "id string, v array<float>"
    )
    assert rows(df.where(V.all_clean(["v"])), "id") == [("good",)]
    assert rows(df.where(V.all_present(["v"])), "id") == [("all",), ("good",), ("one",)]
    assert rows(df.where("id = 'one'").select(V.nan_to_zero("v"))) == [([1.0, 0.0],)]


def test_front_matter_escapes(spark):
    df = spark.createDataFrame(
        [('A "q"', "1", 'say "x"', ["k"], "m", "2025-01-01T00:00:00+00:00", None, None)],
        "title string, id string, one_sentence_summary string, keywords array<string>, model string, summary_time string, preference string, score double",
    )
    lines = df.select(T.front_matter()).head()[0].split("\n")
    assert lines[1] == 'title: "A \\"q\\""'
    assert lines[3] == 'description: "say \\"x\\""'
    assert lines[7:11] == ["preference: null", "score: null", "featured: false", "draft: false"]
