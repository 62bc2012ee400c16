import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import search


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(3)
    words = [*["the"] * 20, *["and"] * 9, *"abcdefghij", "Rare"]
    rows = [(f"p{i:04d}", " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(400)]
    rows += [("null", None), ("tie1", "zeta zeta"), ("tie2", "zeta\tzeta"), (None, "zeta and no id")]
    return spark.createDataFrame(rows, "id string, text string")


@pytest.mark.parametrize("settings", [{}, {"buckets": 3, "slice_pages": 60, "block": 4}])
def test_the_index_finds_what_a_scan_finds(spark, pages, tmp_path, settings):
    index = str(tmp_path / "index")
    search.write_index(pages, index, **settings)
    for terms in (["the"], ["rare", "the"], ["THE", "the", "and", "b"], ["zeta"], ["nowhere"], ["nowhere", "c", "zeta", "rare"]):
        for n in (1, 7, 1000):
            expected = [tuple(r) for r in search.scan_search(pages, terms, n).collect()]
            found = [tuple(r) for r in search.keyword_search(spark, index, terms, n).collect()]
            assert found == expected
    with pytest.raises(ValueError):
        search.keyword_search(spark, index, [], 3)


def test_a_search_reads_its_folders_and_no_text(spark, pages, tmp_path):
    index = str(tmp_path / "index")
    search.write_index(pages, index, buckets=16)
    blocks = spark.read.parquet(f"{index}/blocks")
    assert "text" not in blocks.columns
    assert blocks.groupBy("term").agg(F.countDistinct("bucket").alias("n")).where("n > 1").count() == 0
    plan = search.keyword_search(spark, index, ["rare"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "text#" not in plan


def test_blocks_fall_and_are_short(spark, pages, tmp_path):
    index = str(tmp_path / "index")
    search.write_index(pages, index, slice_pages=100, block=8)
    rows = spark.read.parquet(f"{index}/blocks").orderBy("term", "slice", "block").collect()
    assert max(r["n"] for r in rows) == 8
    for r in rows:
        counts = [p["tf"] for p in r["postings"]]
        assert counts == sorted(counts, reverse=True) and r["most"] == counts[0] and r["n"] == len(counts)
    the = [p["id"] for r in rows if r["term"] == "the" for p in r["postings"]]
    assert len(the) == len(set(the)) == pages.where(F.array_contains(search.terms_of(F.col("text")), "the")).count()
