import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import knn, overlap, search
from folioflow.plans.bindings import Bound
from tests.conftest import rows


def test_rescoring_equals_a_comparison_pair_by_pair(spark):
    """Ids that repeat, are null or have no text, repeated pairs, texts without terms; few terms and most in one part."""
    draw = random.Random(3)
    texts = [(f"p{i % 55}", " ".join(draw.choices("a É é b\tC c\n\x0bd \x1ce f ß z".split(" "), k=i % 7)), "x" * (i % 3)) for i in range(60)]
    texts += [("none", None, None), ("blank", " \n", ""), (None, "a b", "c")]
    ids = [t[0] for t in texts] + ["gone"]
    papers = spark.createDataFrame(texts, "id string, title string, abstract string")
    pairs = spark.createDataFrame([tuple(draw.choices(ids, k=2)) for _ in range(700)], "q_id string, id string")
    apart = search.rescore_topn(pairs, papers, 10_000, search.token_overlap(F.col("q_tokens"), F.col("tokens")))
    found = search.rescore_topn(pairs, papers, 10_000)
    assert found.schema == apart.schema
    assert rows(found) == rows(apart)
    lowered = papers.select("id", F.lower(F.concat_ws(" ", "title", "abstract")).alias("text"))
    counted = overlap.common_terms(pairs, lowered, resident_bytes=4)  # a part for each term
    assert counted.count() == found.count()
    assert rows(counted) == rows(overlap.common_terms(pairs, lowered))


def test_rescoring_of_no_pairs_and_of_ids_that_are_numbers(spark):
    papers = spark.createDataFrame([(1, "a b", "c"), (2, "a", "c d")], "id int, title string, abstract string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 7)], "q_id bigint, id bigint")
    assert search.rescore_topn(pairs.limit(0), papers, 3).collect() == []
    apart = search.rescore_topn(pairs, papers, 3, search.token_overlap(F.col("q_tokens"), F.col("tokens")))
    assert rows(search.rescore_topn(pairs, papers, 3)) == rows(apart)


def test_blocks_of_pairs_count_like_sets(monkeypatch):
    """More queries and terms than a look-up takes, texts longer than one, texts that have no term of the part."""
    draw = random.Random(4)
    words = [f"w{i}".encode() for i in range(40)]
    sets = [set(draw.sample(range(40), draw.choice([0, 1, 5, 38]))) for _ in range(30)]
    sets[15:20] = [set()] * 5
    pairs = sorted((draw.randrange(30), draw.randrange(30)) for _ in range(400))
    asked, met = np.array(pairs).T
    for queries, marked, looked_up in ((4, 1000, 1000), (100, 30, 1000), (100, 1000, 25)):
        monkeypatch.setattr(overlap, "_QUERIES", queries)
        monkeypatch.setattr(overlap, "_MARKED", marked)
        monkeypatch.setattr(overlap, "_LOOKED_UP", looked_up)
        held = overlap._Held(30)
        for numbers in ([*range(20, 30)], [*range(15)]):  # 15 to 19 are not added
            listed = words[::-1] if numbers[0] else words
            codes = [listed.index(words[c]) for n in numbers for c in sorted(sets[n])]
            sizes, lengths = [len(sets[n]) for n in numbers], [len(w) for w in listed]
            held.add(*[np.array(column, dtype=np.int32) for column in (numbers, sizes, codes, lengths)], b"".join(listed))
        assert held.common(asked, met).tolist() == [len(sets[a] & sets[b]) for a, b in pairs]
    assert overlap._Held(30).common(asked, met).tolist() == [0] * 400


def test_tokens_are_not_copied_for_each_pair(spark):
    """With each paper in 60 pairs on either side, what is shuffled and stored stays near the size of the texts."""
    papers = spark.range(60).select(
        F.concat(F.lit("p"), "id").alias("id"),
        F.lit("t").alias("title"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.md5(F.concat("id", F.lit(" "), i)))).alias("abstract"),
    )
    ids = papers.select("id")
    pairs = ids.withColumnRenamed("id", "q_id").crossJoin(ids)
    text_bytes = papers.agg(F.sum(F.length("abstract"))).first()[0]
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    stored = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))

    def on_disk():
        listed = files.getAllFiles()
        shuffled = sum(f.length() for f in (listed.apply(i) for i in range(listed.size())) if f.getName().startswith("shuffle_"))
        return shuffled + sum(f.stat().st_size for f in stored.rglob("*") if f.is_file())

    before = on_disk()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the papers are many
    try:
        assert search.rescore_topn(pairs, papers, 100).count() == 3600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    grown = on_disk() - before
    assert grown < 6 * text_bytes, grown / text_bytes


def test_texts_come_as_often_as_papers(spark, tmp_path):
    """A paper with several vectors is one row for each, here as in the table of papers."""
    documents = [(1, "a\nb", "en", "src1"), (2, "c", "de", "src2"), (3, "d", "en", "src1"), (3, "d e", "en", "src1")]
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(1, [0.5]), (1, [1.0]), (3, [0.25]), (3, [0.5]), (3, [1.0]), (9, [1.0])]
    for name, more in (("several", []), ("none", [(1, None)])):
        path = tmp_path / name
        path.mkdir()
        (path / "documents.parquet").symlink_to(f"{tmp_path}/documents.parquet")
        found = vectors if name == "several" else [(1, [0.5]), (3, [0.25]), *more]
        spark.createDataFrame(found, "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
        bound = Bound(spark, str(path))
        papers = bound.papers.where("doc_id <> 1 OR v2 IS NOT NULL").select("id", "title", "abstract")
        assert rows(bound.paper_texts) == rows(papers)


def test_a_base_in_many_parts_gives_few_candidates(spark):
    """Each task of the scan gives k rows a query, so parts are put together to some tasks a core."""
    vectors = spark.range(500).select(F.format_string("b%d", "id").alias("id"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    queries = vectors.limit(10)
    assert knn._scan_base(queries, vectors.repartition(100), 5, "cosine", False).count() <= 10 * 5 * 3 * spark.sparkContext.defaultParallelism
    assert rows(knn.cosine_topn(queries, vectors.repartition(100), 5)) == rows(knn.cosine_topn(queries, vectors, 5))
