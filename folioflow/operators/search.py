"""Term index and ranked search over page bodies; candidate re-scoring."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions import vectors as V
from folioflow.operators.ordering import top_per_key
from folioflow.operators.overlap import common_terms
from folioflow.session import materialise

# Folders of an index, pages of one slice, postings of one block.
BUCKETS, SLICE_PAGES, BLOCK = 64, 100_000, 1024
# Postings that a task gathers before it hands them on, beside those of the page at hand.
_POSTINGS = 50_000


def terms_of(text: Column) -> Column:
    """Lower-case white-space separated terms."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def inverted_index(pages: DataFrame) -> DataFrame:
    """``term, id, tf`` over the whole text of ``id, text``.

    Terms are counted inside the row, so nothing is moved but the postings of ids that several rows have.
    """
    counted = _term_counts(pages)
    several = materialise(pages.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("_id")), "repeated-ids")
    if several.isEmpty():
        return counted
    same = F.col("id").eqNullSafe(F.col("_id"))
    merged = counted.join(several, same, "left_semi").groupBy("term", "id").agg(F.sum("tf").alias("tf"))
    return counted.join(several, same, "left_anti").unionByName(merged)


def _term_counts(pages: DataFrame) -> DataFrame:
    """``term, id, tf`` of each row by itself. Bytes split at the white space that ``terms_of`` splits at."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, terms, times = batch.column("id"), [], [], []

            def taken() -> pa.RecordBatch:
                columns = [pa.array(terms, pa.binary()), ids.take(pa.array(rows, pa.int64())), pa.array(times, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["term", "id", "tf"])

            for row, text in enumerate(batch.column("text")):
                found = Counter((text.as_py() or b"").split())
                rows += [row] * len(found)
                terms += found.keys()
                times += found.values()
                if len(rows) >= _POSTINGS:
                    yield taken()
                    rows, terms, times = [], [], []
            yield taken()

    id_type = pages.schema["id"].dataType.simpleString()
    lowered = pages.select("id", F.lower("text").cast("binary").alias("text"))
    found = lowered.mapInArrow(count, f"term binary, id {id_type}, tf bigint")
    return found.select(F.col("term").cast("string").alias("term"), "id", "tf")


def _wanted(terms: Sequence[str]) -> list[str]:
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    if not wanted:
        raise ValueError("a search needs at least one term")
    return wanted


def scan_search(pages: DataFrame, terms: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best pages by the sum of ``tf * ln(N / df)`` over the query terms, for a single search without an index.

    Term counts are taken inside the row and stored once; the document frequencies are one aggregated
    row, so texts are read once and nothing but the winners is moved.
    """
    wanted = _wanted(terms)
    listed = F.array(*[F.lit(t) for t in wanted])
    may_match = reduce(lambda a, b: a | b, [F.lower("text").contains(t) for t in wanted])
    hits = pages.where(may_match).select(
        "id", F.filter(terms_of(F.col("text")), lambda t: F.array_contains(listed, t)).alias("hits")
    )
    counted = materialise(hits, "hits").where(F.size("hits") > 0)
    counted = counted.select("id", *[_occurrences(t).alias(f"tf_{i}") for i, t in enumerate(wanted)])
    spread = counted.agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(wanted))]).head()
    weights = _weights([spread[f"df_{i}"] for i in range(len(wanted))], pages.count())
    return _best(counted, weights, n)


def _occurrences(term: str) -> Column:
    return F.size(F.filter("hits", lambda t: t == term))


def _weights(frequencies: Sequence[int], n_pages: int) -> list[float]:
    """``ln(N / df)`` of each term; a term on no page has no weight."""
    return [math.log(n_pages / df) if df else 0.0 for df in frequencies]


def _best(counted: DataFrame, weights: Sequence[float], n: int) -> DataFrame:
    """The best of rows with a count ``tf_i`` for each term; terms are added in order, so equal pages have equal sums."""
    score, matched = F.lit(0.0), F.lit(0).cast("bigint")
    for i, weight in enumerate(weights):
        score = score + F.col(f"tf_{i}") * F.lit(weight)
        matched = matched + (F.col(f"tf_{i}") > 0).cast("bigint")
    scored = counted.select("id", score.alias("score"), matched.alias("matched"))
    return scored.orderBy(F.col("score").desc(), "id").limit(n)  # a report that somebody reads


def write_index(pages: DataFrame, path: str, buckets: int = BUCKETS, slice_pages: int = SLICE_PAGES, block: int = BLOCK) -> None:
    """Postings of ``id, text`` as blocks in folders by a hash of the term, so that a search opens its terms only.

    Pages are dealt by a hash of the id into slices of about ``slice_pages``. The postings of a term in a
    slice are ordered by falling count and cut into blocks of ``block``; a block says how many there are
    and the largest count. A term that every page has is as many lists as there are slices, none longer
    than a slice.
    """
    n_pages = pages.count()
    slices = max(1, -(-n_pages // slice_pages))
    # One shuffle: lists and folders are made inside the parts of (bucket, slice).
    place = ["bucket", "slice", "term"]
    terms = inverted_index(pages).withColumn("slice", F.pmod(F.hash("id"), F.lit(slices)))
    dealt = terms.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets))).repartition("bucket", "slice")
    listed = dealt.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("minus"), "id"))).alias("p"))
    cuts = F.sequence(F.lit(0), F.floor((F.size("p") - 1) / block).cast("int"))
    cut = F.transform(cuts, lambda i: F.struct(i.alias("block"), F.slice("p", i * block + 1, block).alias("p")))
    blocks = listed.select(*place, F.explode(cut).alias("b")).select(
        *place,
        "b.block",
        F.size("b.p").alias("n"),
        (-F.get("b.p", F.lit(0))["minus"]).alias("most"),
        F.transform("b.p", lambda p: F.struct(p["id"].alias("id"), (-p["minus"]).alias("tf"))).alias("postings"),
    )
    blocks.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/blocks")
    sizes = pages.sparkSession.createDataFrame([(n_pages, buckets)], "n_pages bigint, buckets int")
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def keyword_search(spark: SparkSession, path: str, terms: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best pages of an index by the sum of ``tf * ln(N / df)`` over the query terms.

    Only folders of the terms are read, and no text. The first blocks of each list bound the n-th best
    score from below; a page that reaches the bound has at least the bound's share by the number of terms in
    one of its postings, so other blocks and postings propose no page, and only proposed pages are summed.
    """
    wanted = _wanted(terms)
    sizes = spark.read.parquet(f"{path}/sizes").head()
    found = spark.read.parquet(f"{path}/blocks")
    at = reduce(lambda a, b: a | b, [(F.col("bucket") == F.pmod(F.hash(F.lit(t)), F.lit(sizes["buckets"]))) & (F.col("term") == t) for t in wanted])
    found = found.where(at)
    frequency = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weights = _weights([frequency.get(t, 0) for t in wanted], sizes["n_pages"])
    weight = reduce(lambda chain, w: chain.when(F.col("term") == w[0], F.lit(w[1])), zip(wanted, weights, strict=True), F).otherwise(0.0)
    found = found.withColumn("weight", weight)
    first = _pages_of(found.where("block = 0")).groupBy("id").agg(F.sum(F.col("tf") * F.col("weight")).alias("part"))
    tops = [r["part"] for r in first.orderBy(F.col("part").desc()).limit(n).collect()]
    # Rounding may put a sum a little below its parts.
    bound = min(tops) / len(wanted) * (1 - 1e-9) if len(tops) == n else 0.0
    heavy = F.col("weight") * F.col("tf") >= F.lit(bound)
    proposed = _pages_of(found.where(F.col("weight") * F.col("most") >= F.lit(bound))).where(heavy).select("id").distinct()
    counts = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for i, t in enumerate(wanted)]
    kept = _pages_of(found).join(proposed.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return _best(kept.groupBy("id").agg(*counts), weights, n)


def _pages_of(blocks: DataFrame) -> DataFrame:
    return blocks.select("term", "weight", F.explode("postings").alias("p")).select("term", "weight", "p.id", "p.tf")


def token_overlap(left: Column, right: Column) -> Column:
    """Jaccard overlap of two token sets."""
    return overlap_share(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right)))


def overlap_share(common: Column, either: Column) -> Column:
    """Jaccard overlap from the sizes of the intersection and the union."""
    return F.when(either > 0, common / either).otherwise(0.0)


def rescore_topn(candidates: DataFrame, papers: DataFrame, n: int, score: Column | None = None) -> DataFrame:
    """Second stage: score (query, candidate) pairs, squash to 0..1, best first.

    ``candidates`` holds ``q_id, id``; ``papers`` ``id, title, abstract``. The default score is the token
    overlap of title and abstract, counted without sending tokens along with pairs; another may be given over
    ``q_tokens`` and ``tokens``, which then go with each pair.
    """
    text = F.concat_ws(" ", "title", "abstract")
    if score is None:
        counted = common_terms(candidates, papers.select("id", F.lower(text).alias("text")))
        raw = overlap_share(F.col("common"), F.col("q_size") + F.col("size") - F.col("common"))
        scored = counted.select("q_id", "id", V.sigmoid(raw).alias("score"))
    else:
        tokens = papers.select("id", F.array_distinct(terms_of(text)).alias("tokens"))
        pairs = (
            candidates.select("q_id", "id")
            .join(tokens, "id")
            .join(tokens.select(F.col("id").alias("q_id"), F.col("tokens").alias("q_tokens")), "q_id")
        )
        scored = pairs.select("q_id", "id", V.sigmoid(score).alias("score"))
    return top_per_key(scored, n, ["q_id"], [F.col("score").desc(), F.col("id")])
