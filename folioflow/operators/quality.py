"""Checks that split good rows from bad ones and say why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.config import PREFERENCES
from folioflow.functions import text as T


def validate_posts(posts: DataFrame, default_author: str = "") -> DataFrame:
    """Defaults for missing fields and the list of broken rules (``violations``)."""
    rules = {
        "title_required": F.col("title").isNull(),
        "description_required": F.col("description").isNull(),
        "pub_required": F.col("pub").isNull(),
        "score_range": F.col("score").isNotNull() & (F.isnan("score") | ~F.col("score").between(0, 1)),
        "preference_value": F.col("preference").isNotNull() & ~F.col("preference").isin(*PREFERENCES),
    }
    broken = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return posts.withColumns(
        {
            "violations": broken,
            "tags": F.coalesce("tags", F.array(F.lit("others"))),
            "author": F.coalesce("author", F.lit(default_author)),
        }
    )


def keyword_conformance(papers: DataFrame, vocabulary: dict[str, Sequence[str]], limit: int = 6) -> DataFrame:
    """Per paper: number of keywords, how many are in the vocabulary, the new ones, and whether the limit holds.

    The vocabulary is configuration of a few hundred words, so it travels as a literal and rows stay in place.
    """
    words = F.array_distinct(F.flatten(F.map_values(T.keyword_vocabulary_map(vocabulary))))
    known = F.filter("keywords", lambda k: F.array_contains(words, k))
    new = F.array_sort(F.array_distinct(F.filter("keywords", lambda k: ~F.array_contains(words, k))))
    return papers.select(
        "id",
        F.coalesce(F.size("keywords"), F.lit(0)).cast("bigint").alias("n_keywords"),
        F.coalesce(F.size(known), F.lit(0)).cast("bigint").alias("n_known"),
        new.alias("new_keywords"),
        (F.size("keywords") <= limit).alias("within_limit"),
    )


_FIELD_TYPES = {name: ("array" if name in ("institution", "keywords") else "string") for name in T.SUMMARY_FIELDS}


def summary_defects(tree: Column) -> Column:
    """``malformed``, or the names of fields that are missing or of the wrong type, of a parsed payload."""
    parsed = F.schema_of_variant(tree).startswith("OBJECT")
    problems = []
    for name, kind in _FIELD_TYPES.items():
        found = F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant"))
        fits = found.isin("ARRAY<STRING>", "ARRAY<VOID>") if kind == "array" else found == "STRING"
        problems.append(F.when(~F.coalesce(fits, F.lit(False)), F.lit(name)))
    return F.when(~F.coalesce(parsed, F.lit(False)), F.array(F.lit("malformed"))).otherwise(
        F.array_compact(F.array(*problems))
    )


def summary_conformance(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``id, payload`` into typed summaries and rejected rows with their ``defects``."""
    trees = payloads.select("id", "payload", T.once(F.try_parse_json("payload")).alias("_tree"))
    checked = trees.select("id", "payload", T.once(summary_defects(F.col("_tree"))).alias("defects"))
    good = checked.where(F.size("defects") == 0).select("id", T.parse_summary(F.col("payload")).alias("s"))
    bad = checked.where(F.size("defects") > 0).select("id", "defects")
    return good.select("id", *[F.col(f"s.{f}").alias(f) for f in T.SUMMARY_FIELDS]), bad
