"""Joins between papers, labels, published rows and responses.

Join strategies are left to Spark: it broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import text as T
from folioflow.operators.aggregates import owner_reaction_ranks, rank_to_preference
from folioflow.operators.filters import paper_id_filter

ENRICHED_COLUMNS = ("score", "title", "authors", "abstract", "categories", "created", "updated")


def split_labelled(papers: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers with a label and papers without one. Rows without an id belong to neither."""
    ids = labels.select("id").where(F.col("id").isNotNull())
    known = papers.where(F.col("id").isNotNull())
    return known.join(ids, "id", "left_semi"), known.join(ids, "id", "left_anti")


def labelled_join(papers: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` must hold one row per id."""
    return papers.join(labels.select("id", "preference"), "id", "inner")


def remove_published(papers: DataFrame, published: DataFrame) -> DataFrame:
    return papers.where(F.col("id").isNotNull()).join(published.select("id"), "id", "left_anti")


def pending_work(requested: DataFrame, finished: DataFrame) -> DataFrame:
    """Requested ids with ``status``: ``pending``, ``skipped`` (done before) or ``failed`` (tried, no result).

    ``finished`` holds ``id`` and ``ok``.
    """
    done = finished.groupBy("id").agg(F.max("ok").alias("_ok"))
    status = F.when(F.col("_ok").isNull(), "pending").when(F.col("_ok"), "skipped").otherwise("failed")
    return requested.select("id").distinct().join(done, "id", "left").select("id", status.alias("status"))


def still_pending(requested: DataFrame, finished: DataFrame) -> DataFrame:
    """The ids left to do."""
    return requested.select("id").distinct().join(finished.where("ok").select("id"), "id", "left_anti")


def enrich_metadata(
    digests: DataFrame,
    predictions: DataFrame,
    columns: Sequence[str] = ENRICHED_COLUMNS,
    order: Column | None = None,
) -> DataFrame:
    """Overwrite ``columns`` for ids found in ``predictions``, nulls included; ``enriched`` tells which.

    With several prediction rows per id the last one in ``order`` wins.
    """
    packed = F.struct(*columns)
    new = predictions.groupBy("id").agg(F.max_by(packed, order if order is not None else packed).alias("_new"))
    joined = digests.join(new, "id", "left")
    found = F.col("_new").isNotNull()
    merged = {
        c: F.when(found, F.col(f"_new.{c}")).otherwise(F.col(c) if c in digests.columns else F.lit(None)) for c in columns
    }
    return joined.withColumns({**merged, "enriched": found}).drop("_new")


def patch_labels(published: DataFrame, patch: DataFrame) -> DataFrame:
    """New preference where the patch has one. ``patch`` holds one row per id."""
    new = patch.select("id", F.col("preference").alias("_new"))
    return (
        published.join(new, "id", "left")
        .withColumn("preference", F.coalesce("_new", "preference"))
        .select(*published.columns)
    )


def labels_from_discussions(reactions: DataFrame, published_ids: DataFrame, owner: str) -> DataFrame:
    """``id, preference`` of published papers from ``title, content, login`` rows.

    Reactions are reduced to one rank per title before anything is joined, so a discussion holding a
    third of them costs one row per task.
    """
    by_title = owner_reaction_ranks(reactions, owner, "title")
    ranks = paper_id_filter(by_title, published_ids).groupBy("id").agg(F.min("rank").alias("rank"))
    return ranks.select("id", rank_to_preference(F.col("rank")).alias("preference"))


def merge_tables(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Full outer merge on ``id``: local values first, remote where local is null; local column order first."""
    if "id" not in local.columns:
        raise ValueError("the local table needs an id column")
    if "id" not in remote.columns:
        return local
    remote_only = [c for c in remote.columns if c not in local.columns]
    left, right = local.alias("l"), remote.alias("r")
    joined = left.join(right, F.col("l.id") == F.col("r.id"), "full")
    out = []
    for c in local.columns:
        value = F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")) if c in remote.columns else F.col(f"l.{c}")
        out.append(value.alias(c))
    return joined.select(*out, *[F.col(f"r.{c}").alias(c) for c in remote_only])


def correlate_responses(
    responses: DataFrame, requests: DataFrame, model: str, lang: str, summary_time: str
) -> tuple[DataFrame, DataFrame]:
    """Attach paper ids to response lines by the carried request index.

    ``responses``: ``idx, line``; ``requests``: ``idx, id``. Returns parsed summaries and rejected
    lines (``idx, id, reason``: an error entry, or text that is no JSON object). A line whose index was
    never asked for gets the id ``unknown_<idx>``.
    """
    joined = responses.join(requests.select("idx", F.col("id").alias("_id")), "idx", "left").select(
        "idx",
        "line",
        F.coalesce("_id", F.concat(F.lit("unknown_"), F.col("idx").cast("string"))).alias("id"),
        T.once(T.response_text(F.col("line"))).alias("_payload"),
    )
    parsed = joined.select("idx", "line", "id", "_payload", T.once(T.parse_summary(F.col("_payload"))).alias("_summary"))
    good = F.col("_payload").isNotNull() & F.col("_summary._corrupt_record").isNull()
    summaries = parsed.where(good).select(
        "idx",
        *[F.col(f"_summary.{f}").alias(f) for f in T.SUMMARY_FIELDS],
        F.lit(model).alias("model"),
        F.lit(lang).alias("lang"),
        "id",
        F.lit("unknown").alias("preference"),
        F.lit(summary_time).alias("summary_time"),
    )
    reason = F.when(F.get_json_object("line", "$.error").isNotNull(), "error").otherwise("malformed")
    return summaries, parsed.where(~good).select("idx", "id", reason.alias("reason"))


def extraction_fallback(
    requested: DataFrame, cached: DataFrame, latex: DataFrame, pdf: DataFrame, force_pdf: bool = False
) -> DataFrame:
    """First text available per id: cached, then latex (unless ``force_pdf``), then pdf; with ``method``."""
    sources = [("cached", cached), ("latex", latex), ("pdf", pdf)]
    if force_pdf:
        sources.pop(1)
    out = requested.select("id")
    method = F
    for name, table in sources:
        out = out.join(table.select("id", F.col("text").alias(f"_{name}")), "id", "left")
        method = method.when(F.col(f"_{name}").isNotNull(), F.lit(name))
    text = F.coalesce(*[F.col(f"_{name}") for name, _ in sources])
    return out.select("id", text.alias("text"), method.otherwise(F.lit("failed")).alias("method"))


def stack_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Vertical union; all tables must have the same columns."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out


def failed_ids(requested: DataFrame, extracted: DataFrame) -> DataFrame:
    return requested.select("id").distinct().join(extracted.select("id"), "id", "left_anti")


def schema_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Every column with the side it is on, and both row counts."""
    names = [*local.columns, *[c for c in remote.columns if c not in local.columns]]

    def side(name: str) -> str:
        if name in local.columns and name in remote.columns:
            return "common"
        return "local_only" if name in local.columns else "remote_only"

    counts = local.agg(F.count(F.lit(1)).alias("local_rows")).withColumn(
        "remote_rows", remote.agg(F.count(F.lit(1))).scalar()
    )
    listed = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(side(n)).alias("side")) for n in names])
    return counts.select(F.explode(listed).alias("c"), "local_rows", "remote_rows").select(
        "c.column", "c.side", "local_rows", "remote_rows"
    )
