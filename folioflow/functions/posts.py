"""Expressions over posts: scores, labels and dates as shown in the listing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Order of preferences in a listing.
PREFERENCE_ORDER = {"like": 3, "neutral": 2, "dislike": 1, "unknown": 0}

# Weight of a preference in the mixed score.
PREFERENCE_MULTIPLIER = {"unknown": 1.5, "like": 0.8, "neutral": 0.4, "dislike": 0.2}

# Symbol shown for a preference.
PREFERENCE_SYMBOL = {"like": "👍", "dislike": "👎", "neutral": "😐", "unknown": "🤔"}


def post_time() -> Column:
    return F.coalesce(F.col("mod"), F.col("pub"))


def post_seconds() -> Column:
    return F.unix_timestamp(post_time())


def is_visible(as_of: Column, margin_seconds: int) -> Column:
    """Not a draft, and published (or due within the margin)."""
    due = F.unix_timestamp(as_of) > F.unix_timestamp("pub") - F.lit(margin_seconds)
    return ~F.col("draft") & due


def smart_score(as_of: Column) -> Column:
    """Freshness and quality, weighted by how the paper was received."""
    days = F.floor((F.unix_timestamp(as_of) - post_seconds()) / F.lit(86400))
    late = F.greatest(F.lit(0), days - 7).cast("double")
    fresh = F.greatest(F.lit(0.0), F.lit(1.0) - late / F.lit(30))
    quality = F.coalesce(F.col("score"), F.lit(0.5))
    return (fresh * F.lit(0.4) + quality * F.lit(0.6)) * preference_multiplier()


def preference_multiplier() -> Column:
    preference = F.col("preference")
    chain = F.when(preference.isNull() | (preference == ""), F.lit(1.5))
    for name, factor in PREFERENCE_MULTIPLIER.items():
        chain = chain.when(preference == name, F.lit(factor))
    return chain.otherwise(F.lit(1.0))


def preference_rank() -> Column:
    chain = F.when(F.col("preference").isNull(), F.lit(-1))
    for name, rank in PREFERENCE_ORDER.items():
        chain = chain.when(F.col("preference") == name, F.lit(rank))
    return chain.otherwise(F.lit(-1))


def paper_month(paper_id: Column) -> Column:
    """First day of the month coded in the id; ids without one count as 1970-01-01.

    A month code beyond 12 runs on into the next years, as date arithmetic does.
    """
    code = F.regexp_extract(paper_id, r"(\d{4})\.(\d+)", 1)
    year = F.substring(code, 1, 2).try_cast("int") + 2000
    month = F.substring(code, 3, 2).try_cast("int")
    return F.coalesce(
        F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1),
        F.lit("1970-01-01").cast("date"),
    )


def preference_symbol(preference: Column) -> Column:
    chain = F
    for name, symbol in PREFERENCE_SYMBOL.items():
        chain = chain.when(preference == name, F.lit(symbol))
    return chain.otherwise(F.lit(""))


def score_band(score: Column, low: float = 0.3, high: float = 0.7) -> Column:
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return (
        F.when(score.isNull(), F.lit(""))
        .when(clipped < low, F.lit("low"))
        .when(clipped < high, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def score_percent(score: Column) -> Column:
    """Percentage with two decimals; null stays null."""
    return F.when(score.isNotNull(), F.format_string("%.2f", score * F.lit(100.0)))


def latest_time() -> Column:
    """The later of publication and change."""
    return F.greatest(F.col("pub"), F.col("mod"))


def display_date(zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(latest_time(), zone), "d MMM, yyyy")


def display_clock(zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(latest_time(), zone), "hh:mm a")


def month_key(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")
