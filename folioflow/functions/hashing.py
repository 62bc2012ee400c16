"""Deterministic uniforms: a function of seed and key, never of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_52 = 4503599627370496.0


def hash52(tag: str, *keys: Column | str) -> Column:
    """52-bit integer from the md5 of ``tag:key:...``."""
    text = F.concat_ws(":", F.lit(tag), *[_as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")


def uniform(tag: str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return hash52(tag, *keys) / F.lit(TWO_52)


def open_uniform(tag: str, *keys: Column | str) -> Column:
    """Uniform double in (0, 1), safe under a logarithm."""
    return (hash52(tag, *keys) + F.lit(1).cast("bigint")) / F.lit(TWO_52 + 1)


def _as_column(key: Column | str) -> Column:
    return F.col(key) if isinstance(key, str) else key
