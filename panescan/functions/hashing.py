"""Reproducible draws: values depend on seed and keys only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(seed, *keys) -> Column:
    """md5 of ``seed-key-key-...``."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("-", *parts))


def uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1): first 32 hash bits over 2**32."""
    head = F.conv(F.substring(hash_text(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def uniform_int(low, high, seed, *keys) -> Column:
    """Whole number in [low, high], both ends included."""
    return (low + F.floor(uniform(seed, *keys) * (high - low + 1))).cast("bigint")
