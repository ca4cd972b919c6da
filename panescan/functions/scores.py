"""Row-level score functions over ``ARRAY<DOUBLE>`` columns; JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Stable softmax: shifted by the maximum before the exponential."""
    exps = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    # struct keeps the exponentials evaluated once
    pair = F.struct(exps.alias("e"), total.alias("t"))
    return F.transform(pair["e"], lambda v: v / pair["t"])


def argmax(values: Column) -> Column:
    """Zero-based position of the maximum; the first one wins."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
