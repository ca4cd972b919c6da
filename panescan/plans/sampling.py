"""Splits, quotas and draws; every choice is a function of seed and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panescan import schema
from panescan.functions.hashing import hash_text, uniform

RANK_HEX = 3  # 4096 buckets


def exact_rank(rows: DataFrame, seed, item: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (0-based, in seeded hash order) and ``total`` per key.

    Hash buckets are counted, their running totals give each bucket its offset, and ranks
    are taken inside a bucket.  The hash spreads even one hot key over 4096 windows.
    """
    keys = list(keys)
    hashed = rows.withColumns({"__h": hash_text(seed, item), "__i": item.cast("string")}).withColumn("__b", F.substring("__h", 1, RANK_HEX))
    counts = hashed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    # at most 4096 rows per key
    in_order = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(*keys, "__b", (F.sum("__n").over(in_order) - F.col("__n")).alias("__off"), F.sum("__n").over(whole).alias("total"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__h", "__i")
    ranked = hashed.join(offsets, [*keys, "__b"]).withColumn("rank", F.col("__off") + F.row_number().over(inside) - 1)
    return ranked.drop("__h", "__i", "__b", "__off")


def train_val_split(samples: DataFrame, item: str, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly ceil(n * val) rows are validation."""
    ranked = exact_rank(samples, seed, F.col(item))
    return ranked.withColumn("split", F.when(F.col("rank") < F.ceil(F.col("total") * val), "val").otherwise("train")).drop("rank", "total")


def hash_split(samples: DataFrame, item: str, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffle-free split of about ``val``; not of exact size."""
    return samples.withColumn("split", F.when(uniform(seed, F.col(item)) < val, "val").otherwise("train"))


def weighted_category(u: Column, weights: Sequence[tuple[str, float]]) -> Column:
    """Category whose slice of the running weight share holds ``u``."""
    total = sum(w for _, w in weights)
    pick, upto = F, 0.0
    for name, w in weights[:-1]:
        upto += w
        pick = pick.when(u < upto / total, F.lit(name))
    return pick.otherwise(F.lit(weights[-1][0]))


def weighted_draw(slots: DataFrame, samples: DataFrame, weights: Sequence[tuple[str, float]], seed: int, slot_keys: Sequence[str], item: str = "sample_id") -> DataFrame:
    """Category by weight, then a uniform sample of it; a slot of an empty category is lost.

    Samples carry a rank within their category, so a slot meets exactly one sample by an
    equi join on (category, rank).
    """
    keys = [F.col(k) for k in slot_keys]
    ranked = exact_rank(samples.select("category", item), seed, F.col(item), ["category"])
    sizes = ranked.groupBy("category").agg(F.max("total").alias("n"))  # one row per category
    chosen = slots.withColumn("category", weighted_category(uniform(seed, F.lit("category"), *keys), weights))
    placed = chosen.join(sizes, "category").withColumn("rank", F.floor(uniform(seed, F.lit("sample"), *keys) * F.col("n")).cast("bigint"))
    return placed.join(ranked.drop("total"), ["category", "rank"]).drop("rank", "n")


def quotas(n: int, exclude: Sequence[str] = (), of_total: bool = False) -> list[tuple[str, int]]:
    """Whole-number quota per defect category: int(weight*n), or int(weight/total*n)."""
    total = sum(w for _, i, w in schema.LABELS if i > 0)
    return [
        (name, int((w / total if of_total else w) * n))
        for name, i, w in schema.LABELS
        if i > 0 and name not in exclude
    ]


def quota_draw(images: DataFrame, n: int, exclude: Sequence[str] = (), of_total: bool = False) -> DataFrame:
    """A row per image, category and slot; every image gets every category with a quota."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("category"), F.lit(q).alias("quota")) for c, q in quotas(n, exclude, of_total) if q > 0]
    )
    return images.select("*", F.inline(rows)).select(*images.columns, "category", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("slot"))


def versions(images: DataFrame, k: int, stem: str = "stem") -> DataFrame:
    """``k`` variants per image with suffix ``_v00`` onwards."""
    rows = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("version"))
    return rows.withColumn("variant", F.concat(F.col(stem), F.lit("_v"), F.lpad(F.col("version").cast("string"), 2, "0")))
