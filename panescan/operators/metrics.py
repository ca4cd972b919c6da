"""Prediction against truth on overlay segments (``a`` = prediction, ``b`` = truth)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators.raster import length, run_events, sweep


def confusion_counts(segments: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixels per (keys, truth, pred); the one shuffle all pixel metrics share."""
    return segments.groupBy(*keys, F.col("b").alias("truth"), F.col("a").alias("pred")).agg(
        F.sum(length()).alias("n")
    )


def class_sums(counts: DataFrame, num_classes: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Long table keys, class_id, inter, pred_n, true_n with rows for absent classes too."""
    wide = counts.groupBy(*keys).agg(
        *[
            agg
            for c in range(num_classes)
            for agg in (
                F.sum(F.when((F.col("pred") == c) & (F.col("truth") == c), F.col("n")).otherwise(0)).alias(f"i{c}"),
                F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"p{c}"),
                F.sum(F.when(F.col("truth") == c, F.col("n")).otherwise(0)).alias(f"t{c}"),
            )
        ]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("class_id"),
                F.col(f"i{c}").alias("inter"),
                F.col(f"p{c}").alias("pred_n"),
                F.col(f"t{c}").alias("true_n"),
            )
            for c in range(num_classes)
        ]
    )
    return wide.select(*keys, F.inline(cells))


def union_n() -> Column:
    return F.col("pred_n") + F.col("true_n") - F.col("inter")


def iou_dice(counts: DataFrame, num_classes: int, ignore: int = -1, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """IoU is 1 for a class absent on both sides, Dice is 0 there (its 1e-8 guard)."""
    return (
        class_sums(counts, num_classes, keys)
        .where(F.col("class_id") != ignore)
        .withColumn("iou", F.when(union_n() > 0, F.col("inter") / union_n()).otherwise(1.0))
        .withColumn("dice", 2 * F.col("inter") / (F.col("pred_n") + F.col("true_n") + F.lit(1e-8)))
    )


def mean_iou_dice(per_class: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return per_class.groupBy(*keys).agg(F.avg("iou").alias("mean_iou"), F.avg("dice").alias("mean_dice"))


def full_metrics(counts: DataFrame, num_classes: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Absent on both sides counts as 1 for IoU and Dice alike."""
    total = F.col("pred_n") + F.col("true_n")
    return (
        class_sums(counts, num_classes, keys)
        .withColumn("iou", F.when(union_n() > 0, F.col("inter") / union_n()).otherwise(1.0))
        .withColumn("dice", F.when(total > 0, 2 * F.col("inter") / total).otherwise(1.0))
        .withColumn("class_name", schema.class_name_of(F.col("class_id")))
    )


def confusion_matrix(counts: DataFrame, num_classes: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """All n*n cells per key, zero cells included, with the row share (null for an empty row)."""
    cells = [(t, p) for t in range(num_classes) for p in range(num_classes)]
    wide = counts.groupBy(*keys).agg(
        *[
            F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("n")).otherwise(0)).alias(f"m{t}_{p}")
            for t, p in cells
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("truth"),
                F.lit(p).alias("pred"),
                F.col(f"m{t}_{p}").alias("n"),
                F.try_divide(F.col(f"m{t}_{p}"), sum((F.col(f"m{t}_{q}") for q in range(num_classes)), F.lit(0))).alias("share"),
            )
            for t, p in cells
        ]
    )
    return wide.select(*keys, F.inline(rows))


def disc_half_widths(radius: int) -> list[int]:
    """Half width of each row of the elliptic dilation footprint, top to bottom."""
    return [round((radius * radius - dy * dy) ** 0.5) for dy in range(-radius, radius + 1)]


def dilate_runs(runs: DataFrame, radius: int, height: int | Column, width: int | Column) -> DataFrame:
    """Each run grows to one run per footprint row, cut at the frame; results may overlap.

    ``height`` and ``width`` are one size for all images, or columns of ``runs``.
    """
    height, width = (v if isinstance(v, Column) else F.lit(v) for v in (height, width))
    rows = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw"))
            for dy, hw in zip(range(-radius, radius + 1), disc_half_widths(radius))
        ]
    )
    keep = [c for c in runs.columns if c not in ("y", "x0", "x1")]
    return (
        runs.select(*keep, "y", "x0", "x1", F.inline(rows))
        .select(
            *keep,
            (F.col("y") + F.col("dy")).alias("y"),
            F.greatest(F.col("x0") - F.col("hw"), F.lit(0)).alias("x0"),
            F.least(F.col("x1") + F.col("hw"), width - 1).cast("int").alias("x1"),
        )
        .where((F.col("y") >= 0) & (F.col("y") < height))
    )


def dilated_sums(runs: DataFrame, pred: str, truth: str, radius: int, height: int | Column, width: int | Column) -> DataFrame:
    """inter, pred_n, true_n per (image, class) after growing every class on its own.

    Grown runs overlap each other; the sweep counts cover depth, so no merge is needed.
    ``runs`` must contain background runs too.
    """
    grown = dilate_runs(runs, radius, height, width)
    row = ("image_id", "class_id", "y")
    events = run_events(
        grown,
        row,
        a=(F.col("layer") == pred).cast("bigint"),
        b=(F.col("layer") == truth).cast("bigint"),
    )
    return (
        sweep(events, row, ("a", "b"))
        .groupBy("image_id", "class_id")
        .agg(
            F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), length()).otherwise(0)).alias("inter"),
            F.sum(F.when(F.col("a") > 0, length()).otherwise(0)).alias("pred_n"),
            F.sum(F.when(F.col("b") > 0, length()).otherwise(0)).alias("true_n"),
        )
    )


def dilated_metrics(sums: DataFrame) -> DataFrame:
    """Absent on both sides: no row.  One-sided: 0.  Otherwise the usual ratios."""
    both = (F.col("pred_n") > 0) & (F.col("true_n") > 0)
    return (
        sums.where("pred_n > 0 or true_n > 0")
        .withColumn("iou", F.when(both, F.col("inter") / union_n()).otherwise(0.0))
        .withColumn("dice", F.when(both, 2 * F.col("inter") / (F.col("pred_n") + F.col("true_n"))).otherwise(0.0))
    )


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def binary_metrics(samples: DataFrame, pred: Column, truth: Column, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, iou, dice; 0 where a denominator is empty."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    sums = samples.groupBy(*keys).agg(
        F.sum(F.when(pred & truth, w).otherwise(0)).alias("tp"),
        F.sum(F.when(pred & ~truth, w).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred & truth, w).otherwise(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        sums.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("iou", ratio(tp, tp + fp + fn))
        .withColumn("dice", ratio(2 * tp, 2 * tp + fp + fn))
    )


# ------------------------------------------------------------------------ loss figures
def cross_entropy(p_truth: Column) -> Column:
    return -F.ln(p_truth)


def score_losses(scores: DataFrame, weights: Sequence[float], gamma: float = 2.0, smooth: float = 1e-6, mix: Sequence[float] = (0.5, 0.3, 0.2), keys: Sequence[str] = ()) -> DataFrame:
    """Weighted cross entropy, soft Dice, weighted focal and their mix, from probs + truth.

    One aggregation: every figure is a function of plain sums.
    """
    n_cls = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("truth") + 1)
    p_t = F.element_at("probs", F.col("truth") + 1)
    base = scores.select(*keys, "probs", "truth", w.alias("w"), p_t.alias("p_t"))
    ce = cross_entropy(F.col("p_t"))
    focal = F.col("w") * F.pow(1 - F.col("p_t"), F.lit(gamma)) * ce
    sums = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("w") * ce).alias("ce_sum"),
        F.sum("w").alias("w_sum"),
        F.sum(focal).alias("focal_sum"),
        *[F.sum(F.when(F.col("truth") == c, F.col("probs")[c]).otherwise(0.0)).alias(f"i{c}") for c in range(n_cls)],
        *[F.sum(F.col("probs")[c]).alias(f"p{c}") for c in range(n_cls)],
        *[F.sum((F.col("truth") == c).cast("double")).alias(f"t{c}") for c in range(n_cls)],
    )
    dice = sum(
        ((2 * F.col(f"i{c}") + smooth) / (F.col(f"p{c}") + F.col(f"t{c}") + smooth) for c in range(n_cls)), F.lit(0.0)
    ) / F.lit(float(n_cls))
    return (
        sums.select(
            *keys,
            "n",
            (F.col("ce_sum") / F.col("w_sum")).alias("ce"),
            (1 - dice).alias("dice_loss"),
            (F.col("focal_sum") / F.col("n")).alias("focal"),
        )
        .withColumn("combined", mix[0] * F.col("ce") + mix[1] * F.col("dice_loss") + mix[2] * F.col("focal"))
    )


def binary_losses(samples: DataFrame, p: Column, truth: Column, alpha: float = 0.5, smooth: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Binary cross entropy plus soft Dice, mixed by alpha."""
    t = truth.cast("double")
    sums = samples.groupBy(*keys).agg(
        F.avg(-(t * F.ln(p) + (1 - t) * F.ln(1 - p))).alias("bce"),
        F.sum(p * t).alias("i"),
        F.sum(p).alias("sp"),
        F.sum(t).alias("st"),
    )
    return sums.select(
        *keys, "bce", (1 - (2 * F.col("i") + smooth) / (F.col("sp") + F.col("st") + smooth)).alias("dice_loss")
    ).withColumn("combined", alpha * F.col("bce") + (1 - alpha) * F.col("dice_loss"))
