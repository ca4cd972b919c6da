"""Class shares, patch, batch and dataset summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators.raster import length


def class_stats(runs: DataFrame, frame_pixels: int | Column, keys: Sequence[str] = ("image_id", "layer"), masks: DataFrame | None = None) -> DataFrame:
    """Pixels and percentage per class, zero rows included.

    ``masks`` lists the masks that exist (the keys, one row each), so that one without runs is
    all background; without it such a mask gives no rows.  Background is what the defect runs leave of the frame, so background runs may be
    present or not.  One aggregation, then an in-row expansion.
    """
    frame = F.lit(frame_pixels) if isinstance(frame_pixels, int) else frame_pixels
    defects = range(1, schema.CLASS_COUNT)
    wide = runs.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("class_id") == c, length()).otherwise(0)).alias(f"n{c}") for c in defects]
    )
    if masks is not None:
        wide = masks.select(*keys).join(wide, list(keys), "left").na.fill(0, [f"n{c}" for c in defects])
    rest = frame - sum((F.col(f"n{c}") for c in defects), F.lit(0))
    cells = F.array(
        F.struct(F.lit(0).alias("class_id"), rest.cast("bigint").alias("pixels")),
        *[F.struct(F.lit(c).alias("class_id"), F.col(f"n{c}").alias("pixels")) for c in defects],
    )
    return wide.select(*keys, F.inline(cells)).select(
        *keys,
        "class_id",
        schema.class_name_of(F.col("class_id")).alias("class_name"),
        "pixels",
        (F.col("pixels") / frame * 100).alias("percentage"),
    )


def class_distribution(runs: DataFrame) -> DataFrame:
    """Exact pixels per class over the whole set and their share; absent classes do not appear."""
    classes = range(schema.CLASS_COUNT)
    one = runs.agg(
        F.sum(length()).alias("total"),
        *[F.sum(F.when(F.col("class_id") == c, length()).otherwise(0)).alias(f"n{c}") for c in classes],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("class_id"),
                F.col(f"n{c}").alias("pixels"),
                (F.col(f"n{c}") / F.col("total")).alias("share"),
            )
            for c in classes
        ]
    )
    return one.select(F.inline(cells)).where("pixels > 0")


def with_labels(df: DataFrame) -> DataFrame:
    """Name and weight of each class id; an unknown id keeps its row with nulls."""
    return df.join(F.broadcast(schema.labels_dim(df.sparkSession)), "class_id", "left")


# --------------------------------------------------------------------------- annotations
DEFECT_NAMES = [name for name, index, _ in schema.LABELS if index > 0]


def category_stats(annotations: DataFrame, rule: str = "name_then_id", images: DataFrame | None = None) -> DataFrame:
    """Annotations per image and defect category, zero rows and ``unknown`` included.

    ``name_then_id``: the name counts; the id only where the name is missing or unknown.
    ``name_or_id``: the first label in index order that fits by name or by id.
    ``images`` lists the images that exist (image_id, one row each): one without annotations has zero
    rows, and annotations of other images are left out.  Without it such an image gives no rows.
    """
    name, cid = F.col("category_name"), F.col("category_id")
    if rule == "name_then_id":
        found = F.when(name.isNull() | (name == "unknown"), schema.class_name_of(cid)).otherwise(name)
        category = F.when(found.isin(DEFECT_NAMES), found).otherwise("unknown")
    elif rule == "name_or_id":
        category = F.coalesce(
            *[F.when((F.coalesce(name, F.lit("")) == n) | (cid == i), F.lit(n)) for n, i, _ in schema.LABELS if i > 0], F.lit("unknown")
        )
    else:
        raise ValueError(f"unknown rule {rule!r}")
    kinds = [*DEFECT_NAMES, "unknown"]
    wide = annotations.groupBy("image_id").agg(*[F.count_if(category == k).alias(k) for k in kinds])
    if images is not None:
        wide = images.select("image_id").join(wide, "image_id", "left").na.fill(0, kinds)
    return wide.select(
        "image_id", F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in kinds]))
    )


def success_rates(attempted: DataFrame, placed: DataFrame, contours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attempts, placements and contours side by side; the rate is contours per attempt."""
    joined = attempted.join(placed, list(keys), "full").join(contours, list(keys), "full").na.fill(0)
    rate = F.coalesce(F.try_divide(F.col("contours").cast("double"), F.col("attempted").cast("double")), F.lit(0.0)) * 100
    return joined.withColumn("success_rate_percent", F.round(rate, 2))


# ------------------------------------------------------------------- patches and images
def patch_class_shares(pixels: DataFrame, keys: Sequence[str] = ("image_id", "patch_id")) -> DataFrame:
    """Share of each class per patch, in percent, from pixels with ``class_id``."""
    wide = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"),
        *[F.count_if(F.col("class_id") == c).alias(f"n{c}") for c in range(schema.CLASS_COUNT)],
    )
    return wide.select(*keys, "pixels", *[(F.col(f"n{c}") / F.col("pixels") * 100).alias(f"pct{c}") for c in range(schema.CLASS_COUNT)])


def defect_percent() -> Column:
    """Share of all non-background classes of a patch row."""
    return sum((F.col(f"pct{c}") for c in range(1, schema.CLASS_COUNT)), F.lit(0.0))


def patch_stats(patches: DataFrame, min_percent: float = 0.01) -> DataFrame:
    """Per image: patch counts and spread of every class share; failed patches count only in total."""
    ok = F.coalesce("status", F.lit("ok")) == "ok"
    figures = []
    for c in range(schema.CLASS_COUNT):
        v = F.when(ok, F.col(f"pct{c}"))
        figures += [F.avg(v).alias(f"avg{c}"), F.max(v).alias(f"max{c}"), F.min(v).alias(f"min{c}"), F.stddev_pop(v).alias(f"std{c}")]
    return patches.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total_patches"),
        F.count_if(ok).alias("valid_patches"),
        F.count_if(ok & (defect_percent() > min_percent)).alias("patches_with_defects"),
        *figures,
    )


def confidence_bands(voted: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Per image and class: mean and top score, pixels above .8, in (.5, .8], up to .5, and cover figures."""
    wide = voted.groupBy(*keys).agg(
        F.max("n").alias("max_cover"),
        F.min("n").alias("min_cover"),
        F.avg("n").alias("avg_cover"),
        *[
            figure
            for c in range(schema.CLASS_COUNT)
            for p in [F.col("probs")[c]]
            for figure in (
                F.avg(p).alias(f"avg{c}"), F.max(p).alias(f"max{c}"), F.count_if(p > 0.8).alias(f"hi{c}"),
                F.count_if((p > 0.5) & (p <= 0.8)).alias(f"mid{c}"), F.count_if(p <= 0.5).alias(f"lo{c}"),
            )
        ],
    )
    rows = [
        F.struct(
            F.lit(c).alias("class_id"), F.col(f"avg{c}").alias("avg_confidence"), F.col(f"max{c}").alias("max_confidence"),
            F.col(f"hi{c}").alias("high"), F.col(f"mid{c}").alias("medium"), F.col(f"lo{c}").alias("low"),
        )
        for c in range(schema.CLASS_COUNT)
    ]
    return wide.select(*keys, "max_cover", "min_cover", "avg_cover", F.inline(F.array(*rows)))


def top_score(probs: Column, defects_only: bool = False) -> Column:
    """Largest class score of a pixel, over all classes or over defects only."""
    return F.array_max(F.slice(probs, 2, schema.CLASS_COUNT) if defects_only else probs)


def perf_stats(rows: DataFrame, seconds: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Total and mean seconds and rows per second; 0 when there is no time."""
    total, n = F.sum(seconds), F.count(seconds)
    return rows.groupBy(*keys).agg(
        F.coalesce(total, F.lit(0.0)).alias("total_time"),
        F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.try_divide(n.cast("double"), total), F.lit(0.0)).alias("per_second"),
    )


def order_image(value: Column) -> Column:
    """A bigint for each double, in the same order; equal values share one, NaN comes last.

    The exponent counts octaves up from the smallest normal double and the mantissa counts steps within
    one; both are exact, as only powers of two are divided by. Negative values mirror positive ones.
    """
    size = F.abs(value)
    octave = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    # a logarithm may be rounded over a power of two
    low, high = F.pow(F.lit(2.0), octave) > size, size / F.pow(F.lit(2.0), octave) >= 2
    octave = F.greatest(F.lit(-1022.0), octave - low.cast("int") + high.cast("int"))
    steps = (size / F.pow(F.lit(2.0), octave) * 2.0**52).cast("bigint")
    image = (octave + 1022).cast("bigint") * (1 << 52) + steps
    image = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(image)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -image).otherwise(image)


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, bits: int = 22) -> DataFrame:
    """Interpolated median per key without holding or sorting a group: keys, median.

    Radix selection: equal values are counted first; then, from the highest ``bits`` bits of the values'
    order-preserving image down, the counts of the prefixes that share the chosen one are added up, and
    the prefix that holds the middle rank is chosen. A pass orders at most 2^bits counts of a key, however
    the values lie; two middle ranks go down side by side and may part on the way.
    """
    keys = list(keys)
    counts = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("image", order_image(F.col("v")))
    chosen: DataFrame | None = None
    for shift in reversed(range(0, 64, bits)):
        prefix = F.shiftright("image", shift).alias("prefix")
        if chosen is None:
            sums = counts.groupBy(*keys, prefix).agg(F.sum("n").alias("n"))
            total = F.sum("n").over(Window.partitionBy(*keys))
            middles = F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))
            before = F.sum("n").over(Window.partitionBy(*keys).orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
            placed = sums.withColumn("total", total).withColumn("before", before).select("*", F.posexplode(middles).alias("side", "rank"))
        else:
            known = chosen.withColumnRenamed("prefix", "upper")
            within = counts.withColumn("upper", F.shiftright("image", shift + bits)).join(known, [*keys, "upper"])
            sums = within.groupBy(*keys, "side", "rank", prefix).agg(F.sum("n").alias("n"), F.max("v").alias("v"))
            upward = Window.partitionBy(*keys, "side").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            placed = sums.withColumn("before", F.sum("n").over(upward) - F.col("n"))
        placed = placed.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        chosen = placed.select(*keys, "side", "prefix", (F.col("rank") - F.col("before")).alias("rank"), *(["v"] if shift == 0 else []))
    return chosen.groupBy(*keys).agg((F.sum("v") / 2).alias("median"))


def batch_summary(shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of the class percentages over images, zero where an image lacks the class.

    ``shares`` is wide: one row per image with pct0..pctN, so missing classes are plain nulls.
    """
    keys = list(keys)
    rows = [F.struct(F.lit(c).alias("class_id"), F.coalesce(F.col(f"pct{c}"), F.lit(0.0)).alias("pct")) for c in range(schema.CLASS_COUNT)]
    long = shares.select(*keys, F.inline(F.array(*rows)))
    group = [*keys, "class_id"]
    spread = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_images"), F.avg("pct").alias("avg"), F.stddev_pop("pct").alias("std"),
        F.min("pct").alias("min"), F.max("pct").alias("max"),
    )
    return spread.join(exact_median(long, group, "pct"), group).withColumn("class_name", schema.class_name_of(F.col("class_id")))


def truth_batch_summary(results: DataFrame, class_iou: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Batch against truth: counts by status and kind, spread of IoU, mean Dice and precision.

    ``results``: status, sample_type, mean_iou, mean_dice, precision; per-class means in
    ``class_iou`` columns are taken over positive values only.
    """
    ok = F.col("status") == "completed"
    multi, binary = ok & (F.col("sample_type") == "multiclass"), ok & (F.col("sample_type") == "binary")
    iou = F.when(ok, F.col("mean_iou"))
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(ok).alias("successful_samples"),
        F.count_if(F.col("status") == "error").alias("error_samples"),
        F.count_if(multi).alias("multiclass_samples"),
        F.count_if(binary).alias("binary_samples"),
        F.avg(iou).alias("avg_mean_iou"),
        F.stddev_pop(iou).alias("std_mean_iou"),
        F.min(iou).alias("min_mean_iou"),
        F.max(iou).alias("max_mean_iou"),
        F.avg(F.when(ok, F.col("mean_dice"))).alias("avg_mean_dice"),
        F.avg(F.when(binary, F.col("precision"))).alias("avg_precision"),
        *[F.avg(F.when(ok & (F.col(c) > 0), F.col(c))).alias(f"avg_{c}") for c in class_iou],
    )


def source_stats(patches: DataFrame) -> DataFrame:
    """Patches per source; the totals are a rollup row with a null source."""
    return patches.rollup("source").agg(
        F.count(F.lit(1)).alias("patches"), F.count_distinct("source_key").alias("sources")
    )


def dataset_totals(results: DataFrame) -> DataFrame:
    """Pixels, class pixels, their share and mean placements over a set of results.

    ``results``: total_pixels, n1..nN, placed.
    """
    defects = range(1, schema.CLASS_COUNT)
    sums = results.agg(
        F.count(F.lit(1)).alias("images"),
        F.sum("total_pixels").alias("pixels"),
        F.avg("placed").alias("avg_placed"),
        *[F.sum(f"n{c}").alias(f"n{c}") for c in defects],
    )
    return sums.select(
        "images", "pixels", "avg_placed", *[f"n{c}" for c in defects],
        *[(F.coalesce(F.try_divide(F.col(f"n{c}").cast("double"), F.col("pixels").cast("double")), F.lit(0.0)) * 100).alias(f"pct{c}") for c in defects],
    )


def image_confidence(crops: DataFrame) -> DataFrame:
    """Largest crop score per image, rounded to 3 places; unreadable crops are left out."""
    read = crops.where(F.coalesce("status", F.lit("ok")) == "ok")
    return read.groupBy("image_id").agg(F.round(F.max("confidence"), 3).alias("confidence"))


def detection_ratio(images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detected images and their percentage, rounded to 2 places."""
    return images.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("confidence") > threshold).alias("detected")
    ).withColumn("ratio", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("detected"), F.col("images").cast("double")), F.lit(0.0)), 2))


def equal_width_histogram(values: DataFrame, columns: Sequence[str], bins: int = 15) -> DataFrame:
    """Counts per series over equal bins between the common minimum and maximum, last bin closed.

    Series of a constant value fall into the first bin.
    """
    series = F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("v")) for c in columns]))
    long = values.select(series).where("v is not null")
    low, high = F.least(*[F.col(c) for c in columns]), F.greatest(*[F.col(c) for c in columns])
    # two scalar subqueries, each run once
    lo, hi = values.agg(F.min(low)).scalar(), values.agg(F.max(high)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    bin_of = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - lo, width)), F.lit(0))).cast("int")
    return long.groupBy("series", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def visible_shares(shares: DataFrame, min_percent: float = 0.01) -> DataFrame:
    """Class rows of a distribution that are large enough to show."""
    return shares.where(F.col("percentage") > min_percent)


def top_detections(detections: DataFrame, min_confidence: float = 0.636, k: int = 15) -> DataFrame:
    """At most ``k`` boxes per image by falling confidence; a partial top-k runs before the shuffle."""
    order = Window.partitionBy("image_id").orderBy(F.col("conf").desc(), F.col("det_id"))
    ranked = detections.where(F.col("conf") >= min_confidence).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def dataset_manifest(results: DataFrame, parameters: dict) -> DataFrame:
    """One JSON document per image: dataset facts, parameters, per-version metadata.

    Versions per image are a plan parameter, so a list is bounded.
    """
    params = F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()])
    meta = F.struct(*[c for c in results.columns if c != "image_id"])
    grouped = results.groupBy("image_id").agg(F.array_sort(F.collect_list(meta)).alias("versions"))
    info = F.struct(F.col("image_id"), F.size("versions").alias("n_versions"))
    return grouped.select("image_id", F.to_json(F.struct(info.alias("dataset_info"), params.alias("processing_parameters"), "versions")).alias("json"))


def detail_json(results: DataFrame, key: str = "image_id") -> DataFrame:
    """Each result row as a JSON document; types are plain already."""
    return results.select(key, F.to_json(F.struct("*")).alias("json"))
