"""Class-mask operators.  Masks are runs; absent means background."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panescan import schema
from panescan.operators.raster import coalesce_runs, run_events, sweep


# ------------------------------------------------------------------ normalisation rules
def mask_facts(layer: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Per-mask facts the rules need: number of levels, extremes and membership flags.

    Works on any form with a ``value`` column; at most 256 levels per mask, so the
    distinct set stays small and is built by map-side partial aggregation.
    """
    return layer.groupBy(*keys).agg(
        F.size(F.collect_set("value")).alias("n_levels"),
        F.max("value").alias("hi"),
        F.coalesce(F.max(F.when(F.col("value") < 255, F.col("value"))), F.lit(0)).alias("hi_below_255"),
        F.min(F.col("value").isin(0, 255)).alias("only_0_255"),
        F.max(F.col("value") == 255).alias("has_255"),
    )


def rule_dataset(v: Column, num_classes: int) -> Column:
    """Training-set rule; null when the mask stays invalid after conversion."""
    fixed = (
        F.when((F.col("n_levels") <= 2) & F.col("only_0_255"), (v > 0).cast("int"))
        .when(F.col("hi") <= 3, v.cast("int"))
        .when(F.col("hi") == 255, F.when(v == 255, F.lit(1)).otherwise(F.least(v, F.lit(2))).cast("int"))
        .otherwise(F.least(v, F.lit(2)).cast("int"))
    )
    top = (
        F.when((F.col("n_levels") <= 2) & F.col("only_0_255"), (F.col("hi") > 0).cast("int"))
        .when(F.col("hi") <= 3, F.col("hi"))
        .when(F.col("hi") == 255, F.greatest(F.lit(1), F.least(F.col("hi_below_255"), F.lit(2))))
        .otherwise(F.lit(2))
    )
    return F.when(top < num_classes, fixed)


def rule_truth(v: Column, multiclass_file: bool, multiclass_wanted: bool) -> Column:
    """Ground-truth loader rule, by kind of file and kind of result."""
    if multiclass_file and multiclass_wanted:
        return F.least(v, F.lit(4)).cast("int")
    if multiclass_file:
        return (v > 0).cast("int")
    standard = (F.col("n_levels") == 2) & F.col("has_255")
    return F.when(standard, (v > 127).cast("int")).otherwise((v > 0).cast("int"))


def rule_generic(v: Column) -> Column:
    standard = (F.col("n_levels") == 2) & F.col("has_255")
    return F.when(standard, (v > 127).cast("int")).otherwise(F.least(v, F.lit(2)).cast("int"))


def rule_full_photo(v: Column, multiclass_file: bool) -> Column:
    """Whole-photo rule: clip to 3, or binary foreground becomes class 2."""
    if multiclass_file:
        return F.least(v, F.lit(3)).cast("int")
    lit = F.when(F.col("hi") > 1, v > 127).otherwise(v == 1)
    return F.when(lit, F.lit(2)).otherwise(F.lit(0))


def normalize_mask(layer: DataFrame, variant: str, keys: Sequence[str] = ("image_id",), num_classes: int = 4) -> DataFrame:
    """Apply one named rule; adds ``class_id`` and keeps the raw ``value``.

    The rule depends on facts of the whole mask.  They are one row per mask and join
    back on the key; AQE splits a skewed mask because the other side is a single row.
    """
    v = F.col("value")
    rules = {
        "dataset": rule_dataset(v, num_classes),
        "truth_multi": rule_truth(v, True, True),
        "truth_multi_to_binary": rule_truth(v, True, False),
        "truth_binary": rule_truth(v, False, False),
        "generic": rule_generic(v),
        "full_multi": rule_full_photo(v, True),
        "full_binary": rule_full_photo(v, False),
    }
    if variant not in rules:
        raise ValueError(f"unknown mask rule {variant!r}; one of {sorted(rules)}")
    facts = mask_facts(layer, keys)
    return layer.join(facts, list(keys)).withColumn("class_id", rules[variant]).drop(*[c for c in facts.columns if c not in keys])


# ------------------------------------------------------------------------- set algebra
def _class_counts(runs: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [f"n{c}" for c in range(1, schema.CLASS_COUNT)]
    events = run_events(
        runs.where("class_id > 0"),
        ("image_id", "y"),
        **{f"n{c}": (F.col("class_id") == c).cast("bigint") for c in range(1, schema.CLASS_COUNT)},
    )
    return sweep(events, ("image_id", "y"), names), names


# --- fixed values: class order of the two merge rules, strongest first -----------------
MERGE_ORDER = {"highest": [3, 2, 1], "scratch_first": [1, 2, 3]}


def merge_masks(runs: DataFrame, rule: str = "highest") -> DataFrame:
    """One class per pixel out of overlapping layers.

    ``highest``: the larger class index wins.  ``scratch_first``: the old three-class
    numbering, in which class 1 beats class 2; class 3, unknown to it, is the weakest.
    """
    segments, _ = _class_counts(runs)
    winner = F.coalesce(*[F.when(F.col(f"n{c}") > 0, F.lit(c)) for c in MERGE_ORDER[rule]])
    merged = segments.select("image_id", "y", "x0", "x1", winner.alias("class_id")).where("class_id is not null")
    return coalesce_runs(merged, ("image_id",))


def binary_union(runs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pixels covered by any defect class, as class 1."""
    row = [*keys, "y"]
    events = run_events(runs.where("class_id > 0"), row, n=F.lit(1).cast("bigint"))
    union = sweep(events, row, ["n"]).where("n > 0").select(*row, "x0", "x1", F.lit(1).alias("class_id"))
    return coalesce_runs(union, keys)


def split_by_class(runs: DataFrame) -> DataFrame:
    """One binary layer per defect class; empty ones do not appear."""
    return runs.where("class_id > 0").withColumn("layer", F.concat(F.lit("class_"), F.col("class_id")))


def intersect_runs(runs: DataFrame, other: DataFrame) -> DataFrame:
    """Part of ``runs`` inside ``other``; class kept."""
    return _against(runs, other, inside=True)


def except_runs(runs: DataFrame, other: DataFrame) -> DataFrame:
    """Part of ``runs`` outside ``other``; class kept."""
    return _against(runs, other, inside=False)


def _against(runs: DataFrame, other: DataFrame, inside: bool) -> DataFrame:
    """Classes are counted apart, so runs of several layers may overlap; a class comes out once per pixel."""
    row, classes = ("image_id", "y"), range(1, schema.CLASS_COUNT)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    names = [f"n{c}" for c in classes]
    own = {f"n{c}": (F.col("class_id") == c).cast("bigint") for c in classes}
    events = run_events(runs.where("class_id > 0"), row, **own, o=zero).unionByName(
        run_events(other, row, **dict.fromkeys(names, zero), o=one)
    )
    hit = F.col("o") > 0 if inside else F.col("o") == 0
    found = F.filter(F.array(*[F.when(F.col(f"n{c}") > 0, F.lit(c)) for c in classes]), lambda c: c.isNotNull())
    parts = sweep(events, row, [*names, "o"]).where(hit).select(*row, "x0", "x1", F.explode(found).alias("class_id"))
    apart = parts.withColumn("own", F.col("class_id"))  # runs of different classes may overlap
    return coalesce_runs(apart, ("image_id", "own")).drop("own")


# --------------------------------------------------------------------- colour operators
def palette_to_class(colours: DataFrame, device: DataFrame | None = None) -> DataFrame:
    """Annotation colours to classes, 0 for other colours or outside the device mask.

    ``colours`` has image_id, y, x, r, g, b; ``device`` has image_id, y, x of the mask.
    """
    spark = colours.sparkSession
    known = colours.join(F.broadcast(schema.palette_dim(spark)), ["r", "g", "b"], "left")
    if device is None:
        inside = known.withColumn("inside", F.lit(True))
    else:
        # no distinct: a flag joined from a key-unique mask table
        inside = known.join(device.select("image_id", "y", "x", F.lit(True).alias("inside")), ["image_id", "y", "x"], "left")
    return inside.select(
        "image_id", "y", "x", F.when(F.col("inside"), F.coalesce("class_id", F.lit(0))).otherwise(F.lit(0)).alias("class_id")
    )


# --- fixed values: drawing colours of predicted classes (r, g, b) ----------------------
CLASS_COLOURS = [(0, 0, 0), (0, 255, 0), (255, 0, 0), (0, 0, 255)]
# --- fixed values: drawing colours of annotation categories 1..10, 0 is black ----------
CATEGORY_COLOURS = [
    (0, 0, 0),
    (255, 255, 0),
    (255, 0, 0),
    (0, 255, 0),
    (0, 0, 255),
    (255, 0, 255),
    (0, 255, 255),
    (255, 165, 0),
    (128, 0, 128),
    (255, 192, 203),
    (165, 42, 42),
]


def colorize(layer: DataFrame, colours=CLASS_COLOURS, key: str = "class_id") -> DataFrame:
    """Adds r, g, b.  Listed ids have fixed colours, further ids one drawn from their md5."""
    c = F.col(key)
    digest = F.md5(F.concat(F.lit("class_"), c.cast("string")))
    channels = []
    for i, name in enumerate("rgb"):
        fixed = F.array(*[F.lit(colour[i]) for colour in colours])
        drawn = F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
        channels.append(F.coalesce(F.try_element_at(fixed, (c + 1).cast("int")), drawn).alias(name))
    return layer.select("*", *channels)


# --- fixed values: (base weight, colour weight) of the overlay kinds --------------------
OVERLAY_WEIGHTS = {"inference": (0.3, 0.7), "generator": (0.6, 0.4), "history": (0.5, 0.5)}


def overlay_colour(base: Column, colour: Column, covered: Column, kind: str = "inference") -> Column:
    """One channel: weighted sum, cut to whole levels, where covered; ``max`` keeps the larger."""
    if kind == "max":
        return F.when(covered, F.greatest(base, colour)).otherwise(base).cast("int")
    on_base, on_colour = OVERLAY_WEIGHTS[kind]
    return F.when(covered, F.floor(base * on_base + colour * on_colour)).otherwise(base).cast("int")


def error_code(pred: Column, truth: Column) -> Column:
    """TP, FP, FN, TN, or MIX when both are defects of different classes."""
    return (
        F.when((pred == truth) & (pred > 0), "TP")
        .when(pred == truth, "TN")
        .when(truth == 0, "FP")
        .when(pred == 0, "FN")
        .otherwise("MIX")
    )


# -------------------------------------------------------------------------------- audit
def mask_audit(layer: DataFrame, expected: Sequence[int], keys: Sequence[str] = ("image_id", "layer"), size: tuple[int | Column, int | Column] | None = None) -> DataFrame:
    """Unexpected values, background-only flag, pixel count and shape check per mask.

    ``size`` is one height and width for all masks, or columns of ``layer`` that hold each mask's own.
    """
    wanted = F.lit(None) if size is None else F.max(F.lit(1) * size[0] * size[1])
    agg = layer.groupBy(*keys).agg(
        F.collect_set("value").alias("found"),
        F.count(F.lit(1)).alias("n_pixels"),
        F.bool_and(F.col("value") == 0).alias("background_only"),
        wanted.alias("wanted"),
    )
    odd = F.array_sort(F.array_except("found", F.array(*[F.lit(v) for v in expected])))
    good_shape = F.lit(True) if size is None else F.coalesce(F.col("n_pixels") == F.col("wanted"), F.lit(False))
    return agg.select(
        *keys,
        "n_pixels",
        "background_only",
        F.concat_ws(",", F.slice(odd, 1, 5)).alias("unexpected"),
        F.size(odd).cast("bigint").alias("n_unexpected"),
        good_shape.alias("shape_ok"),
        ((F.size(odd) == 0) & good_shape).alias("ok"),
    )
