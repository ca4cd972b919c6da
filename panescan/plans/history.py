"""Training history and monitors over long metric tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panescan.session import cut_lineage


def best_epoch(epochs: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Smallest validation loss per run, the first on a tie."""
    return epochs.groupBy(*keys).agg(
        F.min_by("epoch", F.struct("value", "epoch")).alias("epoch"), F.min("value").alias("value")
    )


EPOCHS_PER_PIECE = 4096


def _running_minimum(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``pos`` (1-based) and ``before``: the minimum of all earlier epochs of the run.

    A run is worked on in pieces of some thousand epochs: piece minima run ahead, one row
    per piece, so a run that holds much of the table spreads over many tasks.
    """
    split = epochs.withColumn("piece", F.floor(F.col("epoch") / EPOCHS_PER_PIECE))
    pieces = split.groupBy(*keys, "piece").agg(F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = pieces.select(
        *keys, "piece", F.min("low").over(earlier).alias("low"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped")
    )
    order = Window.partitionBy(*keys, "piece").orderBy("epoch")
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    return split.join(ahead, [*keys, "piece"]).select(
        *epochs.columns,
        (F.col("skipped") + F.row_number().over(order)).cast("bigint").alias("pos"),
        F.least(F.col("low"), F.min("value").over(within)).alias("before"),
    )


def improvements(epochs: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Epochs whose loss is strictly below every earlier one: the moments a best model is kept."""
    marked = _running_minimum(epochs, list(keys))
    return marked.where(F.col("before").isNull() | (F.col("value") < F.col("before"))).drop("pos", "before")


def _successors(minima: DataFrame, patience: int, min_delta: float, keys: list[str]) -> DataFrame:
    """``minima`` (keys, piece, pos, value) with ``after``: the next accepted one if it is at most ``patience`` epochs away.

    The minima of a run fall, so the next accepted one is the largest below ``value - min_delta``. Pieces
    are no shorter than ``patience``: it lies in the minimum's own piece or in the one behind it, and each
    piece orders its own minima among the bounds that look for one there.
    """
    nodes = minima.select(*keys, "piece", F.col("value").alias("v"), F.lit(1).alias("kind"), "pos", F.lit(None).cast("bigint").alias("seeker"))
    bounds = minima.select(*keys, F.explode(F.array(F.col("piece"), F.col("piece") + 1)).alias("piece"), (F.col("value") - min_delta).alias("v"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("pos"), F.col("pos").alias("seeker"))
    below = Window.partitionBy(*keys, "piece").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = nodes.unionByName(bounds).withColumn("found", F.last("pos", ignorenulls=True).over(below)).where("kind = 0")
    near = met.groupBy(*keys, F.col("seeker").alias("pos")).agg(F.min("found").alias("after"))
    return minima.join(near, [*keys, "pos"]).withColumn("after", F.when(F.col("after") - F.col("pos") <= patience, F.col("after")))


def _exits(linked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, exit, final): where the links lead out of a minimum's piece, or the minimum that they end at."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        pos, after = own.pos.to_numpy(), own.after.fillna(-1).to_numpy().astype(np.int64)
        at, exit_, final = np.searchsorted(pos, after), after.copy(), np.zeros(len(pos), bool)
        for i in range(len(pos) - 1, -1, -1):
            if after[i] < 0:
                exit_[i], final[i] = pos[i], True
            elif after[i] <= pos[-1]:
                exit_[i], final[i] = exit_[at[i]], final[at[i]]
        return own.drop(columns=["piece", "value", "after"]).assign(exit=exit_, final=final)

    shape = ", ".join(f"`{k}` {linked.schema[k].dataType.simpleString()}" for k in keys)
    return linked.groupBy(*keys, "piece").applyInPandas(run, f"{shape}, pos long, exit long, final boolean").select(*keys, "pos", "exit", "final")


def early_stop_epoch(epochs: DataFrame, patience: int, min_delta: float = 0.0, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """First epoch at which ``patience`` epochs in a row failed to improve; runs that never stop give no row.

    Only a strict new minimum can be an accepted improvement, so a run shrinks to its minima. Each links
    to the next one that would be accepted after it within ``patience`` epochs; where there is none the run
    stops. Links are followed within pieces of the run, one task each, and from piece to piece by pointer
    doubling, so a run of any length takes logarithmically many joins and no run is gathered anywhere.
    """
    keys, size = list(keys), max(EPOCHS_PER_PIECE, patience)
    seen = _running_minimum(epochs, keys)
    better = F.col("before").isNull() | (F.col("value") < F.col("before"))
    minima = cut_lineage(seen.where(better).select(*keys, F.floor(F.col("pos") / size).alias("piece"), "pos", "value"))
    exits = cut_lineage(_exits(_successors(minima, patience, min_delta, keys), keys))
    first = minima.groupBy(*keys).agg(F.min("pos").alias("pos"))
    # what the links of another piece, or a run's beginning, point at
    met = exits.where("not final").select(*keys, F.col("exit").alias("pos")).unionByName(first).distinct()
    links = exits.join(met, [*keys, "pos"], "left_semi")
    while not links.join(first, [*keys, "pos"], "left_semi").where("not final").isEmpty():
        on = links.select(*keys, F.col("pos").alias("exit"), F.col("exit").alias("beyond"), F.col("final").alias("ends"))
        links = cut_lineage(links.join(on, [*keys, "exit"], "left").select(*keys, "pos", F.when(F.col("final"), F.col("exit")).otherwise(F.col("beyond")).alias("exit"), (F.col("final") | F.col("ends")).alias("final")))
    stops = links.join(first, [*keys, "pos"]).select(*keys, (F.col("exit") + patience).alias("pos"))
    return seen.join(stops, [*keys, "pos"]).select(*keys, F.col("epoch").alias("stop_epoch"))


def checkpoints_to_drop(checkpoints: DataFrame, keep: int = 3, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Checkpoints older than the last ``keep`` epochs of their run; ``keep`` <= 0 keeps all.

    The kept ones are a top-k, cut down before the shuffle; the rest lies below the oldest kept.
    """
    if keep <= 0:
        return checkpoints.where(F.lit(False))
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(F.col("epoch").desc())
    kept = checkpoints.select(*keys, "epoch").withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)
    oldest = kept.groupBy(*keys).agg(F.min("epoch").alias("oldest"))
    return checkpoints.join(oldest, keys).where(F.col("epoch") < F.col("oldest")).drop("oldest")


def final_metrics(epochs: DataFrame, keys: Sequence[str] = ("run_id", "split")) -> DataFrame:
    """Last value per metric and the mean without the first epoch."""
    return epochs.groupBy(*keys).agg(
        F.max_by("value", "epoch").alias("final_value"),
        F.avg(F.when(F.col("epoch") > 0, F.col("value"))).alias("mean_after_first"),
    )


def memory_growth(samples: DataFrame, threshold_mb: float, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Growth over the first sample, alarm flag and running peak per sample.

    ``order[0]`` is a timestamp.  Hours of a run are worked on apart, with hourly peaks run
    ahead, so a run that holds much of the table spreads over many tasks.
    """
    keys = list(keys)
    split = samples.withColumn("hour", F.date_trunc("hour", order[0]))
    hours = split.groupBy(*keys, "hour").agg(F.max("mb").alias("peak"), F.min_by("mb", F.struct(*order)).alias("first"))
    in_time = Window.partitionBy(*keys).orderBy("hour")
    ahead = hours.select(
        *keys, "hour",
        F.max("peak").over(in_time.rowsBetween(Window.unboundedPreceding, -1)).alias("peak_before"),
        F.first("first").over(in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first_mb"),
    )
    within = Window.partitionBy(*keys, "hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    increase = F.col("mb") - F.col("first_mb")
    return split.join(ahead, [*keys, "hour"]).select(
        *samples.columns, increase.alias("increase"), F.greatest(F.col("peak_before"), F.max("mb").over(within)).alias("peak"),
        (increase > threshold_mb).alias("alarm"),
    )


def top_consumers(samples: DataFrame, k: int = 5, keys: Sequence[str] = ("run_id",), tie: str = "ts") -> DataFrame:
    """The ``k`` largest samples per run."""
    order = Window.partitionBy(*keys).orderBy(F.col("mb").desc(), F.col(tie))
    return samples.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def epoch_metrics(batches: DataFrame, keys: Sequence[str] = ("run_id", "epoch")) -> DataFrame:
    """Plain mean of per-batch metrics over successful batches; loss over all batches of the loader."""
    ok = F.col("status") == "ok"
    return batches.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(ok, F.col("metric"))), F.lit(0.0)).alias("metric"),
        (F.coalesce(F.sum(F.when(ok, F.col("loss"))), F.lit(0.0)) / F.count(F.lit(1))).alias("loss"),
        F.count_if(ok).alias("num_batches"),
    )
