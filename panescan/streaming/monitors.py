"""Arriving photos, running batch summaries and per-run monitors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPEN_COST = "spark.sql.files.openCostInBytes"
COMPACTION = "spark.sql.streaming.fileSource.log.compactInterval"
CLEANUP = ("spark.sql.streaming.fileSource.log.cleanupDelay", "spark.sql.streaming.fileSink.log.cleanupDelay")
MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
LOCAL_MANAGER = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def stream_images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,bmp,tiff,tif}", max_files: int = 16, clean: str | None = None, archive: str | None = None) -> DataFrame:
    """Photos as they arrive, one binary row each; processed files can be archived or deleted."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
    )
    if clean is not None:
        reader = reader.option("cleanSource", clean)
        if archive is not None:
            reader = reader.option("sourceArchiveDir", archive)
    return reader.load(path).withColumn("image_id", F.xxhash64("path"))


def running_summary(results: DataFrame, value: str, keys: Sequence[str] = (), window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Count and spread per tumbling or sliding window; rows later than ``late`` are dropped.

    Works on a stream and on a batch, where nothing is late.
    """
    span = F.window(time, window, slide) if slide else F.window(time, window)
    v = F.col(value)
    return (
        results.withWatermark(time, late)
        .groupBy(span, *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("avg"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "avg", "std", "min", "max")
    )


class MemoryGrowth(StatefulProcessor):
    """First sample per run as state; one row per run and micro-batch with growth and alarm."""

    def __init__(self, threshold_mb: float, ttl_ms: int | None = None):
        self.threshold, self.ttl = threshold_mb, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "ts timestamp, tie long, mb double", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = last = None
        peak, n = float("-inf"), 0
        for frame in rows:  # chunks of the group, never the whole group
            frame = frame.sort_values(["ts", "tie"])
            head, tail = frame.iloc[0], frame.iloc[-1]
            if first is None or (head.ts, head.tie) < first[:2]:
                first = (head.ts, head.tie, head.mb)
            if last is None or (tail.ts, tail.tie) > last[:2]:
                last = (tail.ts, tail.tie, tail.mb)
            peak, n = max(peak, float(frame.mb.max())), n + len(frame)
        if self.first.exists():
            base = float(self.first.get()[2])
        else:
            base = float(first[2])
            self.first.update((first[0].to_pydatetime(), int(first[1]), base))
        yield pd.DataFrame(
            {
                "run_id": [key[0]], "samples": [n], "first_mb": [base], "last_mb": [float(last[2])], "peak_mb": [peak],
                "increase": [float(last[2]) - base], "alarm": [peak - base > self.threshold],
            }
        )

    def close(self) -> None:
        pass


class EarlyStop(StatefulProcessor):
    """Best loss and epochs since as state; one row when a run reaches its patience.

    A micro-batch's epochs arrive in any order. If they come in more than one chunk, the chunks are laid
    into pieces of the run that the state store holds, and folded piece by piece: memory is one chunk and
    one piece, whatever a run brings at once.
    """

    PIECE, ROW = 4096, np.dtype([("epoch", "<i8"), ("value", "<f8")])

    def __init__(self, patience: int, min_delta: float = 0.0):
        self.patience, self.min_delta = patience, min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "best double, counter long, stopped boolean")
        self.pieces = handle.getMapState("pieces", "piece long", "data binary")

    def lay(self, rows: np.ndarray, held: set[int]) -> None:
        piece = rows["epoch"] // self.PIECE
        for p in np.unique(piece).tolist():
            former = bytes(self.pieces.getValue((p,))[0]) if p in held else b""
            self.pieces.updateValue((p,), (former + rows[piece == p].tobytes(),))
            held.add(p)

    def in_order(self, frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """Rows by epoch, piece by piece; what was laid down is taken up again to the last."""
        packed = (np.rec.fromarrays([f.epoch.to_numpy(np.int64), f.value.to_numpy(float)], dtype=self.ROW) for f in frames)
        chunk, held = next(packed), set()
        for more in packed:
            self.lay(chunk, held)
            chunk = more
        if not held:
            yield np.sort(chunk, order="epoch", kind="stable")
            return
        self.lay(chunk, held)
        for p in sorted(held):
            data = bytes(self.pieces.getValue((p,))[0])
            self.pieces.removeKey((p,))
            yield np.sort(np.frombuffer(data, self.ROW), order="epoch", kind="stable")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, counter, stopped = self.state.get() if self.state.exists() else (None, 0, False)
        stop_epoch = None
        for piece in self.in_order(rows):
            for epoch, value in piece.tolist():
                if stopped:
                    break
                if best is None or value < best - self.min_delta:
                    best, counter = value, 0
                else:
                    counter += 1
                if counter >= self.patience:
                    stopped, stop_epoch = True, epoch
        self.state.update((best, counter, stopped))
        if stop_epoch is not None:
            yield pd.DataFrame({"run_id": [key[0]], "stop_epoch": [stop_epoch]})

    def close(self) -> None:
        pass


def memory_alarms(samples: DataFrame, threshold_mb: float, ttl_ms: int | None = None) -> DataFrame:
    """``samples`` stream: run_id, ts, tie, mb."""
    return samples.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=MemoryGrowth(threshold_mb, ttl_ms),
        outputStructType="run_id long, samples long, first_mb double, last_mb double, peak_mb double, increase double, alarm boolean",
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def early_stops(epochs: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """``epochs`` stream: run_id, epoch, value."""
    return epochs.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=EarlyStop(patience, min_delta),
        outputStructType="run_id long, stop_epoch long",
        outputMode="Append",
        timeMode="None",
    )


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """``key`` as ``value`` for queries started inside; the former setting comes back."""
    former = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, former)


def rocksdb_state(spark: SparkSession):
    """RocksDB state store for queries started inside; the former setting comes back."""
    return setting(spark, PROVIDER, ROCKSDB)


def batch_settings(spark: SparkSession, folder: str) -> dict[str, str]:
    """Settings under which a micro-batch of files costs little more than its files.

    Files are listed once more, by default in a task per file, each of which reports to the driver, and read by
    thirty a task; here both take as many tasks as there are cores, larger files more for their bytes. The log of
    files seen, which is part of the checkpoint, is written anew every 100 batches, not every 10, as that grows
    with all files so far; a query that takes up the checkpoint needs the same interval. That of files written
    keeps its interval, as whoever reads the table has to know it. What a compaction has taken up goes a minute
    later, not ten, as each batch lists the folders of both logs. In a local folder the logs are put in place by
    plain renames, which replace at once there; the default starts processes to look for links.
    """
    found = {LISTING: str(spark.sparkContext.defaultParallelism), OPEN_COST: str(1 << 20), COMPACTION: "100"}
    found |= dict.fromkeys(CLEANUP, "1m")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if place.getUri().getScheme() == "file" and spark.conf.get(MANAGER, None) is None:
        found[MANAGER] = LOCAL_MANAGER
    return found


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything that has arrived, into Parquet, and return the table."""
    spark = stream.sparkSession
    with ExitStack() as held:
        held.enter_context(rocksdb_state(spark))
        for key, value in batch_settings(spark, folder).items():
            held.enter_context(setting(spark, key, value))
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
