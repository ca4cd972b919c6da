"""Shared helpers of the training-data operators: tables, scratch data and small lookups."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panescan.session import checkpoint_folder, cut_lineage

__all__ = ["Remembered", "cut_lineage", "forget", "keep", "lookup", "partitions", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it again.

    Cuts lineage like a reliable checkpoint, but compressed, and forgets the partitioning, so that a
    later join deals the rows anew and adaptive execution may split a hot key. The folder goes when
    the application ends.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    kept = spark.read.schema(df.schema).parquet(folder)
    kept._kept_folder = folder
    return kept


def forget(kept: DataFrame) -> None:
    """Delete a table that ``keep`` wrote and nothing will read again."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Remembered(dict):
    """What ``make`` gives by key, remembered in two generations.

    When the newer one holds ``limit`` bytes it becomes the older one, whose former content goes. What the
    older one still holds is not made again. Memory is twice the limit whatever passes through.
    """

    ENTRY = 160  # of a key and a value: two headers and the place in the table

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.older = make, limit, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if self.held > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += self.ENTRY + len(key) + len(value)
        return value


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: int, size: int) -> int:
    """Number of blocks of at most ``size`` rows on average, one at least."""
    return max(1, math.ceil(rows / size))


def lookup(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small driver-made table (bounded by partitions, never by rows) as a JVM-side relation."""
    text = json.dumps(rows)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl}>>")))
