"""Session helpers: a local builder for tests and benches, and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "panescan") -> SparkSession:
    """Session for tests and ``bench.py``; a cluster job brings its own session."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANESCAN_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared checkpoint folder: the one the session names, else (local runs only) a new one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panescan-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so the result outlives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


CELLS_PER_TASK = 1 << 19


def spread(rows: DataFrame, key: str | Sequence[str], cells: int) -> DataFrame:
    """Deal ``rows`` by ``key`` over so many tasks that each works out at most about CELLS_PER_TASK cells.

    For short rows that grow: ``cells`` is what one of them is worth.  A file of millions of such rows is one
    task to the reader, however much they become.  The number is fixed by the rows, so it grows with them and
    adaptive execution, which sees the short rows only, does not merge the tasks again.
    """
    return deal(rows, tasks_for(rows.sparkSession, rows.count() * cells), *([key] if isinstance(key, str) else key))


def tasks_for(spark: SparkSession, cells: int) -> int:
    """Tasks of at most about CELLS_PER_TASK ``cells`` each: 1 if one will do, else as many as cores at least."""
    tasks = -(-cells // CELLS_PER_TASK)
    return max(tasks, spark.sparkContext.defaultParallelism) if tasks > 1 else 1


def deal(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over ``tasks`` tasks; with a single one they stay as they are, for adaptive execution."""
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    if getattr(spark.sparkContext, "_panescan_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="panescan-package-")) / "panescan.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._panescan_shipped = True
