"""Session defaults and reliable lineage truncation."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Folders written by cut_lineage and not yet dropped.
_FOLDERS: dict[str, SparkSession] = {}


def local_session(app: str = "flatcel", cores: str | int | None = None) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own settings."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: a zip of it is
    handed to the session's own file distribution, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_flatcel_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "flatcel.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._flatcel_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` always wins. A private one is
    made only in local mode, where driver and executors share a disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Lost executors then cost a re-read of a file, loop plans stay small, and the
    next step plans with real sizes. (``DataFrame.checkpoint`` keeps the derived
    constraints of the old plan, which grow exponentially in join loops.)
    The folder goes when ``drop_written`` is called or the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    written._cut_folder = folder
    _FOLDERS.setdefault(folder, spark)
    return written


def new_folder(spark: SparkSession) -> str:
    """Name of a new folder beside the checkpoints, deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(folder, spark)
    return folder


def drop_written(*frames: DataFrame | None) -> None:
    """Delete the folders behind frames that ``cut_lineage`` returned."""
    for df in frames:
        folder = getattr(df, "_cut_folder", None) if df is not None else None
        if folder is not None and _FOLDERS.pop(folder, None) is not None:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_all() -> None:
    for folder, spark in list(_FOLDERS.items()):
        try:
            _delete(spark, folder)
        except Exception:  # the session has ended before
            return
