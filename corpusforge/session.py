"""Session helpers shared by tests, the bench and the entry module."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusforge") -> SparkSession:
    """A local session with UTC time and adaptive execution, as tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that Arrow tasks can import it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        archive = f"{tempfile.mkdtemp(prefix='corpusforge-code-')}/corpusforge"
        context.addPyFile(shutil.make_archive(archive, "zip", Path(__file__).resolve().parents[1], "corpusforge"))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for materialised tables, as the session names it in ``spark.checkpoint.dir``.

    Only a local session may leave it unset and gets a temporary folder; on a cluster that would be a folder
    of one machine, so it is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusforge-checkpoint-"))
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the folder all executors share and cut its lineage.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files when nothing refers to them any more.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, in whatever store it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def swept(spark: SparkSession) -> None:
    """Have the driver collect its garbage, as shuffle files of plans that nothing refers to stay on disk until it does."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
