"""Session helpers: a local session for tests and benches, and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, memory: str = "8g") -> SparkSession:
    """A local[cpus] session as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("objectlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per Spark application.

    Executors started from another folder could not import it otherwise.
    """
    sc = spark.sparkContext
    if getattr(sc, "_objectlake_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="objectlake-")) / "objectlake_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._objectlake_shipped = True
    return spark


#: Bytes of rows that are handed to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand texts to Python workers a few megabytes at once, unless the session asks for less.

    The JVM and the worker each hold a whole batch, the worker also as strings; 10,000 whole texts
    are some 40 MB, and longer ones more. What is computed does not depend on it.
    """
    if not 0 < int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))) <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-objectlake-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Lets Spark remove an action's shuffle files when the action ends, and not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind. Only for actions whose result is written out and never recomputed."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts lineage, survives lost executors, and lets several later jobs read one result. ``discard``
    removes the files once no later job needs them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/objectlake/{name}-{uuid.uuid4().hex}"
    with swept_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialised tables; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            hadoop = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
