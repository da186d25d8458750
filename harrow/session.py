"""Session helpers shared by every operator: defaults, code shipping and durable lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
BATCH_BYTES = 4 << 20  # of an Arrow batch, unless the session names a limit: a batch of long texts stays small


def local_session(cpus: int | str = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("harrow")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HARROW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so Arrow functions can import it there; bound their batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_harrow_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="harrow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"harrow-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"harrow/{f.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    sc._harrow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or else the directory given to ``setCheckpointDir``.

    Without either, a session whose executors are threads of the driver gets a folder of its own (tests); on a cluster
    that is an error, as a folder of the driver's machine is not the executors'.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_harrow_shared", None)
    if not named:
        given = sc._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="harrow-shared-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
        sc._harrow_shared = named
    return named.rstrip("/")


def passing(spark: SparkSession, path: str) -> str:
    """``path``, which the driver's file system removes when the application ends."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` materialised by ``checkpoint()`` in the shared folder: a lost executor costs a task, not the lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (columnar, compressed; pruned when read again), there until the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(passing(spark, path))
    out.written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the table behind a result of ``written``; nothing made from it may be asked for any more."""
    removed(df.sparkSession, df.written_at)


ROWS = 2_500  # that a task of readers in Python is given


def spread(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """``df`` dealt out by ``keys``, ``rows`` to a task: small rows that become pages are few splits of a file, whatever their number."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
