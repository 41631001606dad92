"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that a task hands to Python; results don't depend on it.
ARROW_BYTES = 8 << 20

_LOCAL_ROOTS: dict[str, str] = {}


def pin(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: UTC dates, and AQE for skew and small sides."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cpus: str = "8", shuffle_partitions: int = 8, app: str = "lakepulse") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def small_batches(spark: SparkSession) -> None:
    """From now on a batch of rows for Python holds about ``ARROW_BYTES``, if the session has no limit of its own.

    A task holds a batch in Spark and in Python at the same time; Spark's default is 10,000 rows or 64 MB.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, ARROW_BYTES)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, and safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one written table, in the shared folder the cluster names.

    The folder is ``spark.checkpoint.dir``. Only a local session, where every task runs on this
    machine, may fall back to a temporary folder, which goes with the process. All paths of an application lie in
    one folder, which ``clear_scratch`` deletes.
    """
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _LOCAL_ROOTS.get(context.applicationId)
        if shared is None or not os.path.isdir(shared):
            shared = _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="lakepulse-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/lakepulse/{context.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what ``scratch`` gave this application; call it when no result that was made from it is read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
