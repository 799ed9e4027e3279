"""What a session needs before Arrow passes run."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 800


def prepare(spark: SparkSession) -> None:
    """Workers find the package where they share this machine's folders, use one core, and get smaller batches.

    Spark bounds a batch to 10,000 rows and 64 MB; texts need fewer rows at a time, so unless
    that number has been set, it becomes BATCH_ROWS.
    """
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("OMP_NUM_THREADS", "1")
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, as in tests, gets a folder of its own where none is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="loomspan-shared-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_base(spark)}/loomspan-{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended already
            pass

    atexit.register(drop)
    return path


def save(spark: SparkSession, df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends there."""
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
