"""Session construction and the few session settings the library relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch between the JVM and Python.
ARROW_ROWS = 2_000


def local_session(app: str = "tessera", cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass your own session instead."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where none is configured and all runs on one machine."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and sc.master.split("[")[0] != "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        at = at or os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        sc.setCheckpointDir(at)
    return at


def make_importable(spark: SparkSession, give_back: bool = False) -> SparkSession:
    """The session, with this package's folder on its Python workers' path; where a cluster installs it, that changes nothing.

    What a worker holds is kept small, too: batches have ARROW_ROWS rows unless the session says otherwise, as
    10,000 long texts are a lot for one batch. With give_back, workers that start later return freed arrays of
    a megabyte and more to the system at once, so that what one stage needed is not held through the next;
    that takes time, and is for programs of several stages.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    if give_back:
        for knob in ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_"):
            env.setdefault(knob, str(1 << 20))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def spread(df: DataFrame, small: int = 8 << 20) -> DataFrame:
    """df over all cores, if it is a scan of less than `small` bytes a core in few splits.

    A small file is often one row group, which one task reads whatever the splits. A table with work for all
    cores stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = size < small * cores and df.rdd.getNumPartitions() <= cores
    return df.repartition(cores) if few else df


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared checkpoint folder and read again; the files go when the program ends.

    For wide tables this takes much less room than a checkpoint, whose rows are not encoded.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before; the folder's owner clears it then
        pass
