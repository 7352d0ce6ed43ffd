"""Session helpers: builder for local runs and the folder shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spanloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as ``spark.checkpoint.dir`` names it.

    Only where the session does not name one (single-machine tests), a temporary folder is made and remembered in the
    session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{shared_dir(spark)}/spanloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete everything the application has stored in the shared folder, once no result that reads it is needed any more."""
    remove(spark, application_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a table that outlives the loss of any executor; columns are pruned on reading, as a
    ``checkpoint()`` could not.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Splits of a table that is spread at most: what is shuffled for it is bounded, whatever the number of cores.
MOST_SPREAD = 256


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, if it has few.

    For steps that cost much CPU per row: a table of few splits would leave cores idle. A table of more than ``MOST_SPREAD``
    splits passes unchanged, so what is shuffled here is at most that many splits. Results are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, MOST_SPREAD + 1) else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
