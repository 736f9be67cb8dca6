"""Tables on shared storage: reading inputs, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that `bounded_broadcast` ships to every executor; callers pass narrow rows (under 200 bytes).
MAX_BROADCAST_ROWS = 200_000
#: Spark's setting to delete a query's shuffle files when it ends; what `staged` has written needs them no more.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def provide_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster, it is installed or shipped as usual."""
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data folder `sf_dir`."""
    provide_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, `spark.checkpoint.dir`; it is deleted when the application ends.

    Where the setting is missing, a session on one machine gets a temporary folder, and one on a cluster an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/pagewright-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


def staged(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """`df`, written to the shared folder and read back: later plans start there, so a lost executor costs one task's work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from `staged` that no later step reads; other tables' files are left alone."""
    own = shared_folder(df.sparkSession)
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        if f"/{own.rpartition('/')[2]}/" in folder:
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, sized_by: DataFrame | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows, else `df` itself, for a shuffled join.

    Pass a table that is cheap to count, such as one from `staged`, whose files hold their numbers of rows. sized_by: the table
    whose rows tell the size, where rows of `df` are lists of them.
    """
    return F.broadcast(df) if (df if sized_by is None else sized_by).count() <= max_rows else df
