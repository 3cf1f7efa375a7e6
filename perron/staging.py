"""Written intermediate tables in the shared checkpoint folder.

A staged table cuts the lineage, fixes values that depend on the physical layout (partition
numbers, row numbers) and survives the loss of any executor, because its files live in the folder
that the cluster names in ``spark.checkpoint.dir``. Only where that setting is absent in local mode
(tests, interactive use) a folder under the system's temporary directory is chosen, and written
back to the session; on a cluster its absence is an error.

All tables of an application lie in one folder of its own. ``discard`` removes tables that no plan
reads any more, ``clear`` the whole folder once the results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


class NoSharedFolder(Exception):
    """A cluster names no folder that its executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables and checkpoints."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise NoSharedFolder(f"{SETTING} is not set, and executors of {master} do not see the driver's folders")
        found = f"file://{tempfile.mkdtemp(prefix='perron-shared-')}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{shared_dir(spark)}/perron-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._perron_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through Spark's file systems; one that isn't there is fine."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*staged: DataFrame) -> None:
    """Remove the files of staged tables; frames made from them can't be computed afterwards."""
    for df in staged:
        if path := getattr(df, "_perron_path", None):
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all of this application's staged tables; call it when all results are written."""
    delete(spark, run_dir(spark))
