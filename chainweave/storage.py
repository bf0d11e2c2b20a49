"""Tables between the steps of a job: written into a folder that all machines share, and read again.

A written table ends the lineage, so a lost executor costs the tasks of one step
at most. A ``Scratch`` belongs to one job; what the job's result does not read is
removed when the job has written it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_base: str | None = None


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder that the driver and all executors see, under ``spark.checkpoint.dir``.

    Where the session has no such setting and all runs in one process (tests), a
    temporary folder of this machine is used; on a cluster that is an error.
    """
    global _own_base
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_base = base = _own_base or tempfile.mkdtemp(prefix="chainweave-")
    return f"{base.rstrip('/')}/chainweave-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", path: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet into a new shared folder, or to ``path``, and read it back."""
    spark = df.sparkSession
    path = path or shared_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Whether Spark removes the shuffle files of an execution when it ends, or when the driver happens to collect its garbage.
RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """The stored tables of one job, by name. ``released``: the shuffle files of a table are removed when it is written, not after many rounds."""

    def __init__(self, spark: SparkSession, name: str, released: bool = False):
        self.spark, self.base, self.names, self.released = spark, shared_folder(spark, name), set(), released

    def path(self, name: str) -> str:
        self.names.add(name)
        return f"{self.base}/{name}"

    def store(self, df: DataFrame, name: str, **options) -> DataFrame:
        if not self.released:
            return stored(df, path=self.path(name), **options)
        former = self.spark.conf.get(RELEASED)
        self.spark.conf.set(RELEASED, "true")
        try:
            return stored(df, path=self.path(name), **options)
        finally:
            self.spark.conf.set(RELEASED, former)

    def drop(self, *names: str) -> None:
        for name in names:
            removed(self.spark, f"{self.base}/{name}")
            self.names.discard(name)

    def close(self, *kept: str) -> None:
        """Remove all but ``kept``, which what the job returns still reads."""
        self.drop(*self.names.difference(kept))
