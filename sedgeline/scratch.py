"""Written tables in the folder that driver and executors share.

A written table cuts lineage as ``checkpoint()`` does, survives the loss of
executors, and is smaller than a checkpoint because Parquet compresses it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one on a single machine, and RuntimeError on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/sedgeline-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables of one operator's run; each can be dropped once what follows it is written."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.paths, self._keep = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}, []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            if path := self.paths.pop(id(df), None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        """Drops every table that is still there."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.paths.clear()

    def release(self) -> None:
        """Lets Spark remove the shuffle files of jobs that are done: it does so once the driver's garbage is collected, which may be long after."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
