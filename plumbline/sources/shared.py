"""The folder that driver and executors share, and stages that are written there once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; in local mode an own one where that is unset."""
    app = spark.sparkContext.applicationId
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="plumbline-"))
    return f"{base.rstrip('/')}/{app}"


def status(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Stages:
    """Results that are written once and read from there; with the same folder, a later run goes on after the last one that
    was finished. A stage that was cut off has no mark of success and is written anew."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"

    def done(self, name: str) -> bool:
        store, mark = status(self.spark, f"{self.folder}/{name}/_SUCCESS")
        return store.exists(mark)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self.done(name):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        store, where = status(self.spark, self.folder)
        store.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: a lineage cut that outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The URI of a path, as other readers than Spark's take it."""
    store, where = status(spark, path)
    uri = str(store.makeQualified(where).toUri())
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
