"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, the warehouse, or on one machine a temporary folder."""
    for get in (spark.conf.get, spark.sparkContext.getConf().get):
        root = get("spark.checkpoint.dir", None)
        if root:
            return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="ledgerloom-")
    else:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_ledgerloom"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as ``__``) for the length of a block."""
    old = {}
    for key, value in conf.items():
        key = key.replace("__", ".")
        old[key] = spark.conf.get(key, None) if spark.conf.getAll.get(key) else None
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_OPENED: list[list] = []


@contextlib.contextmanager
def dropped_after() -> Iterator[None]:
    """Deletes the intermediate tables of all operators called in a block; what is kept is written in it."""
    opened: list = []
    _OPENED.append(opened)
    try:
        yield
    finally:
        _OPENED.remove(opened)
        for work in opened:
            work.drop()


class Workspace:
    """Written intermediate tables of one operator call.

    ``save`` cuts the lineage: the table is written once as Parquet into the
    shared folder, survives lost executors, and the shuffle files of the job
    that made it are dropped as soon as it is written.  ``drop`` deletes a
    table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"
        for opened in _OPENED:
            opened.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
