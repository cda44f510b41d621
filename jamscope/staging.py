"""Write an intermediate table once and go on from the written copy.

A table that feeds many later jobs (the cleaned trips, the route medians, the
model sample) is written as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and read back.  That cuts lineage, survives the loss
of executors, and later jobs read only the columns they need.  The row count is
read from the Parquet footers, so size checks cost no further pass.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


class Staged:
    """A written table.  ``rows`` is counted when first asked for, from what was written."""

    def __init__(self, frame: DataFrame, path: str) -> None:
        self.frame = frame
        self.path = path

    @cached_property
    def rows(self) -> int:
        return self.frame.count()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or where that is unset
    the warehouse, which a session shares with its executors by definition."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir')}/staging"


class StagingArea:
    """Names, writes and re-reads intermediate tables of one study."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.path = f"{(root or checkpoint_root(spark)).rstrip('/')}/jamscope-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> Staged:
        """Write ``df`` once; the result reads the written copy."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return Staged(self.spark.read.schema(df.schema).parquet(path), path)

    def remove(self) -> None:
        """Delete all staged tables; frames that read them are of no use afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> StagingArea:
        return self

    def __exit__(self, *_) -> None:
        self.remove()
