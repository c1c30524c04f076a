"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``: unlike an executor-local
checkpoint, such a table survives the loss of any executor, and unlike ``checkpoint()`` it computes its
input once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Writes tables below the shared checkpoint folder, and deletes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.gettempdir()}/immunoframe"  # one machine: tests and single-machine use
        self.spark = spark
        self.base = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables whose readers have all been written."""
        for df in tables:
            self._delete(df._scratch_path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table, after which all other tables of this scratch are deleted."""
        done = self.n
        out = self.cut(df)
        for i in range(1, done + 1):
            self._delete(f"{self.base}/{i}")
        return out

    def close(self) -> None:
        """Deletes all tables of this scratch: whatever reads them must have been written."""
        self._delete(self.base)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that no name can clash with a working column."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
