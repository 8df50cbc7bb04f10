"""Cutting lineage in storage that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a single-process session (tests) without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="kinloom-"))
    return _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kinloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs no recomputation beyond its running tasks. The folder is left to the retention of
    ``spark.checkpoint.dir``, since the returned frame stays lazy.
    """
    return Scratch(df.sparkSession).write(df, label)


class Scratch:
    """Tables written on the way to a result, deleted once nothing reads them any more.

    Drop a table only after everything made from it has been written itself: a lost executor may have to read it again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str = "step", **options: int) -> DataFrame:
        path = new_path(self._spark, label)
        df.write.options(**options).parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables that ``write`` returned as these frames; others are left alone."""
        gone = [(f, p) for f, p in self._paths if any(f is x for x in frames)]
        for pair in gone:
            self._delete(pair[1])
            self._paths.remove(pair)

    def drop_all_but(self, *frames: DataFrame) -> None:
        self.drop(*[f for f, _ in self._paths if not any(f is x for x in frames)])

    def _delete(self, path: str) -> None:
        context = self._spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
