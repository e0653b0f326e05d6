"""Tables whose partitions are replaced one by one, each write a version of its own.

A partition's rows lie in ``<path>/<key>=<value>/.../v=<version>``. A write names its version (a batch id) and
replaces only the partitions it has rows for (dynamic partition overwrite); a reader takes, per partition, the
newest version below its own. So a write that is repeated after a failure starts from the same rows as the first
try, whatever the first try had already written, and files of other partitions are neither listed nor touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "v"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` (none if it does not exist)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def _place(path: str, keys: Sequence[str], part: Sequence) -> str:
    return "/".join([path, *(f"{k}={v}" for k, v in zip(keys, part, strict=True))])


def versions(spark: SparkSession, path: str, keys: Sequence[str], part: Sequence) -> list[int]:
    """Versions of one partition, ascending."""
    names = _folders(spark, _place(path, keys, part))
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{VERSION}="))


def partitions(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the (first) key that have a folder."""
    return [n.split("=", 1)[1] for n in _folders(spark, path) if n.startswith(f"{key}=")]


def write_version(df: DataFrame, path: str, keys: Sequence[str], version: int, parts: Iterable[Sequence] = ()) -> None:
    """Replace the partitions that ``df`` has rows for. Rows are rebalanced by the keys: a large partition is split
    over tasks and files at run time, small ones share a task. ``parts`` are replaced even if no row is left."""
    rows = df.withColumn(VERSION, F.lit(int(version)))
    (rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys, VERSION).parquet(path))
    for part in parts:
        p, fs = _fs(df.sparkSession, f"{_place(path, keys, part)}/{VERSION}={int(version)}")
        fs.mkdirs(p)  # a partition without rows is an empty folder


def commit(spark: SparkSession, path: str, version: int) -> None:
    """Make a version the one that ``committed`` names: readers that ask for it see all of its partitions or none."""
    p, fs = _fs(spark, f"{path}/_commits/{VERSION}={int(version)}")
    fs.mkdirs(p)


def committed(spark: SparkSession, path: str) -> int | None:
    """The newest committed version."""
    names = _folders(spark, f"{path}/_commits")
    return max((int(n.split("=", 1)[1]) for n in names if n.startswith(f"{VERSION}=")), default=None)


def read_version(spark: SparkSession, path: str, keys: Sequence[str], parts: Iterable[Sequence], schema: T.StructType,
                 before: int | None = None) -> DataFrame | None:
    """Rows (columns of ``schema``, which holds the keys) of the newest version below ``before`` of each partition
    in ``parts``; None if there are none. Only these folders are listed and read."""
    folders = []
    for part in parts:
        have = [v for v in versions(spark, path, keys, part) if before is None or v < before]
        if have:
            folders.append(f"{_place(path, keys, part)}/{VERSION}={have[-1]}")
    if not folders:
        return None
    whole = T.StructType([*schema.fields, T.StructField(VERSION, T.IntegerType())])
    return spark.read.schema(whole).option("basePath", path).parquet(*folders).drop(VERSION)


def drop_old(spark: SparkSession, path: str, keys: Sequence[str], parts: Iterable[Sequence], version: int) -> None:
    """Delete versions that neither readers after ``version`` nor a repeated write of it need: those below the
    newest one before ``version``."""
    for part in parts:
        earlier = [v for v in versions(spark, path, keys, part) if v < version]
        for v in earlier[:-1]:
            p, fs = _fs(spark, f"{_place(path, keys, part)}/{VERSION}={v}")
            fs.delete(p, True)
