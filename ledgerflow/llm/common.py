"""What several operators share: reading tables, scratch tables in the shared folder, sizes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.session import work_dir

#: Bytes of one Arrow batch sent to a Python task (long texts then make short batches).
BATCH_BYTES = 8 << 20
#: Paths of the tables stored inside the innermost ``temporary`` block.
_OWNED: ContextVar[list[str] | None] = ContextVar("_OWNED", default=None)
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def python_tasks(spark: SparkSession) -> None:
    """Prepare a session for Python tasks.

    Arrow batches are bounded by bytes, so that batches of long texts stay small, and workers get the
    folder of this library on their path (where it is not installed on them already)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH")])])


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared work folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read it. The table stays until its
    ``temporary`` block ends; outside of one it is the caller's to delete."""
    path = work_dir(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that operators store inside this block are deleted when it ends, also after an error.

    Operators return lazy DataFrames that read these tables, so write their results inside the block."""
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            remove(spark, path)


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names (other columns cannot clash)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of`` (null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(of)), F.lit(0))


def partitions_for(spark: SparkSession, total: int, per_partition: int) -> int:
    """Partitions so that each holds about ``per_partition`` of ``total``, and at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_partition))
