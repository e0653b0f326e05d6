"""Session helpers: a local session for tests and benches, and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "ledgerflow", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local benches. Clusters pass their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint location the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local-mode session
    without it (tests) gets a fresh scratch folder; a cluster without it is an error,
    since a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base and not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
        base = tempfile.mkdtemp(prefix="ledgerflow-ckpt-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return "/".join([base, *parts]) if parts else base


def materialize(df):
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where a plan must read the same intermediate result more than once and
    every read must see identical rows (ids from a range partitioning), or where
    re-deriving a small bounded result would rescan large inputs."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cluster_settings(total_cores: int, shuffle_bytes: int, target_partition_bytes: int = 200 << 20) -> dict[str, str]:
    """Settings for a cluster run: partitions sized so each shuffle partition fits executor memory.

    ``shuffle_bytes`` is the largest expected shuffle (e.g. the line table after
    projection). Partitions start at max(2 x cores, shuffle / 200 MB); AQE then
    coalesces small ones and splits skewed ones at runtime."""
    parts = max(2 * total_cores, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def _bytes(conf_value: str) -> int:
    v = conf_value.strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30,
             "t": 1 << 40, "tb": 1 << 40}
    for suffix in sorted(units, key=len, reverse=True):
        if v.endswith(suffix) and v[: -len(suffix)].strip().lstrip("-").isdigit():
            return int(v[: -len(suffix)]) * units[suffix]
    return int(v)


def broadcast_threshold(spark: SparkSession) -> int:
    """The session's broadcast size limit in bytes (<= 0: broadcasting disabled)."""
    return _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def estimated_size_bytes(df) -> int:
    """Catalyst's size estimate of ``df`` after pruning (file sizes scaled to the read columns)."""
    v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(v) if isinstance(v, int) else int(v.toString())


def fits_broadcast(df) -> bool:
    """True when ``df``'s estimated size is under the session's broadcast threshold."""
    limit = broadcast_threshold(df.sparkSession)
    return limit > 0 and estimated_size_bytes(df) <= limit
