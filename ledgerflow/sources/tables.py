"""Company table scans (O-01) and the allowed-company filter (O-02)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import COMPANIES


_allowed: tuple[str, ...] = COMPANIES


def set_companies(names: Iterable[str] | str | None = None) -> tuple[str, ...]:
    """Set the allowed companies (names, or one comma-separated text; None: the default set); returns them."""
    global _allowed
    if names is None:
        _allowed = COMPANIES
    else:
        parts = names.split(",") if isinstance(names, str) else names
        chosen = tuple(dict.fromkeys(p.strip() for p in parts if p.strip()))
        if not chosen:
            raise ValueError("at least one company must be allowed")
        _allowed = chosen
    return _allowed


def companies() -> tuple[str, ...]:
    """The allowed companies."""
    return _allowed


def check_companies(dbs: Iterable[str] | None) -> tuple[str, ...]:
    """Validate a company list against the allowed set; ``None`` means all of them."""
    if dbs is None:
        return _allowed
    dbs = tuple(dbs)
    bad = [d for d in dbs if d not in _allowed]
    if bad:
        raise ValueError(f"Database {bad[0]} not in allowed list")
    return dbs


def allowed(df: DataFrame, dbs: Iterable[str] | None = None, col: str = "db") -> DataFrame:
    """Keep rows of allowed companies only (a pushable IN predicate)."""
    return df.filter(F.col(col).isin(list(check_companies(dbs))))


def company_spine(spark: SparkSession, dbs: Iterable[str] | None = None) -> DataFrame:
    """One row per company, so companies without rows still report (size = |companies|)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in check_companies(dbs)])).alias("db"))


def per_company(df: DataFrame, dbs: Iterable[str] | None = None) -> DataFrame:
    """Give a shared table (no ``db`` column) one copy per company.

    The expansion factor is the fixed company list, not data, so it is a bounded
    generate and never a join."""
    if "db" in df.columns:
        return allowed(df, dbs)
    return df.withColumn("db", F.explode(F.array(*[F.lit(d) for d in check_companies(dbs)])))


def load_tables(spark: SparkSession, paths: dict[str, str | Sequence[str]], fmt: str = "parquet",
                dbs: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Read company tables.

    ``paths`` maps a table name to either one path (already holding a ``db``
    column or ``db=`` partition folders) or a per-company list in ``dbs`` order;
    per-company reads are tagged with ``db`` and unioned by name.
    """
    dbs = check_companies(dbs)
    out: dict[str, DataFrame] = {}
    for name, p in paths.items():
        if isinstance(p, str):
            df = spark.read.format(fmt).load(p)
            out[name] = allowed(df, dbs) if "db" in df.columns else df
        else:
            parts = [spark.read.format(fmt).load(x).withColumn("db", F.lit(d)) for d, x in zip(dbs, p, strict=True)]
            df = parts[0]
            for other in parts[1:]:
                df = df.unionByName(other, allowMissingColumns=True)
            out[name] = df
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, db: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              properties: dict[str, str] | None = None) -> DataFrame:
    """One company's table over JDBC, split on a numeric column, tagged with ``db``."""
    check_companies([db])
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load().withColumn("db", F.lit(db))


def write_company_table(df: DataFrame, path: str, cluster_by: Sequence[str] = (), mode: str = "errorifexists",
                        files_per_company: int | None = None) -> None:
    """Write a company table in the layout the operators' filters prune best.

    Folders per company (``db=...``: the allowed-company filter becomes partition
    pruning); inside, rows are range-partitioned and sorted on ``cluster_by``
    (e.g. ``date_order``), so each file covers a narrow range and Parquet min/max
    statistics skip row groups for the date-range filters. Range partitioning also
    splits a company holding a third of the rows over many files."""
    cols = ["db", *cluster_by]
    out = df.repartitionByRange(files_per_company * len(companies()), *cols) if files_per_company \
        else df.repartitionByRange(*cols)
    out.sortWithinPartitions(*cols).write.mode(mode).partitionBy("db").parquet(path)


def bucket_count(total_bytes: int, bucket_bytes: int = 256 << 20) -> int:
    """Buckets so that one holds about ``bucket_bytes`` (a power of two, so that tables of other sizes can still share work)."""
    return 1 << max(0, -(-total_bytes // bucket_bytes) - 1).bit_length()


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Store a table bucketed and sorted by ``keys`` and return it.

    Two tables with the same number of buckets on the columns of a join (lines by company and order, orders by
    company and id) are joined bucket by bucket: neither is shuffled, however often the join is asked. Hashing
    the rows to their buckets before the write makes one sorted file per bucket."""
    rows = df.repartition(int(buckets), *keys)
    (rows.write.format("parquet").mode("errorifexists").bucketBy(int(buckets), *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def bucketed_table(spark: SparkSession, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table that ``write_bucketed`` stored at ``path``, made known to another session's catalog."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        by = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS "
                  f"LOCATION '{path}'")
    return spark.table(name)
