"""The append-only audit table (O-03, O-04).

Layout: Parquet partitioned by ``created_date``; inside each file rows are
sorted by ``action_type, actor``. The four indexes of a database table become

* on the time: partition pruning;
* on the action type: sorting and min/max statistics;
* on the actor, and on the object (type and id; ``request_id`` too): Bloom filters, by which a
  scan for one value skips the row groups that do not hold it (``audit_by``).

Appending reads only what a replay could have written before: the days of the batch
(dynamic partition pruning), and of these the ids alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("action_type", T.StringType(), False),
    T.StructField("actor", T.StringType(), False),
    T.StructField("actor_role", T.StringType(), True),
    T.StructField("odoo_db", T.StringType(), False),
    T.StructField("object_type", T.StringType(), False),
    T.StructField("object_id", T.StringType(), False),
    T.StructField("object_data", T.StringType(), True),
    T.StructField("result", T.StringType(), False),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("source", T.StringType(), False),
    T.StructField("request_id", T.StringType(), True),
])

AUDIT_COLUMNS = tuple(f.name for f in AUDIT_SCHEMA.fields)
PARTITION_COLUMN = "created_date"
#: Columns that are searched for one value: the written files carry a Bloom filter for each.
BLOOM_COLUMNS = ("actor", "object_id", "request_id")
#: Distinct values that a Bloom filter is made for (a row group holds no more of them in practice).
BLOOM_VALUES = 100_000


def conform_audit(df: DataFrame) -> DataFrame:
    """Cast an audit-shaped DataFrame to ``AUDIT_SCHEMA`` (column order and types)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT_SCHEMA.fields])


def audit_entries(df: DataFrame) -> DataFrame:
    """O-04 encoding step: the two open fields become JSON text, NULL when empty.

    ``object_data`` / ``metadata`` may arrive as structs or maps (encoded here)
    or already as strings (kept)."""
    out = df
    for name in ("object_data", "metadata"):
        if name in df.columns and not isinstance(df.schema[name].dataType, T.StringType):
            dtype = df.schema[name].dataType
            empty = F.size(F.col(name)) == 0 if isinstance(dtype, (T.MapType, T.ArrayType)) else F.lit(False)
            out = out.withColumn(name, F.when(F.col(name).isNotNull() & ~empty, F.to_json(
                F.col(name), {"ignoreNullFields": "false"})))
        elif name in df.columns:
            out = out.withColumn(name, F.when(F.col(name) != "", F.col(name)))
    return conform_audit(out)


def unseen_audit(df: DataFrame, path: str) -> DataFrame:
    """The rows of a batch, in the table's layout, whose ``id`` the table at ``path`` does not hold yet.

    Repeats in the batch are merged. A replayed row has the day of the row it repeats, so only the batch's days
    are read: the distinct days (a row per day, broadcast) prune the partitions at run time. Rows without a time
    lie in a partition of their own, which is read if the batch has such rows."""
    rows = audit_entries(df).withColumn(PARTITION_COLUMN, F.to_date("created_at")).dropDuplicates(["id"])
    table = read_audit(df.sparkSession, path)
    if table is None:
        return rows
    day = F.col(PARTITION_COLUMN)
    # Spark prunes at run time only by a side with a comparison in its filter. This one holds for every day.
    days = rows.where(F.unix_date(day) >= F.lit(-(2**31)).cast("int")).select(PARTITION_COLUMN).distinct()
    dated = table.where(day.isNotNull()).join(F.broadcast(days), PARTITION_COLUMN, "left_semi").select("id")
    # One row at most says whether the batch has undated rows.
    undated = rows.where(day.isNull()).select(F.lit(1).alias("_undated")).distinct()
    nameless = (table.where(day.isNull()).select("id", F.lit(1).alias("_undated"))
                .join(F.broadcast(undated), "_undated", "left_semi").select("id"))
    return rows.join(dated.unionByName(nameless), "id", "left_anti")


def bloom_options(columns: Iterable[str] = BLOOM_COLUMNS, values: int = BLOOM_VALUES) -> dict[str, str]:
    """Parquet write options that add a Bloom filter per column."""
    out: dict[str, str] = {}
    for c in columns:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        out[f"parquet.bloom.filter.expected.ndv#{c}"] = str(values)
        # A dictionary would be asked instead of the filter; these columns have too many values for one.
        out[f"parquet.enable.dictionary#{c}"] = "false"
    return out


def append_audit(df: DataFrame, path: str, dedupe: bool = True) -> None:
    """O-04: append audit rows to the table at ``path``.

    With ``dedupe`` an ``id`` is written once: repeats in the batch are merged, and ids that a replayed batch
    wrote before are dropped (``unseen_audit``)."""
    rows = unseen_audit(df, path) if dedupe else audit_entries(df).withColumn(PARTITION_COLUMN, F.to_date("created_at"))
    # Range partitioning splits a busy day over several tasks (files), each sorted.
    (rows.repartitionByRange(PARTITION_COLUMN, "action_type", "actor", "id")
     .sortWithinPartitions(PARTITION_COLUMN, "action_type", "actor")
     .write.mode("append").options(**bloom_options()).partitionBy(PARTITION_COLUMN).parquet(path))


def audit_by(table: DataFrame, actor: str | None = None, object_type: str | None = None, object_id: str | None = None,
             request_id: str | None = None) -> DataFrame:
    """Audit rows of one actor, object or request, in the order of their time (what the indexes of the table answer).

    The equalities reach the scan, where statistics and Bloom filters skip row groups without the value."""
    wanted = {"actor": actor, "object_type": object_type, "object_id": object_id, "request_id": request_id}
    if all(v is None for v in wanted.values()):
        raise ValueError("name an actor, an object or a request")
    for column, value in wanted.items():
        if value is not None:
            table = table.where(F.col(column) == F.lit(value))
    return table.orderBy(F.col("created_at").asc(), F.col("id").asc())


def read_audit(spark: SparkSession, path: str) -> DataFrame | None:
    """The audit table, or ``None`` when nothing was written yet."""
    try:
        schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField(PARTITION_COLUMN, T.DateType(), True)])
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001 - an absent table is the only expected failure
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise
