"""Structured Streaming entry points (O-80..O-82).

* ``audit_stream``: approval outcomes -> audit rows -> the audit table, through ``append_audit``.
* ``command_stream``: chat command log -> routed commands -> Parquet sink (stateless).
* ``approval_stream``: approval requests -> ``foreachBatch`` fold against the
  object states left by earlier batches. Running windows are not allowed on a
  streaming DataFrame, and the fold needs the current object state, so each
  micro-batch runs the batch operator. States and request keys are kept in buckets
  by object; a batch reads and replaces only those of its requests. Every write is
  keyed by the batch id and replays are dropped, so a restarted query never applies
  a request twice.

All sinks use a checkpoint location; pass folders in the shared checkpoint
root (``ledgerflow.session.work_dir``), never machine-local ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerflow.operators.approvals import audit_rows, distinct_requests, fold_requests, new_states, request_key
from ledgerflow.operators.chat import parse_commands
from ledgerflow.session import materialize
from ledgerflow.sources import versions as vs
from ledgerflow.sources.audit import append_audit


def _trigger(writer, available_now: bool, interval: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    if interval:
        return writer.trigger(processingTime=interval)
    return writer


# O-80
def audit_stream(outcomes: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True,
                 interval: str | None = None) -> StreamingQuery:
    """Audit rows of a stream of outcomes, appended batch by batch like any other audit rows: same
    layout, and a repeated batch writes nothing twice."""
    def append(batch: DataFrame, batch_id: int) -> None:
        append_audit(audit_rows(batch), sink_path)

    w = outcomes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


# O-82
def command_stream(log: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True,
                   interval: str | None = None) -> StreamingQuery:
    w = (parse_commands(log).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, interval).start(sink_path)


# O-81 -------------------------------------------------------------------------------------------

#: Buckets of objects (by hash) whose states are kept, read and replaced together, and of a day's request keys.
BUCKETS, DAY_BUCKETS = 16, 4

_STATES = T.StructType([T.StructField("db", T.StringType()), T.StructField("object_type", T.StringType()),
                        T.StructField("object_id", T.StringType()), T.StructField("state", T.StringType()),
                        T.StructField("changed_at", T.TimestampNTZType()), T.StructField("bucket", T.IntegerType())])
_SEEN = T.StructType([T.StructField("_key", T.StringType()), T.StructField("day", T.StringType()),
                      T.StructField("part", T.IntegerType())])


def _bucket(kind: Column, buckets: int) -> Column:
    """Bucket of an object: a hash of company, type and id."""
    return F.pmod(F.xxhash64("db", kind, F.col("object_id").cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def _day_part(kind: Column, buckets: int) -> list[Column]:
    """Where a request's key is kept: its day (``none`` without a time) and a part of that by its object."""
    day = F.coalesce(F.date_format("requested_at", "yyyy-MM-dd"), F.lit("none"))
    return [day.alias("day"), (_bucket(kind, buckets) % DAY_BUCKETS).cast("int").alias("part")]


def current_states(spark: SparkSession, states_path: str, before_batch: int | None = None,
                   buckets: Iterable[int] | None = None) -> DataFrame | None:
    """Latest state per object that batches (below ``before_batch``) left, of all or some ``buckets``: one row per
    object, as each bucket's newest version holds them all."""
    if buckets is None:
        buckets = vs.partitions(spark, states_path, "bucket")
    got = vs.read_version(spark, states_path, ["bucket"], [[b] for b in buckets], _STATES, before_batch)
    return None if got is None else got.drop("bucket")


def overlay_states(table: DataFrame, states: DataFrame | None, kind: str) -> DataFrame:
    """The object table with the states the earlier batches left."""
    if states is None:
        return table
    s = states.filter(F.col("object_type") == kind).select(
        "db", F.col("object_id").cast(table.schema["id"].dataType).alias("id"), F.col("state").alias("_new_state"))
    return (table.join(s, ["db", "id"], "left")
            .withColumn("state", F.coalesce(F.col("_new_state"), F.col("state"))).drop("_new_state"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def approval_batch(spark: SparkSession, batch: DataFrame, batch_id: int, table: Callable[[], DataFrame],
                   kind: str, outcomes_path: str, states_path: str,
                   partners: Callable[[], DataFrame] | None = None, compact_every: int = 0,
                   buckets: int = BUCKETS) -> None:
    """One micro-batch of O-81: drop replays, fold, write the outcomes, then the states and request keys.

    What earlier batches left is kept by bucket (a hash of the object): the states as ``states_path/bucket=``, the
    keys of the requests seen as ``states_path_seen/day=/part=`` (a replay has the time and object of the request
    it repeats). A batch lists, reads and replaces only the buckets and days of its own requests, late ones
    included, whatever came before. The outcomes are written first, under the batch id; states and keys are versions
    of that id (``sources.versions``), so a batch that failed anywhere is simply run again."""
    out_dir, seen_path = f"{outcomes_path}/batch_id={batch_id}", f"{states_path}_seen"
    if not _exists(spark, f"{out_dir}/_SUCCESS"):
        _fold_batch(spark, batch, batch_id, table, kind, out_dir, seen_path, states_path, partners, buckets)
    written = spark.read.parquet(out_dir)
    new = written.select(request_key(written, kind).alias("_key"), *_day_part(F.lit(kind), buckets))
    days = _parts(new, "day", "part")
    if not days:
        return
    seen = vs.read_version(spark, seen_path, ["day", "part"], days, _SEEN, batch_id)
    vs.write_version(new if seen is None else seen.unionByName(new), seen_path, ["day", "part"], batch_id)
    vs.drop_old(spark, seen_path, ["day", "part"], days, batch_id)
    changed = new_states(written).withColumn("bucket", _bucket(F.col("object_type"), buckets))
    touched = _parts(changed, "bucket")
    if touched:
        old = vs.read_version(spark, states_path, ["bucket"], touched, _STATES, batch_id)
        rows = changed.withColumn("_new", F.lit(1))
        if old is not None:
            rows = rows.unionByName(old.withColumn("_new", F.lit(0)))
        merged = rows.groupBy("db", "object_type", "object_id", "bucket").agg(
            F.max_by("state", F.struct("_new", "changed_at")).alias("state"), F.max("changed_at").alias("changed_at"))
        vs.write_version(merged, states_path, ["bucket"], batch_id)
        vs.drop_old(spark, states_path, ["bucket"], touched, batch_id)
    if compact_every and batch_id > 0 and batch_id % compact_every == 0:
        # All states in one folder, for readers that want them as of a batch.
        snap = current_states(spark, states_path, batch_id + 1)
        if snap is not None:
            snap.write.mode("overwrite").parquet(f"{states_path}_compact/batch_id={batch_id}")


def _parts(df: DataFrame, *keys: str) -> list[tuple]:
    """The partitions that rows belong to: a row per bucket and day, whatever the number of rows."""
    return [tuple(r) for r in df.select(*keys).distinct().collect()]


def _fold_batch(spark: SparkSession, batch: DataFrame, batch_id: int, table: Callable[[], DataFrame], kind: str,
                out_dir: str, seen_path: str, states_path: str, partners: Callable[[], DataFrame] | None, buckets: int) -> None:
    # The batch is read once, its repeats are merged once and replays dropped once; what follows uses the rest several times.
    reqs = distinct_requests(batch, kind)
    reqs = materialize(reqs.select("*", _bucket(F.lit(kind), buckets), *_day_part(F.lit(kind), buckets)))
    touched = _parts(reqs, "day", "part", "bucket")
    seen = vs.read_version(spark, seen_path, ["day", "part"], sorted({(d, p) for d, p, _ in touched}), _SEEN, batch_id)
    if seen is not None:
        reqs = materialize(reqs.join(seen.select(F.col("_key").alias("_rk")), "_rk", "left_anti"))
    states = current_states(spark, states_path, batch_id, sorted({b for _, _, b in touched}))
    named = reqs.select("db", F.col("object_id").alias("id")).distinct()
    objects = overlay_states(table().join(named, ["db", "id"], "left_semi"), states, kind)
    outcomes = fold_requests(reqs.drop("bucket", "day", "part"), objects, kind, partners() if partners is not None else None)
    outcomes.write.mode("overwrite").parquet(out_dir)


def approval_stream(requests: DataFrame, table: Callable[[], DataFrame], kind: str, outcomes_path: str,
                    states_path: str, checkpoint: str, available_now: bool = True,
                    interval: str | None = None, partners: Callable[[], DataFrame] | None = None,
                    compact_every: int = 0, buckets: int = BUCKETS) -> StreamingQuery:
    """``table`` / ``partners`` are callables so every micro-batch reads the current tables.

    Repeated requests have one outcome, in a batch and across batches; late ones are folded when they arrive.
    ``buckets`` (the same for the life of a state folder) is chosen so that one bucket's objects are a few files;
    with ``compact_every`` all states are also written as one folder every so many batches."""
    spark = requests.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        approval_batch(spark, batch, batch_id, table, kind, outcomes_path, states_path, partners, compact_every, buckets)

    w = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def drain(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query to finish; re-raise its failure."""
    query.awaitTermination()
    exc = query.exception()
    if exc is not None:
        raise RuntimeError(f"streaming query failed: {exc}")
