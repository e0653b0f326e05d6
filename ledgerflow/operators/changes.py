"""Apply create / update / write / delete changes to a keyed table (O-77).

Per key the fold is fixed by a few plain aggregates (summed per task first, so a key
with a third of all changes costs one row per task):

* the latest ``delete``, and the first ``create`` after it: the create by which the key
  exists (creates that meet a live key are refused), and
* per column, the latest value set after that.

One aggregate finds these in one reading (``_fold``); the creates of a key that was created, deleted
and created again are read once more.

A delete removes the row (later updates find nothing, as on the ERP); a create starts the
row from its own values (columns it does not carry are NULL). Updates to keys that do not
exist are dropped. The new snapshot is the full outer join of the table with the folded
changes. Write it to a new folder (``write_snapshot``); never overwrite the folder being read. A large table with few
changes is kept by ranges of its key (``create_ranged``): ``apply_to_ranged`` reads and rewrites only the ranges that
the changes name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.operators.sequence import GROUP_SLICES, SEEN, slice_of, with_previous
from ledgerflow.session import materialize
from ledgerflow.sources import versions as vs

RESET_OPS = ("create", "delete")
UPDATE_OPS = ("update", "write")


def _named(c: str, mask_col: str | None) -> Column:
    """Does a change name column ``c``? With a mask column (array of names) it says so, else a value does."""
    return F.col(c).isNotNull() if mask_col is None else F.coalesce(F.array_contains(mask_col, c), F.lit(False))


def apply_changes(base: DataFrame, changes: DataFrame, key: Sequence[str] | str = "name",
                  seq_col: str = "seq", op_col: str = "op", mask_col: str | None = None) -> DataFrame:
    """New snapshot of ``base`` after ``changes`` (columns of ``changes`` that ``base`` has are changeable).

    * ``create`` adds a row for a key that does not exist then; on a live key it is refused and changes
      nothing (see ``refused_creates``);
    * ``update`` / ``write`` set the columns they name on a live key: with ``mask_col`` those in that array,
      to NULL too; without it those with a value;
    * ``delete`` removes the row. A later ``create`` starts it anew.

    Changes of one key apply in the order of ``seq_col``, which is unique per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = [c for c in base.columns if c not in keys and c in changes.columns]
    return _merge(base, _fold(changes, keys, columns, seq_col, op_col, mask_col), keys, columns)


def _merge(base: DataFrame, folded: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` after the folded changes of its keys."""
    present = base.select(*keys).withColumn("_here", F.lit(True))
    stays = F.col("_here").isNotNull() & F.col("_deleted").isNull()
    live = folded.join(present, keys, "left").withColumn("_exists", stays | F.col("_create").isNotNull())
    live = live.withColumn("_born", F.when(~stays, F.col("_create"))).drop("_here")
    j = base.join(live, keys, "full_outer").filter(F.coalesce("_exists", F.lit(True)))
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        value = F.when(F.col("_born").isNull(), F.col(c))  # a created row starts empty
        if c in columns:
            set_ = F.col(f"_u_{c}")
            value = (F.when(set_.isNotNull() & (F.col("_born").isNull() | (set_["s"] >= F.col("_born"))), set_["v"])
                     .when(F.col("_born").isNotNull(), F.col("_made")[c]).otherwise(value))
        out.append(value.cast(base.schema[c].dataType).alias(c))
    return j.select(*out)


def _fold(changes: DataFrame, keys: list[str], columns: list[str], seq_col: str, op_col: str, mask_col: str | None) -> DataFrame:
    """Per changed key: its latest delete (``_deleted``), the first create after that and its values (``_create``,
    ``_made``), and per column the latest update that names it with its place (``_u_<column>``: ``v``, ``s``).

    One aggregate over the changes finds all but the create of a key that was created before its latest delete and
    again after it; of such keys the creates are read once more."""
    op, seq = F.lower(F.col(op_col)), F.col(seq_col)
    steps = changes.dropna(subset=keys).filter(op.isin(*RESET_OPS, *UPDATE_OPS))
    made_at, row = F.when(op == "create", seq), F.struct(F.lit(True).alias("_made"), *columns)
    resets = [F.max(F.when(op == "delete", seq)).alias("_deleted"), F.min(made_at).alias("_first")]
    sets = [F.max_by(F.struct(F.col(c).alias("v"), seq.alias("s")), F.when(op.isin(*UPDATE_OPS) & _named(c, mask_col), seq)).alias(f"_u_{c}")
            for c in columns]
    folded = steps.groupBy(*keys).agg(*resets, F.min_by(row, made_at).alias("_made"), *sets)
    again = (steps.filter(op.isin(*RESET_OPS)).groupBy(*keys).agg(*resets, F.max(made_at).alias("_last"))
             .filter("_first <= _deleted AND _last > _deleted").select(*keys, "_deleted"))
    later = steps.filter(op == "create").join(again, keys).filter(seq > F.col("_deleted"))
    later = later.groupBy(*keys).agg(F.min(seq).alias("_later"), F.min_by(row, seq).alias("_later_made"))
    dead = F.col("_first") <= F.col("_deleted")
    return folded.join(later, keys, "left").select(
        *keys, "_deleted", F.when(dead, F.col("_later")).otherwise(F.col("_first")).alias("_create"),
        F.when(dead, F.col("_later_made")).otherwise(F.col("_made")).alias("_made"), *[f"_u_{c}" for c in columns])


def refused_creates(base: DataFrame, changes: DataFrame, key: Sequence[str] | str = "name",
                    seq_col: str = "seq", op_col: str = "op") -> DataFrame:
    """The ``create`` changes that met a live key: those after no delete on a key of ``base``, and those after
    the first create that follows the key's latest earlier delete."""
    keys = [key] if isinstance(key, str) else list(key)
    op = F.lower(F.col(op_col))
    creates = changes.filter(op == "create")
    # A create meets a live key if the key's step before it is a create, or if there is none and the key is in base.
    steps = (changes.filter(op.isin(*RESET_OPS)).dropna(subset=[*keys, seq_col]).groupBy(*keys, seq_col)
             .agg(F.max(op == "create").alias("_creates"), F.max(op == "delete").alias("_deletes")))
    steps = with_previous(steps, keys, [seq_col], {"_deletes": "_after_delete"}).filter("_creates")
    present = base.select(*keys).distinct()
    refused = (steps.filter(~F.col("_after_delete"))
               .unionByName(steps.filter(F.col("_after_delete").isNull()).join(present, keys, "left_semi"))
               .select(*keys, seq_col))
    unordered = creates.filter(F.col(seq_col).isNull()).join(present, keys, "left_semi").select(*creates.columns)
    return (creates.join(refused, [*keys, seq_col], "left_semi").select(*creates.columns)
            .unionByName(unordered).distinct())


def write_snapshot(df: DataFrame, path: str, version: int | str, partition_by: Sequence[str] = ()) -> str:
    """Write a snapshot under ``path/v=<version>`` (a new folder each time) and return it."""
    target = f"{path.rstrip('/')}/v={version}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    return target


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Read the highest-numbered complete snapshot folder under ``path``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    versions = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            try:
                versions.append(int(name[2:]))
            except ValueError:
                continue
    if not versions:
        raise FileNotFoundError(f"no complete snapshot under {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/v={max(versions)}")


# --- a table kept by ranges of its key ---------------------------------------------------------------

#: Rows of a range when the table is created; there are ``GROUP_SLICES`` ranges at most.
RANGE_ROWS = 1_000_000
RANGE = "_range"
#: Children of a node of the search tree over the bounds.
FAN = 16


def _ranged(df: DataFrame, keys: Sequence[str], bounds: DataFrame) -> DataFrame:
    """``df`` with the number of the range of its key: how many bounds are not above it. ``bounds`` is one row: an
    array of ``GROUP_SLICES`` keys at most.

    The bounds are searched as a tree: a node holds ``FAN - 1`` of them and is looked up by its number, so that a
    row meets one node per level and never carries the whole array."""
    key = F.struct(*[F.col(k) for k in keys])
    at = F.col("_at") + 1
    numbered = bounds.select(F.posexplode("_bounds").alias("_at", "_bound"))
    out, width = df.withColumn(RANGE, F.lit(0)), FAN
    while width < GROUP_SLICES:  # the last range takes all that is not below bound GROUP_SLICES - 1
        width *= FAN
    while width > 1:
        step = width // FAN  # this level parts ranges of ``width`` numbers into ``FAN``
        nodes = numbered.where((at % step == 0) & (at % width != 0)).groupBy((at - at % width).alias("_node"))
        nodes = nodes.agg(F.sort_array(F.collect_list("_bound")).alias("_bounds"))
        out = out.join(F.broadcast(nodes), F.col(RANGE) == F.col("_node"), "left")
        out = out.withColumn(RANGE, F.col(RANGE) + slice_of(key, FAN) * step).drop("_node", "_bounds")
        width = step
    return out


def _bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_bounds")


def create_ranged(df: DataFrame, path: str, key: Sequence[str] | str = "name", version: int = 0, range_rows: int = RANGE_ROWS) -> None:
    """Store a table by ranges of its key, cut at quantiles of keys picked by their hash; the bounds are kept beside it."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    n = df.count()
    ranges = min(max(1, -(-n // range_rows)), GROUP_SLICES)
    order = F.struct(*[F.col(k) for k in keys])
    picked = df.select(order.alias("_key")).where(F.pmod(F.xxhash64("_key"), F.lit(max(1, n // (ranges * SEEN)))) == 0)
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges)), lambda i: F.get("_keys", (i * F.size("_keys") / ranges).cast("int")))
    cuts = picked.agg(F.sort_array(F.collect_list("_key")).alias("_keys")).select(
        F.filter(F.array_distinct(at), lambda k: k.isNotNull()).alias("_bounds"))
    cuts.write.mode("errorifexists").parquet(f"{path}/_bounds")
    vs.write_version(_ranged(df, keys, _bounds(spark, path)), path, [RANGE], version)
    vs.commit(spark, path, version)


def read_ranged(spark: SparkSession, path: str, schema: T.StructType, ranges: Sequence[int] | None = None,
                version: int | None = None) -> DataFrame:
    """The table (columns of ``schema``) as of the newest committed version (or ``version``), or some of its ranges."""
    last = vs.committed(spark, path) if version is None else version
    if last is None:
        raise FileNotFoundError(f"no committed version under {path}")
    numbers = vs.partitions(spark, path, RANGE) if ranges is None else ranges
    return _read_ranges(spark, path, schema, numbers, last).drop(RANGE)


def _read_ranges(spark: SparkSession, path: str, schema: T.StructType, numbers: Sequence[int], version: int) -> DataFrame:
    """Rows of some ranges as of a version, with the number of their range."""
    whole = T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])
    got = vs.read_version(spark, path, [RANGE], [[r] for r in numbers], whole, version + 1)
    return spark.createDataFrame([], whole) if got is None else got


def apply_to_ranged(spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame, key: Sequence[str] | str = "name",
                    version: int | None = None, seq_col: str = "seq", op_col: str = "op", mask_col: str | None = None) -> int:
    """Apply a batch of changes (see ``apply_changes``) to a table kept by ranges; returns the new version.

    Only the ranges that hold a changed key are read and written, as files of the new version; the others keep
    theirs. The version is committed at the end, so a failed batch is run again and readers see all of it or
    nothing; the version before stays readable until the next but one."""
    keys = [key] if isinstance(key, str) else list(key)
    before = vs.committed(spark, path)
    new = before + 1 if version is None else int(version)
    if before is not None and new <= before:
        return before  # this batch is in the table already
    columns = [c for c in schema.names if c not in keys and c in changes.columns]
    # A row per changed key: its range is looked up once, and what is kept is no longer than that.
    folded = _fold(changes, keys, columns, seq_col, op_col, mask_col)
    folded = materialize(_ranged(folded, keys, _bounds(spark, path)))
    touched = [(r[0],) for r in folded.select(RANGE).distinct().collect()]  # a row per range
    if touched:
        base = _read_ranges(spark, path, schema, [r for r, in touched], -1 if before is None else before)
        out = _merge(base, folded, [*keys, RANGE], columns)
        vs.write_version(out, path, [RANGE], new, touched)
    vs.commit(spark, path, new)
    vs.drop_old(spark, path, [RANGE], touched, new)
    return new
