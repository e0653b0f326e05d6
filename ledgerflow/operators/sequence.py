"""Previous rows and ranks inside groups of any size.

``Window.partitionBy(group).orderBy(t)`` sends each group to one task, so a group holding a third of all rows would
run in a single task. ``with_previous`` keeps that window for ordinary groups and cuts a group of more than
``SLICE_ROWS`` rows into slices, ranges of its order: the window's key is then (group, slice), and the first row of a
slice takes the last row of the slice before, from a table of one row per slice. All rows are shuffled once, by
(group, slice). ``rank_within_group`` range-partitions the rows and adds up counts per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row number in partition
#: Rows that one task may order by itself.
SLICE_ROWS = 1_000_000
#: Slices of one group and of all groups at most (larger tables get larger slices), and rows looked at for a slice's bound.
GROUP_SLICES, ALL_SLICES, SEEN = 4096, 100_000, 20


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], prefix: str) -> Column:
    """Equality of the columns, nulls being equal; in ``right`` they carry a prefix."""
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[f"{prefix}{c}"])
    return same


def slice_bounds(df: DataFrame, group_cols: Sequence[str], order: Column, slice_rows: int) -> DataFrame:
    """(_b<group> ..., _bounds): for each group of more than ``slice_rows`` rows the order keys at which it is cut, ascending.

    A cut is a quantile of rows picked by the hash of their key, so every read gives the same. There are no more
    cuts than ``ALL_SLICES`` (slices have a share of all rows at least)."""
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    slices = F.least(F.ceil(F.col("_n") / slice_rows), F.lit(GROUP_SLICES)).cast("int")
    hot = sizes.select(*[F.col(c).alias(f"_b{c}") for c in group_cols], slices.alias("_slices"),
                       F.greatest(F.floor(F.col("_n") / (slices * SEEN)), F.lit(1)).cast("long").alias("_stride"))
    picked = (df.withColumn("_key", order).join(F.broadcast(hot), _same(df, hot, group_cols, "_b"))
              .where(F.pmod(F.xxhash64("_key"), F.col("_stride")) == 0))
    sorted_ = picked.groupBy(*[f"_b{c}" for c in group_cols]).agg(F.sort_array(F.collect_list("_key")).alias("_keys"), F.max("_slices").alias("_slices"))
    at = F.transform(F.sequence(F.lit(1), F.col("_slices") - 1), lambda i: F.get("_keys", (i * F.size("_keys") / F.col("_slices")).cast("int")))
    return sorted_.where("_slices > 1").select(*[f"_b{c}" for c in group_cols], F.array_distinct(at).alias("_bounds"))


def slice_of(key: Column, slices: int = GROUP_SLICES) -> Column:
    """How many bounds (fewer than ``slices``, a power of two) are not above the key (0 without bounds): a binary search."""
    steps = F.array(*[F.lit(1 << p) for p in reversed(range(slices.bit_length() - 1))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) <= key, at + step).otherwise(at))
    return F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(found)


def with_previous(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                  carry: dict[str, str], num_partitions: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add, per row, the ``carry`` columns (``src -> new name``) of the previous row of its group.

    ``order_cols`` (ascending, nulls first) must make the order total inside a group (end with a unique id). Rows
    without a predecessor get nulls; null group values are a group. ``num_partitions`` sizes the slices so that all
    rows would make so many."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    total, most = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    if num_partitions:
        slice_rows = -(-(total or 0) // num_partitions)
    slice_rows = max(slice_rows, -(-(total or 0) // ALL_SLICES), 1)
    row = F.struct(*[F.col(src).alias(dst) for src, dst in carry.items()])
    names = [F.col(c) for c in df.columns]
    if (most or 0) <= slice_rows:
        w = Window.partitionBy(*group_cols).orderBy(*columns)
        out = df.withColumn("_prev", F.lag(row).over(w))
        return out.select(*names, *[F.col(f"_prev.{dst}").alias(dst) for dst in carry.values()])
    # Some group is large: its bounds, the last rows of its slices and the rows themselves are read from one copy.
    df = materialize(df)
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])
    bounds = materialize(slice_bounds(df, group_cols, order, slice_rows))
    sliced = df.withColumn("_key", order).join(F.broadcast(bounds), _same(df, bounds, group_cols, "_b"), "left")
    sliced = sliced.withColumn("_slice", slice_of(F.col("_key"))).withColumn("_row", row)
    tails = (sliced.where(F.col("_bounds").isNotNull()).groupBy(*group_cols, "_slice").agg(F.max_by("_row", "_key").alias("_last")))
    before = F.lag("_last").over(Window.partitionBy(*group_cols).orderBy("_slice"))
    tails = tails.select(*[F.col(c).alias(f"_t{c}") for c in group_cols], F.col("_slice").alias("_tslice"), before.alias("_before"))
    w = Window.partitionBy(*group_cols, "_slice").orderBy("_key")
    out = sliced.drop("_bounds", *[f"_b{c}" for c in group_cols]).withColumn("_prev", F.lag("_row").over(w))
    out = out.join(F.broadcast(tails), _same(out, tails, group_cols, "_t") & (out["_slice"] == tails["_tslice"]), "left")
    return out.select(*[out[c] for c in df.columns],
                      *[F.coalesce("_prev", "_before")[dst].alias(dst) for dst in carry.values()])


def rank_within_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
                      rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """``row_number()`` per group without sending a group to one task.

    Rows are range-partitioned on ``(group, order)``; a row's rank is the number
    of rows of its group in earlier partitions (a running sum over a table of one
    row per (group, partition)) plus its position inside its own partition.
    ``order_cols`` must make the order total (end with a unique column)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_rid", F.monotonically_increasing_id()))
    ranged = materialize(ranged.withColumn("_pid", F.shiftright(F.col("_rid"), _LOCAL_BITS)))
    local = F.col("_rid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS)
    # One row per (group, partition): rows of the group there and its first position.
    stats = ranged.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min(local).alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    # Null group keys are groups too.
    names = [*group_cols, "_pid"]
    stats = stats.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(names)], "_before", "_first")
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    j = ranged.join(stats, same, "left")
    return j.select(*[F.col(c) for c in df.columns],
                    (F.col("_before") + (local - F.col("_first")) + 1).cast("long").alias(rank_col))
