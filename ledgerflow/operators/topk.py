"""Ranking, paging and dimension lookups (O-36, O-37, O-39).

Top-k per company uses ``row_number() <= k`` so that Spark inserts a partial
``WindowGroupLimit`` below the exchange: each task forwards at most ``k`` rows
per company, so a company holding a third of all rows never lands whole in one
task. Very large ``k`` and deep pages are located first (``ordering``) and use, as
unlimited rankings do, the range-partitioned rank from ``sequence``.

Lookups broadcast a dimension only when its estimated size is under the
session's broadcast threshold. Beyond it, a result with a proven bound (top-k:
``k * |companies|`` rows, or an id list) is broadcast instead: its key set
filters the streamed dimension and the few hits are broadcast back, so the
dimension is never shuffled or broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.ordering import SortKey, first_of_each, from_to
from ledgerflow.operators.sequence import rank_within_group
from ledgerflow.session import fits_broadcast, materialize
from ledgerflow.sources.tables import companies

RANK_COL = "rank"


def _group_limit_threshold(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def _order(order: Sequence[Column | SortKey]) -> tuple[list[Column], list[SortKey] | None]:
    """The columns of an order, and its sort keys where it is given by these."""
    keys = list(order) if all(isinstance(k, SortKey) for k in order) else None
    return [k.column() if isinstance(k, SortKey) else k for k in order], keys


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | SortKey], k: int | None,
                    rank_col: str | None = RANK_COL) -> DataFrame:
    """Rows ranked ``1..k`` inside each group by ``order_cols`` (which must end in a unique tie-break).

    ``k=None`` keeps every row (ranked when ``rank_col`` is given, as a long). A small ``k``
    uses ``row_number() <= k`` (Spark limits each task to k rows per group before
    the shuffle). Above the group-limit threshold the value of the first sort key at rank ``k`` is located
    by counting ranges (``ordering.first_of_each``; needs ``SortKey``s), and only the rows up to it are ranked, by the
    range-partitioned rank, so a group holding a third of all rows is spread over many tasks."""
    if k is None and rank_col is None:
        return df
    columns, keys = _order(order_cols)
    if k is None or int(k) > _group_limit_threshold(df):
        name = rank_col or "_rn"
        rows = first_of_each(df, group_cols, keys, int(k)) if k is not None and keys else df
        out = rank_within_group(rows, group_cols, columns, name)
        if k is not None:
            out = out.filter(F.col(name) <= F.lit(int(k))).withColumn(name, F.col(name).cast("int"))
        return out if rank_col else out.drop(name)
    w = Window.partitionBy(*group_cols).orderBy(*columns)
    name = rank_col or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= F.lit(int(k)))
    return out if rank_col else out.drop(name)


DEEP_PAGE = 10_000  # pages that end beyond this are located by counting and ranked in many tasks


def top_k(df: DataFrame, order_cols: Sequence[Column | SortKey], k: int | None, offset: int = 0) -> DataFrame:
    """Global top-k with offset paging; ``k=None`` sorts only.

    Shallow pages use ``orderBy().offset().limit()`` (``TakeOrderedAndProject``: each
    task keeps offset + k rows). A page that ends beyond ``DEEP_PAGE``, also one without an offset, would gather
    that many rows in one place: with ``SortKey``s the values of the first key at its ends are located by counting
    ranges, so only the rows between them are read whole and ranked (range-partitioned); else all rows are
    ranked. ``order_cols`` must then be a total order."""
    offset = int(offset or 0)
    columns, keys = _order(order_cols)
    if (offset or k is not None) and (k is None or offset + int(k) > DEEP_PAGE):
        rows, base = from_to(df, keys, offset + 1, None if k is None else offset + int(k)) if keys else (df, 0)
        ranked = rank_within_group(rows, [], columns, "_pos")
        cond = F.col("_pos") > offset - base
        if k is not None:
            cond = cond & (F.col("_pos") <= offset + int(k) - base)
        return ranked.filter(cond).orderBy("_pos").drop("_pos")
    out = df.orderBy(*columns)
    if offset:
        out = out.offset(offset)
    if k is not None:
        out = out.limit(int(k))
    return out


def _keys(on: Sequence[tuple[str, str]] | tuple[str, str]) -> list[tuple[str, str]]:
    return [on] if isinstance(on[0], str) else list(on)  # type: ignore[list-item]


def bounded_lookup(small: DataFrame, dim: DataFrame, on, take: dict[str, str]) -> DataFrame:
    """Left-join ``dim`` columns onto ``small`` when ``small`` has a proven size bound.

    ``on`` is one ``(small_col, dim_col)`` pair or a list of them. The dimension
    is filtered by an inner join against the broadcast key set of ``small``
    (bounded), and the few matching dimension rows are broadcast back (at most one
    per key, as dimension keys are unique ids). Neither step broadcasts or
    shuffles the dimension itself.
    """
    pairs = _keys(on)
    kn = [f"_lk{i}" for i in range(len(pairs))]
    small = materialize(small)  # bounded: read twice below without recomputing its inputs
    keys = small.select(*[F.col(a).alias(k) for (a, _), k in zip(pairs, kn)]).dropna().distinct()
    cond = [dim[b] == keys[k] for (_, b), k in zip(pairs, kn)]
    hit = dim.join(F.broadcast(keys), cond, "inner").select(
        *[keys[k] for k in kn], *[dim[src].alias(dst) for src, dst in take.items()]
    )
    back = [small[a] == hit[k] for (a, _), k in zip(pairs, kn)]
    return small.join(F.broadcast(hit), back, "left").drop(*kn)


#: Largest proven number of rows that a lookup broadcasts.
BOUND_ROWS = 100_000


def row_bound(limit: int | None, dbs=None) -> int | None:
    """Rows that ``limit`` per company can give at most; None when there is no limit."""
    return None if limit is None else int(limit) * len(list(dbs) if dbs is not None else companies())


def lookup(big: DataFrame, dim: DataFrame, on, take: dict[str, str], bounded: int | None) -> DataFrame:
    """Left lookup of dimension columns.

    * the projected dimension is estimated under the broadcast threshold: broadcast
      it (a size-checked broadcast, one pass);
    * else, ``big`` has ``bounded`` rows at most (top-k, id list) and that is no more
      than ``BOUND_ROWS``: ``bounded_lookup``, which never shuffles or broadcasts the
      dimension;
    * else a plain left join: AQE broadcasts at runtime if a side turns out small,
      and otherwise sort-merges."""
    if isinstance(bounded, bool):
        raise TypeError("bounded is a number of rows or None")
    pairs = _keys(on)
    kn = [f"_lk{i}" for i in range(len(pairs))]
    right = dim.select(*[F.col(b).alias(k) for (_, b), k in zip(pairs, kn)],
                       *[F.col(src).alias(dst) for src, dst in take.items()])
    if fits_broadcast(right):
        right = F.broadcast(right)
    elif bounded is not None and bounded <= BOUND_ROWS:
        return bounded_lookup(big, dim, on, take)
    cond = [big[a] == right[k] for (a, _), k in zip(pairs, kn)]
    return big.join(right, cond, "left").drop(*kn)


def company_keys(left_col: str, dim: DataFrame, dim_col: str = "id") -> list[tuple[str, str]]:
    """Join keys for a per-company dimension (``db`` + id) or a shared one (id only)."""
    return [("db", "db"), (left_col, dim_col)] if "db" in dim.columns else [(left_col, dim_col)]
