"""Orders as values: sort keys, pages after a key, and where the n-th row of an order lies.

A page that starts after the last row of the page before (a keyset page) is a filter on the sort keys, so it
reaches the scan and costs the same for the first page and the millionth. A page that starts at a number, or a
top-k with a very large k, first finds the value of the first key at that number: counts per range of the key (at
most ``RANGES`` rows a pass, each pass looks into one range of the pass before) locate it exactly, and only the
rows from there on are ranked.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of the key that are counted in one pass, and passes at most.
RANGES, PASSES = 1024, 8
#: A range of so few rows is not looked into further.
ENOUGH = 50_000


@dataclass(frozen=True)
class SortKey:
    """One column of an order. Nulls come first when ascending and last when descending, unless told otherwise."""

    name: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def nulls_lead(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_lead else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_lead else c.asc_nulls_last()


def columns_of(keys: Sequence[SortKey]) -> list[Column]:
    return [k.column() for k in keys]


def literal(value: Any, kind: T.DataType) -> Column:
    """A value of a column's type (times without zone are not shifted by the session's zone)."""
    if isinstance(value, dt.datetime) and isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    if isinstance(value, decimal.Decimal):
        return F.lit(value).cast(kind)
    return F.lit(value)


def after(df: DataFrame, keys: Sequence[SortKey], last: Mapping[str, Any]) -> Column:
    """Rows that come after the row with the values ``last`` of the ``keys`` (directions may be mixed, values null)."""
    out: Column | None = None
    for k in reversed(keys):
        c, value = F.col(k.name), last[k.name]
        if value is None:
            later, same = (c.isNotNull() if k.nulls_lead else F.lit(False)), c.isNull()
        else:
            v = literal(value, df.schema[k.name].dataType)
            later, same = (c < v if k.descending else c > v), c == v
            if not k.nulls_lead:
                later = later | c.isNull()
        out = later if out is None else later | (same & out)
    first = keys[0]
    if last[first.name] is not None:  # the same once more for the first key alone, in a form that any scan understands
        c, v = F.col(first.name), literal(last[first.name], df.schema[first.name].dataType)
        reached = c <= v if first.descending else c >= v
        out = out & (reached if first.nulls_lead else reached | c.isNull())
    return out


def page_after(df: DataFrame, keys: Sequence[SortKey], last: Mapping[str, Any] | None, length: int) -> DataFrame:
    """The ``length`` rows that follow the key ``last`` (None: the first page), in order."""
    rows = df if last is None else df.where(after(df, keys, last))
    return rows.orderBy(*columns_of(keys)).limit(int(length))


def last_key(page: DataFrame, keys: Sequence[SortKey]) -> dict[str, Any] | None:
    """The key of a page's last row, from which the next page starts; None for an empty page."""
    backwards = [SortKey(k.name, not k.descending, not k.nulls_lead) for k in keys]
    rows = page.orderBy(*columns_of(backwards)).select(*[k.name for k in keys]).limit(1).collect()
    return rows[0].asDict() if rows else None


# --- where the n-th row lies ------------------------------------------------------------------------

def _image(name: str, kind: T.DataType) -> Column | None:
    """A number that never falls as the column rises (equal values may share it); None: no such number is known."""
    c = F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        finite = F.greatest(F.least(c.cast("double"), F.lit(1e308)), F.lit(-1e308))
        return F.when(F.isnan(c), F.lit(1e308)).when(c.isNotNull(), finite) / 4
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return (c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(F.to_date(c)) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if isinstance(kind, T.StringType):  # the first six bytes
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return None


@dataclass
class Place:
    """Where a numbered row of one group lies in the order: among the rows whose first key is between ``low`` and
    ``high`` (``null``: among those without one), with ``before`` rows ahead of all of these."""

    target: int
    before: int = 0
    low: Any = None
    high: Any = None
    null: bool = False
    beyond: bool = False
    span: tuple[float, float] = field(default=(0.0, 0.0))
    open: bool = True


def locate(df: DataFrame, key: SortKey, groups: Sequence[Column], targets: Sequence[int]) -> list[Place] | None:
    """The place of row ``targets[i]`` (from 1) among the rows of ``groups[i]`` (disjoint conditions).

    Each pass is one aggregation of ``RANGES`` rows a group at most. None if the key's type has no ranges."""
    image = _image(key.name, df.schema[key.name].dataType)
    if image is None:
        return None
    which = F.lit(None).cast("int")
    for i, cond in reversed(list(enumerate(groups))):
        which = F.when(cond, F.lit(i)).otherwise(which)
    rows = df.select(which.alias("_g"), F.col(key.name).alias("_r"), (-image if key.descending else image).alias("_v")).where("_g is not null")
    places = [Place(int(t)) for t in targets]
    some = {r["_g"]: r for r in rows.groupBy("_g").agg(
        F.count("_r").alias("n"), F.sum(F.col("_r").isNull().cast("long")).alias("nulls"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
        F.min("_r").alias("first"), F.max("_r").alias("last")).collect()}
    for i, p in enumerate(places):
        s = some.get(i)
        if s is None or p.target > s["n"] + s["nulls"]:
            p.beyond, p.open = True, False
            continue
        ahead = s["nulls"] if key.nulls_lead else 0
        if p.target <= ahead or p.target > ahead + s["n"]:
            p.null, p.open, p.before = True, False, 0 if p.target <= ahead else s["n"]
            continue
        p.before, p.span, p.low, p.high = ahead, (s["lo"], s["hi"]), s["first"], s["last"]
        p.open = s["n"] > ENOUGH and s["lo"] < s["hi"]
    for _ in range(PASSES):
        todo = [(i, p) for i, p in enumerate(places) if p.open]
        if not todo:
            break
        cell = F.lit(None).cast("long")
        for i, p in todo:
            lo, hi = p.span
            inside = (F.col("_g") == i) & (F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi))
            at = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(hi - lo) * RANGES), F.lit(RANGES - 1)).cast("long")
            cell = F.when(inside, at).otherwise(cell)
        counts: dict[int, list] = {}
        for r in (rows.select("_g", "_r", "_v", cell.alias("_c")).where("_c is not null").groupBy("_g", "_c")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min("_r").alias("first"),
                       F.max("_r").alias("last")).collect()):
            counts.setdefault(r["_g"], []).append(r)
        for i, p in todo:
            for r in sorted(counts[i], key=lambda r: r["_c"]):
                if p.before + r["n"] >= p.target:
                    p.span, p.low, p.high = (r["lo"], r["hi"]), r["first"], r["last"]
                    p.open = r["n"] > ENOUGH and r["lo"] < r["hi"]
                    break
                p.before += r["n"]
    return places


def _bound(df: DataFrame, key: SortKey, place: Place, upper: bool) -> Column | None:
    """Rows not before (``upper``: not behind) a place; None: all rows."""
    c = F.col(key.name)
    if place.beyond:
        return None if upper else F.lit(False)
    if place.null:  # all nulls are in one place: the first or the last
        if key.nulls_lead:
            return c.isNull() if upper else None
        return None if upper else c.isNull()
    value = place.high if upper != key.descending else place.low
    v = literal(value, df.schema[key.name].dataType)
    inside = c <= v if upper != key.descending else c >= v
    return inside | c.isNull() if key.nulls_lead == upper else inside


def from_to(df: DataFrame, keys: Sequence[SortKey], first: int | None, last: int | None) -> tuple[DataFrame, int]:
    """Rows of ``df`` among which the rows numbered ``first`` to ``last`` (from 1; None: open) of the order lie, and how
    many rows of the order come before all of these."""
    base, rows = 0, df
    low = locate(df, keys[0], [F.lit(True)], [first]) if first is not None and first > 1 else None
    high = locate(df, keys[0], [F.lit(True)], [last]) if last is not None else None
    if low:
        base = low[0].before
        cond = _bound(df, keys[0], low[0], upper=False)
        rows = rows if cond is None else rows.where(cond)
    if high:
        cond = _bound(df, keys[0], high[0], upper=True)
        rows = rows if cond is None else rows.where(cond)
    return rows, base


#: Groups up to which the largest rows of each are located (one aggregation for all of them).
GROUPS = 64


def first_of_each(df: DataFrame, group_cols: Sequence[str], keys: Sequence[SortKey], k: int) -> DataFrame:
    """Rows of ``df`` among which the first ``k`` of every group lie (all rows where there are more than ``GROUPS`` groups)."""
    names = df.select(*group_cols).distinct().limit(GROUPS + 1).collect()
    if len(names) > GROUPS:
        return df
    conds = []
    for r in names:
        cond = F.lit(True)
        for g in group_cols:
            cond = cond & (F.col(g).isNull() if r[g] is None else F.col(g) == literal(r[g], df.schema[g].dataType))
        conds.append(cond)
    places = locate(df, keys[0], conds, [int(k)] * len(conds))
    if places is None:
        return df
    wanted = F.lit(False)
    for cond, place in zip(conds, places, strict=True):
        inside = _bound(df, keys[0], place, upper=True)
        wanted = wanted | (cond if inside is None else cond & inside)
    return df.where(wanted)
