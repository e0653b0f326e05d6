"""Column -> Column helpers (O-61..O-76). Each is one or two Spark built-ins."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.constants import CURRENCY_CODE, LOCAL_TZ, NOT_AVAILABLE, PLUS_INFINITY

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(value: _dt.date | str) -> _dt.date:
    """Normalise an ``as_of`` argument to a ``datetime.date``."""
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value))


def lit_date(d: _dt.date | str) -> Column:
    return F.lit(as_date(d))


def lit_ts_ntz(d: _dt.date | str) -> Column:
    """Midnight of ``d`` as TIMESTAMP_NTZ (no zone shift; folds to a constant)."""
    return F.lit(as_date(d)).cast("timestamp_ntz")


# O-61 / O-72: enum and set membership
def in_set(col: ColumnOrName, values: Iterable[str]) -> Column:
    return _c(col).isin(list(values))


# O-62: money text as ``{x:,.0f}`` (grouping, half-even rounding)
def rupiah(x: ColumnOrName) -> Column:
    return F.format_number(_c(x).cast("double"), 0)


# O-63: signed whole percent ``{sign}{x:.0f}%``; rint keeps half-even and the sign of -0
def signed_percent(x: ColumnOrName) -> Column:
    x = _c(x)
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.0f", F.rint(x)), F.lit("%"))


def change_text(current: ColumnOrName, previous: ColumnOrName) -> Column:
    """Comparison string of O-42: 'N/A' / '+∞' when the previous value is 0."""
    cur, prev = _c(current).cast("double"), _c(previous).cast("double")
    pct = (cur - prev) / prev * F.lit(100.0)
    return (
        F.when(prev == 0, F.when(cur == 0, F.lit(NOT_AVAILABLE)).otherwise(F.lit(PLUS_INFINITY)))
        .otherwise(signed_percent(pct))
    )


# O-64: naive value taken as UTC, shown in local time
def to_local(ts: ColumnOrName, tz: str = LOCAL_TZ) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts).cast("timestamp_ntz"))


# O-65: naive value taken as local time, shown in UTC
def to_utc(ts: ColumnOrName, tz: str = LOCAL_TZ) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(ts).cast("timestamp_ntz"))


# O-66: whole days from start to end (end defaults to as_of)
def days_between(start: ColumnOrName, end: Column | _dt.date | str) -> Column:
    end_c = end if isinstance(end, Column) else lit_date(end)
    return F.datediff(end_c, F.to_date(_c(start)))


# O-67: format in the local zone; ``fmt`` is a Spark datetime pattern
def format_date(ts: ColumnOrName, tz: str | None = LOCAL_TZ, fmt: str = "yyyy-MM-dd") -> Column:
    x = to_local(ts, tz) if tz else _c(ts)
    return F.date_format(x, fmt)


def format_datetime(ts: ColumnOrName, tz: str | None = LOCAL_TZ, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return format_date(ts, tz, fmt)


# O-68: start and end of day (kept naive)
def start_of_day(ts: ColumnOrName) -> Column:
    return F.date_trunc("day", _c(ts)).cast("timestamp_ntz")


def end_of_day(ts: ColumnOrName) -> Column:
    return start_of_day(ts) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")


# O-69: day / month buckets as half-open ranges (these push down to Parquet)
def period_bounds(as_of: _dt.date | str, period: str) -> tuple[_dt.date, _dt.date]:
    d = as_date(as_of)
    if period == "today":
        return d, d + _dt.timedelta(days=1)
    if period == "yesterday":
        return d - _dt.timedelta(days=1), d
    if period == "mtd":
        start = d.replace(day=1)
        nxt = (start + _dt.timedelta(days=32)).replace(day=1)
        return start, nxt
    raise ValueError(f"unknown period {period!r}")


def local_midnight_utc(d: _dt.date, tz: str) -> _dt.datetime:
    """Naive UTC instant of local midnight of ``d`` in ``tz`` (for zone-aware day bounds)."""
    from zoneinfo import ZoneInfo

    local = _dt.datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(tz))
    return local.astimezone(_dt.timezone.utc).replace(tzinfo=None)


def in_range(col: ColumnOrName, start: _dt.date, end: _dt.date, tz: str | None = None) -> Column:
    """``start <= col < end`` for a naive timestamp column.

    With ``tz`` the column holds UTC and the days are local days in ``tz``; the
    bounds are converted instead of the column, so the predicate still pushes
    down to the scan."""
    c = _c(col)
    if tz is None:
        return (c >= lit_ts_ntz(start)) & (c < lit_ts_ntz(end))
    lo, hi = local_midnight_utc(start, tz), local_midnight_utc(end, tz)
    return (c >= F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz")) & (c < F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz"))


def in_period(col: ColumnOrName, as_of: _dt.date | str, period: str, tz: str | None = None) -> Column:
    return in_range(col, *period_bounds(as_of, period), tz=tz)


# O-70 / O-73 / O-74: null defaulting
def default_text(col: ColumnOrName, default: str) -> Column:
    return F.coalesce(_c(col), F.lit(default))


def currency_of(symbol: ColumnOrName) -> Column:
    return F.coalesce(F.nullif(_c(symbol), F.lit("")), F.lit(CURRENCY_CODE))


def display_name(name: ColumnOrName, kind_label: str, object_id: ColumnOrName) -> Column:
    return F.coalesce(_c(name), F.concat(F.lit(kind_label + " "), _c(object_id).cast("string")))


# O-71: conditional value / count
def sum_if(cond: Column, value: ColumnOrName) -> Column:
    return F.sum(F.when(cond, _c(value)))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


# O-75: JSON encode, NULL when the value is empty
def json_or_null(struct_col: Column, present: Column | None = None) -> Column:
    enc = F.to_json(struct_col)
    return enc if present is None else F.when(present, enc)


# O-76: ISO text to timestamp
def parse_iso(col: ColumnOrName) -> Column:
    return _c(col).try_cast("timestamp_ntz")


# Money out: exact decimal inside, double only at the output edge
def money_out(col: ColumnOrName) -> Column:
    return _c(col).cast("double")


# Message templates: ``fill("Sales down {comparison} vs yesterday", comparison=col)``
def fill(template: str, **values: ColumnOrName) -> Column:
    """A string Column from a ``{name}`` template; the literal parts stay literal."""
    import string

    parts: list[Column] = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(_c(values[field]).cast("string"))
    return F.concat(*parts)
