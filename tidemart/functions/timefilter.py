"""Date predicates for the dashboard queries, as Column builders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col_


def as_of_ts(as_of) -> Column:
    """The clock of a query: a fixed timestamp, or now() when None (Q9)."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def time_filter(date_col, days: int | None = 30, years=None, quarters=None, as_of=None) -> Column:
    """years IN (...) and/or quarters IN (...); when both are empty,
    ``date_col >= as_of_date - days``."""
    c = col_(date_col)
    conds = []
    if years:
        conds.append(F.year(c).isin(list(years)))
    if quarters:
        conds.append(F.quarter(c).isin(list(quarters)))
    if conds:
        out = conds[0]
        for x in conds[1:]:
            out = out & x
        return out
    return c >= F.date_sub(F.to_date(as_of_ts(as_of)), int(days))


def since_hours(ts_col, hours: int, as_of=None) -> Column:
    """``ts_col >= as_of - hours``: the live-query window."""
    return col_(ts_col) >= as_of_ts(as_of) - F.make_interval(hours=F.lit(int(hours)))


def recent(df, ts_col: str, hours: int, as_of=None):
    """Rows of the last ``hours``. Event facts carry the day of ``ts_col`` as
    ``date_key`` and are stored by it: filtering on both reads those days only."""
    start = as_of_ts(as_of) - F.make_interval(hours=F.lit(int(hours)))
    out = df.filter(col_(ts_col) >= start)
    return out.filter(F.col("date_key") >= F.to_date(start)) if "date_key" in df.columns else out


def parse_as_of(s) -> dt.datetime | None:
    if s is None or isinstance(s, dt.datetime):
        return s
    return dt.datetime.fromisoformat(str(s))
