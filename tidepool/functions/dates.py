"""Date and time helpers.

"Now" is always a parameter of the job (``as_of`` / ``run_ts``), never
``current_timestamp``: a retried task must compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def created_at_epoch(created_at) -> Column:
    """``"Wed Oct 10 20:19:24 +0000 2018"`` -> epoch seconds (offset honoured).

    Spark refuses the day-name field when parsing, so it is cut off first;
    the month name is parsed by ``MMM``.
    """
    body = F.substring(_c(created_at), 5, 1 << 20)
    return F.unix_timestamp(body, "MMM dd HH:mm:ss Z yyyy")


def format_created_at(ts, offset="+0000") -> Column:
    """Wall-clock timestamp -> ``"EEE MMM dd HH:mm:ss +hhmm yyyy"`` text (as
    posts carry it); ``offset`` is a literal or a Column of ``+hhmm`` text."""
    off = offset if isinstance(offset, Column) else F.lit(offset)
    return F.concat(F.date_format(_c(ts), "EEE MMM dd HH:mm:ss "), off,
                    F.date_format(_c(ts), " yyyy"))


def days_before(as_of: str, days: int) -> Column:
    return F.date_sub(F.to_date(F.lit(as_of)), days)
