"""Session-time-zone independent conversions between wall-clock (``TIMESTAMP_NTZ``)
and instants (``TIMESTAMP``), for event-time operators that need an instant
(watermarks) over data recorded as wall-clock UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000
_HOUR_US = 3_600_000_000
_MIN_US = 60_000_000


def ntz_as_utc_instant(c: Column) -> Column:
    """Wall clock read as UTC -> instant (independent of the session time zone)."""
    secs = F.date_part(F.lit("SECOND"), c)            # seconds with the microsecond fraction
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), secs, F.lit("UTC"))


def instant_as_utc_ntz(c: Column) -> Column:
    """Instant -> its UTC wall clock as ``TIMESTAMP_NTZ`` (independent of the session time zone)."""
    m = F.unix_micros(c)
    day = F.floor(m / F.lit(_DAY_US))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    rem = m - day * F.lit(_DAY_US)
    hours = F.floor(rem / F.lit(_HOUR_US)).cast("int")
    mins = F.floor((rem % F.lit(_HOUR_US)) / F.lit(_MIN_US)).cast("int")
    secs = ((rem % F.lit(_MIN_US)) / F.lit(1_000_000.0)).cast("decimal(8,6)")
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), hours, mins, secs)
