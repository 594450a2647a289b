"""Times: epochs, expiry, durations, display."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from matterlake import schemas as S

NO_DATE = "—"


def issued_at(epoch_seconds: Column) -> Column:
    return F.timestamp_seconds(epoch_seconds)


def issued_before(epoch_seconds: Column, cut_off: Column) -> Column:
    """True only when a cut-off and an issue time exist and the issue is older."""
    return F.coalesce(issued_at(epoch_seconds) < cut_off, F.lit(False))


def expiry(issued: Column, seconds: int | Column = S.CODE_LIFE_SECONDS) -> Column:
    life = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return issued + F.make_dt_interval(secs=life)


def unexpired(expires: Column, now: Column) -> Column:
    return expires > now


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def display_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MMM d, yyyy"), F.lit(NO_DATE))


def same_address(a: Column, b: Column) -> Column:
    """E-mail addresses equal but for case."""
    return F.lower(a) == F.lower(b)
