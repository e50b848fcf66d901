"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS = "yyyy-MM-dd HH:mm:ss.SSS"


def present(c: Column | str) -> Column:
    """Neither null nor empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def text_ms(ts: Column | str) -> Column:
    return F.date_format(ts, MILLIS)


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a wall-clock (NTZ) time, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_epoch_ms(ms: Column | str) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_event_time(c: Column | str, fallback: Column | None = None) -> Column:
    """Text to a wall-clock time: milliseconds, else hundredths, else ``fallback`` (null: the row is rejected later)."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.coalesce(F.try_to_timestamp(c, F.lit(MILLIS)), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SS"))).cast("timestamp_ntz")
    return F.coalesce(found, fallback) if fallback is not None else found


def last_value(x: str, *order: str) -> Column:
    """The last present ``x`` in the order of ``order``; '' if none."""
    return F.coalesce(F.max_by(x, F.when(present(x), F.struct(*order))), F.lit(""))


def bucket_label(text: Column | str) -> Column:
    """``HH:00`` for hours and ``Mon dd`` for dates, from a date or hour as text, or from epoch milliseconds as digits."""
    text = F.col(text) if isinstance(text, str) else text
    ts = F.when(text.rlike(r"^\d{11,}$"), from_epoch_ms(F.try_to_number(F.when(text.rlike(r"^\d{11,}$"), text), F.lit("9" * 18)).cast("long"))).otherwise(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz"))
    hourly = (F.length(text) > 10) & ~text.rlike(r"^\d{11,}$")
    return F.when(ts.isNull(), text).when(hourly, F.date_format(ts, "HH:00")).otherwise(F.date_format(ts, "MMM dd"))


def one_decimal(x: Column | str) -> Column:
    """Half away from zero."""
    return F.round(x, 1)


def event_date(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def event_hour(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH")


def deterministic_id(*parts: Column | str) -> Column:
    """A replay-stable id: the first 32 hex digits of SHA-256 over the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
