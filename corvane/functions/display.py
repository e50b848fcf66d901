"""Values as a person reads them: how long ago, short ids, countries and their flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The countries that have a name.
COUNTRIES = {
    "AU": "Australia",
    "BR": "Brazil",
    "CA": "Canada",
    "CN": "China",
    "DE": "Germany",
    "ES": "Spain",
    "FR": "France",
    "GB": "United Kingdom",
    "IN": "India",
    "IT": "Italy",
    "JP": "Japan",
    "KR": "South Korea",
    "MX": "Mexico",
    "NL": "Netherlands",
    "RU": "Russia",
    "SE": "Sweden",
    "US": "United States",
}
#: From a capital letter to the symbol that flags are made of.
REGIONAL = 0x1F1E6 - ord("A")


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display_time(c: Column | str) -> Column:
    """A time as it may be shown ('T' and 'Z' allowed, fractions too) as a wall-clock time; null if it is none."""
    plain = F.regexp_replace(F.replace(_text(c), F.lit("T"), F.lit(" ")), "Z+$", "")
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"), F.try_to_timestamp(plain)).cast("timestamp_ntz")


def relative_time(c: Column | str, now: Column) -> Column:
    """'just now', then seconds, minutes, hours and days 'ago', from 30 days on the date; text that is no time as it is."""
    s = F.timestamp_diff("SECOND", display_time(c), now)
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    out = F.when(s < 5, "just now").when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h"))
    return F.when(s.isNull(), _text(c)).otherwise(out.when(s < 2_592_000, ago(86_400, "d")).otherwise(F.substring(_text(c), 1, 10)))


def absolute_time(c: Column | str) -> Column:
    return F.coalesce(F.concat(F.date_format(display_time(c), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), _text(c))


def short_id(c: Column | str) -> Column:
    """The first eight characters and an ellipsis; ids of up to eight as they are."""
    c = _text(c)
    return F.when(F.length(c) > 8, F.concat(F.substring(c, 1, 8), F.lit("..."))).otherwise(c)


def country_name(code: Column | str) -> Column:
    names = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.coalesce(F.element_at(names, F.upper(_text(code))), F.lit("Unknown"))


def country_flag(code: Column | str) -> Column:
    """The regional symbols of a code's letters, in capitals; other ASCII characters move as far, the rest stays."""
    flags = F.create_map(*(F.lit(x) for k in range(128) for x in (chr(k), chr(k + REGIONAL))))
    letters = F.split(F.upper(_text(code)), "")
    return F.array_join(F.transform(letters, lambda x: F.coalesce(F.element_at(flags, x), x)), "")


def icon(device_type: Column | str) -> Column:
    """The name of the picture of a device type: monitor, tablet or mobile."""
    low = F.lower(_text(device_type))
    return F.when(low.isin("tablet", "mobile"), low).otherwise("monitor")
