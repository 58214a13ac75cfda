"""Times as they come in events and replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Formats that are tried in order; a time without a zone is UTC.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss[X]", "yyyyMMddHHmmss")
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _mail_time(c: Column) -> Column:
    """The time of a mail or feed header (Tue, 02 Jan 2024 03:04:05 GMT or +0000) in a form that the formats know."""
    part = lambda k: F.regexp_extract(c, r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2}) ([a-z]{3}) (\d{4}) (\d\d:\d\d:\d\d)\s*(GMT|UTC|Z|[+-]\d{4})?$", k)
    month = F.lpad((F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part(2)))).cast("string"), 2, "0")
    zone = F.when(part(5).rlike(r"^[+-]"), F.concat(F.substring(part(5), 1, 3), F.lit(":"), F.substring(part(5), 4, 2))).otherwise("Z")
    return F.when(part(1) != "", F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), zone))


def parse_time(c: Column | str) -> Column:
    """A time in any of the known formats; null for others."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS], F.try_to_timestamp(_mail_time(s), F.lit(FORMATS[0])))


def event_seconds(*keys: Column) -> Column:
    """Seconds since 1970 of the first of some texts that is a number or a time, else 0."""
    return F.coalesce(*[x for c in keys for x in (F.expr("null").cast("double") if c is None else c.try_cast("double"), F.unix_micros(parse_time(c)) / 1e6)], F.lit(0.0))
