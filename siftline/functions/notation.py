"""Values that may be written in several ways: dates, numbers, flags and codes, as comparable strings or typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Diagnosis names and the visit name of the baseline, as numbers.
CODES = {"cn": 1, "mci": 2, "dementia": 3, "ad": 3, "bl": 0, "true": 1, "false": 0}


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a date or time column; wall-clock times count as they stand, whatever the session's time zone."""
    kind, c = dict(df.dtypes)[column], F.col(column)
    if kind == "timestamp":
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
    if kind == "date":
        return day
    return day + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def moment(v: Column) -> Column:
    """A timestamp without zone from ISO dates and times, M/d/yyyy, dMMMyyyy, yyyyMMdd and epoch seconds or milliseconds (UTC); else null."""
    s = F.lower(F.trim(v))
    n = F.regexp_replace(s, r"\.0+$", "")
    day = lambda text, form: F.try_to_timestamp(text, F.lit(form)).cast("date").cast("timestamp_ntz")
    since = lambda seconds: F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
    return (
        F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), day(s, "yyyy-MM-dd"))
        .when(s.rlike(r"^\d{4}-\d\d-\d\d[t ]\d\d:\d\d"), F.upper(s).try_cast("timestamp_ntz"))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), day(s, "M/d/yyyy"))
        .when(s.rlike(r"^\d{1,2}[a-z]{3}\d{4}$"), day(F.initcap(F.regexp_replace(s, r"^(\d+)", "$1 ")), "d MMMyyyy"))
        .when(n.rlike(r"^(19|20)\d{6}$"), day(n, "yyyyMMdd"))
        .when(n.rlike(r"^-?\d{9,10}$"), since(n.try_cast("decimal(18,6)")))
        .when(n.rlike(r"^-?\d{12,13}$"), since((n.try_cast("decimal(18,3)") / 1000).cast("decimal(18,6)")))
    )


def code(v: Column) -> Column:
    """A double from numbers in any notation, flags, diagnosis names and month codes such as m06; else null."""
    s = F.lower(F.trim(v))
    known = F.create_map(*(F.lit(x) for k, n in CODES.items() for x in (k, float(n))))
    return F.coalesce(F.try_element_at(known, s), F.when(s.rlike(r"^m?-?\d+(\.\d+)?(e[+-]?\d+)?$"), F.regexp_replace(s, "^m", "").try_cast("double")))


def canonical(v: Column) -> Column:
    """A string that is equal for two notations of one value: the day of a date or time, the value of a number or code, else the text in lower case without blanks around it."""
    return F.coalesce(F.concat(F.lit("d"), F.unix_date(moment(v).cast("date")).cast("string")), F.concat(F.lit("n"), code(v).cast("string")), F.lower(F.trim(v)))


def visit_code(v: Column) -> Column:
    """Visit codes as text: 6, 6.0 and m06 are m06; anything else stays."""
    n = F.regexp_replace(F.trim(v), r"\.0+$", "")
    return F.when(n.rlike(r"^\d+$"), F.concat(F.lit("m"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))).otherwise(F.trim(v))


def month(v: Column) -> Column:
    """The first day of the month of a text MM/yyyy or M/yyyy, else null."""
    s = F.trim(v)
    return F.when(s.rlike(r"^\d{1,2}/\d{4}$"), F.try_to_timestamp(F.concat(F.lit("1/"), s), F.lit("d/M/yyyy")).cast("date"))


def years(start: Column, end: Column) -> Column:
    """Years between two dates: days by 365.25; null if either is, or if the end lies before the start."""
    days = F.date_diff(end, start)
    return F.when(days >= 0, days / 365.25)
