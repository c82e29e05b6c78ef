"""Dates: lenient parsing, month gate, date score, report month, anomalies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days on both sides of a month's end that count as one month.
BOUNDARY_DAYS = 2


def iso_date(text: Column) -> Column:
    """The date that the first ten characters write as YYYY-MM-DD; null otherwise."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(F.rlike(head, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-M-d"))))


def loose_date(text: Column) -> Column:
    """The first date of a text: parts between . - / or 년월일, years of two digits are 20yy; null if there is none."""
    pattern = r"(\d{4}|\d{2})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})"
    y, m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    iso = F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(y != "", F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))


def same_month(a: Column, b: Column) -> Column:
    return F.trunc(a, "MM") == F.trunc(b, "MM")


def month_gate(a: Column, b: Column) -> Column:
    """One month, or so near each other over a month's end; a missing date passes."""
    return F.when(a.isNull() | b.isNull(), True).otherwise(same_month(a, b) | (F.abs(F.datediff(a, b)) <= BOUNDARY_DAYS))


def date_score(a: Column, b: Column) -> Column:
    """1 in one month, 0.85 near each other over its end, 0 otherwise; 0.4 if one is missing, null if both are."""
    return (
        F.when(a.isNull() & b.isNull(), F.lit(None).cast("double"))
        .when(a.isNull() | b.isNull(), 0.4)
        .when(same_month(a, b), 1.0)
        .when(F.abs(F.datediff(a, b)) <= BOUNDARY_DAYS, 0.85)
        .otherwise(0.0)
    )


def report_month(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def date_anomaly(text: Column, as_of: Column) -> Column:
    """missing, unreadable, future, before 2000, or ok."""
    d = loose_date(text)
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "missing")
        .when(d.isNull(), "unreadable")
        .when(d > as_of, "future")
        .when(F.year(d) < 2000, "old")
        .otherwise("ok")
    )
