"""Periods, partial dates and money texts (OP-D01..D10, OP-M01, M02, M06, H32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(period: Column) -> Column:
    """OP-D01: YYYYMM -> the first day of the month; null where it is no month."""
    month = (period % 100).cast("int")
    return F.when(month.between(1, 12), F.make_date(F.floor(period / 100).cast("int"), F.when(month.between(1, 12), month), F.lit(1)))


def month_end(period: Column) -> Column:
    return F.last_day(month_start(period))


def partial_date(text: Column) -> Column:
    """OP-D02: 'YYYY', 'YYYY-MM' or 'YYYY-MM-DD' -> struct(date, precision): the last day that the text allows. Null for other texts."""
    year = F.when(text.rlike(r"^\d{4}$"), F.struct(F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd").alias("date"), F.lit("year").alias("precision")))
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.struct(F.last_day(F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")).alias("date"), F.lit("month").alias("precision")))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.struct(F.try_to_date(text, "yyyy-MM-dd").alias("date"), F.lit("day").alias("precision")))
    found = F.coalesce(year, month, day)
    return F.when(found["date"].isNotNull(), found)


def partial_difference(a: Column, b: Column) -> Column:
    """OP-D03: days from b to a at the coarser precision of two partial dates; years count as 365 days, months by their ends."""
    coarse = (a["precision"] == "year") | (b["precision"] == "year")
    monthly = (a["precision"] == "month") | (b["precision"] == "month")
    whole = (F.year(a["date"]) - F.year(b["date"])) * 365
    ends = F.datediff(F.last_day(a["date"]), F.last_day(b["date"]))
    return F.when(coarse, whole).when(monthly, ends).otherwise(F.datediff(a["date"], b["date"]))


def month_field(month: Column, year: Column) -> Column:
    """OP-D04: month and year texts -> struct(value, issue): 'YYYY-MM', or 'YYYY' where only the month is empty.

    A part that is there and not plausible gives no value and the raw texts as the issue; where both are empty there is neither.
    """
    m, y = F.coalesce(F.trim(month), F.lit("")), F.coalesce(F.trim(year), F.lit(""))
    good_year = y.rlike(r"^\d{4}$") & F.coalesce(y.try_cast("int").between(1990, 2060), F.lit(False))
    good_month = m.rlike(r"^\d{1,2}$") & F.coalesce(m.try_cast("int").between(1, 12), F.lit(False))
    whole = F.when(m == "", y).otherwise(F.concat_ws("-", y, F.lpad(m, 2, "0")))
    plausible = good_year & (good_month | (m == ""))
    empty = (m == "") & (y == "")
    issue = F.when(~empty & ~plausible, F.concat(F.lit("month '"), m, F.lit("', year '"), y, F.lit("'")))
    return F.struct(F.when(plausible, whole).alias("value"), issue.alias("issue"))


def demangled(day: Column, mangled: Column) -> Column:
    """OP-D05: struct(day, rule) of a date. In a mangled edition, month and two-digit year were read as a date: 2022-MM-YY stands for
    20YY-MM, and a year of 1930 to 1949 lacks a century. 1900-01-01 stands for no date."""
    cell = lambda d, rule: F.struct(d.cast("date").alias("day"), F.lit(rule).alias("rule"))
    nothing = F.lit(None)
    return (
        F.when(day.isNull(), cell(nothing, "empty")).when(day == F.lit("1900-01-01").cast("date"), cell(nothing, "placeholder"))
        .when(mangled & (F.year(day) == 2022), cell(F.make_date(F.lit(2000) + F.dayofmonth(day), F.month(day), F.lit(1)), "month and year read as month and day"))
        .when(mangled & F.year(day).between(1930, 1949), cell(F.make_date(F.year(day) + 100, F.month(day), F.lit(1)), "century"))
        .otherwise(cell(day, "as published"))
    )


def dollars(amount: Column, unit: str) -> Column:
    """OP-M06: an amount of a unit as dollars."""
    return amount * {"dollar": 1.0, "thousand": 1e3, "million": 1e6}[unit]


def months_between_starts(a: Column, b: Column) -> Column:
    """OP-D09: month boundaries crossed from a to b."""
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))


def utc_day(seconds: Column) -> Column:
    """OP-D10: epoch seconds -> day in UTC, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def money(text: Column) -> Column:
    """OP-M01: '$1,501,000' or '(1,200.50)' -> a double; null for other texts. Parentheses and a leading minus are negative."""
    t = F.regexp_replace(F.trim(text), r"[$,\s]", "")
    negative = t.rlike(r"^\(.*\)$|^-")
    digits = F.regexp_replace(t, r"^[(-]+|\)$", "")
    return F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits.try_cast("double") * F.when(negative, -1.0).otherwise(1.0))


def quarter_start(text: Column) -> Column:
    """OP-H32: 'YYYYQn' or 'YYYY-Qn' -> the first day of the quarter."""
    year, quarter = (F.regexp_extract(text, r"^(\d{4})-?Q([1-4])$", i) for i in (1, 2))
    return F.when(year != "", F.make_date(F.nullif(year, F.lit("")).cast("int"), F.nullif(quarter, F.lit("")).cast("int") * 3 - 2, F.lit(1)))
