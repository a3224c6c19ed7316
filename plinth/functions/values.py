"""Comparable forms of money, text, dates and missing values (OP-P10, OP-T05, OP-D06, OP-M01, OP-M02)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries that only say that a value is missing, in lower case and trimmed.
MISSING = ("", "-", "--", "?", "??", "???", ".", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "tbd", "tba", "to be determined", "unknown", "not available", "missing", "<blank>", "blank")

# The shapes in which dates come as text, and their formats; slashed dates are month first.
DATE_FORMATS = {
    r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd",
    r"^\d{8}$": "yyyyMMdd",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
    r"^\d{1,2}-[A-Za-z]{3}-\d{4}$": "d-MMM-yyyy",
    r"^[A-Za-z]{3} \d{1,2}, \d{4}$": "MMM d, yyyy",
}

#: Blanks of any kind, for trimming; Java's \s does not hold the no-break space.
BLANK = r"[\s\p{Z}\x{FEFF}\x{200B}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def present(c: Column) -> Column:
    """OP-P10: the trimmed text, or null where it is null, blank or only says that the value is missing."""
    t = trimmed(c)
    return F.when(~F.lower(t).isin(*MISSING), t)


def squeezed(c: Column) -> Column:
    """Text apart from letter case and spacing."""
    return F.lower(F.regexp_replace(c, rf"{BLANK}+", ""))


def finite(c: Column) -> Column:
    """c, or null where it is not a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def cents(c: Column) -> Column:
    """Money as comparable text: whole cents, or the number itself where it is not finite or too large for them."""
    exact = F.abs(c) < F.lit(9.0e15)
    whole = F.when(exact, F.round(F.when(exact, c) * F.lit(100.0), 0).cast("bigint"))
    return F.coalesce(whole.cast("string"), c.cast("string"))


def day_of_text(c: Column) -> Column:
    """The calendar day that a text names in one of DATE_FORMATS, a time of day aside; null if none. Each text is parsed once."""
    t = F.regexp_replace(present(c), r"[T ]\d{1,2}:\d{2}.*$", "")
    return F.coalesce(*(F.when(t.rlike(shape), F.try_to_date(t, f)) for shape, f in DATE_FORMATS.items()))


def fingerprint(*cols: Column) -> Column:
    """A 64-bit hash of several values in which a null is unlike any value and unlike a null in another place."""
    return F.xxhash64(*(x for c in cols for x in (c.isNull(), c)))
