"""Scalar expressions on numbers, times and permissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakekeep.functions.paths import as_column

# Age limits in days.
HOT_DAYS = 30
WARM_DAYS = 180

# Declared kinds of a metric field.
LONG, DOUBLE, PERCENTAGE_STRING = "LONG", "DOUBLE", "PERCENTAGE_STRING"

MINUTE = "yyyy-MM-dd HH:mm"


def percent(text: Column | str) -> Column:
    """`' 12.34% '` -> 0.1234; text that is no percentage gives null.

    The shift by two places is made in the decimal text, so the double is the
    one nearest to the exact quotient.
    """
    digits = F.replace(F.trim(as_column(text)), F.lit("%"), F.lit(""))
    return F.concat(digits, F.lit("E-2")).try_cast("double")


def typed_value(text: Column | str, kind: str) -> Column:
    """Number of a declared kind from JSON text, as double."""
    text = as_column(text)
    if kind == LONG:
        whole = text.try_cast("decimal(38,6)").try_cast("bigint")
        return F.coalesce(text.try_cast("bigint"), whole).cast("double")
    if kind == DOUBLE:
        return text.try_cast("double")
    if kind == PERCENTAGE_STRING:
        return percent(text)
    raise ValueError(f"unknown value kind: {kind}")


def day_stamp(ts: Column | str, fmt: str = "yyyyMMdd") -> Column:
    return F.date_format(as_column(ts), fmt)


def minute_stamp(ts: Column | str) -> Column:
    """Time as a listing prints it."""
    return F.date_format(as_column(ts), MINUTE)


def year_of(ts: Column | str) -> Column:
    return F.lpad(F.year(as_column(ts)).cast("string"), 4, "0")


def known_atime(atime: Column | str) -> Column:
    """A missing access time counts as the epoch."""
    return F.coalesce(as_column(atime), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def temperature(atime: Column | str, as_of: Column | str) -> Column:
    """HOT up to 30 days of age, WARM up to 180, else COLD; both limits inclusive.

    `as_of` is literal text such as `2024-01-31 00:00:00`, or a column.
    """
    as_of = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    atime = known_atime(atime)
    return (
        F.when(atime >= as_of - F.expr(f"interval {HOT_DAYS} days"), F.lit("HOT"))
        .when(atime >= as_of - F.expr(f"interval {WARM_DAYS} days"), F.lit("WARM"))
        .otherwise(F.lit("COLD"))
    )


def mode_of(permission: Column | str) -> Column:
    """Octal text of a ten-character symbolic permission, with or without the mark `+` of an access list.

    Everything else gives null.
    """
    permission = F.regexp_replace(as_column(permission), r"^(.{10})\+$", "$1")
    # Set bits as binary digits; S and T are special bits without execute.
    bits = F.translate(F.substring(permission, 2, 9), "-STrwxst", "00011111")
    sticky = F.when(F.substring(permission, 10, 1).isin("t", "T"), "1").otherwise("")
    return F.when(permission.rlike("^[-dlbcps][-rwxstST]{9}$"), F.conv(F.concat(sticky, bits), 2, 8))
