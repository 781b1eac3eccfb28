"""Predicates over register codes and dates, all JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EUID_PATTERN = r"\A[A-Z]{2}[A-Z0-9]{2,8}\.[A-Z0-9]{4,12}\z"
LEI_PATTERN = r"\A[A-Z0-9]{18}[0-9]{2}\z"
BLANK_PATTERN = r"\A\s*\z"
WHITESPACE = " \t\r\n "


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | c.rlike(BLANK_PATTERN)


def lei_remainder(c: Column) -> Column:
    """A=10 … Z=35, the digits read as one number, modulo 97, as a fold over the characters."""
    chars = F.split(c, "")
    return F.aggregate(
        chars,
        F.lit(0),
        lambda acc, ch: F.when(ch == "", acc)
        .when(F.ascii(ch) < 65, (acc * 10 + (F.ascii(ch) - 48)) % 97)
        .otherwise((acc * 100 + (F.ascii(ch) - 55)) % 97),
    )


def is_lei(c: Column) -> Column:
    """18 capitals or digits and two check digits, remainder 1."""
    return F.coalesce(c.rlike(LEI_PATTERN), F.lit(False)) & (
        F.when(c.rlike(LEI_PATTERN), lei_remainder(c)).otherwise(F.lit(0)) == 1
    )


def is_euid(c: Column) -> Column:
    return F.coalesce(c.rlike(EUID_PATTERN), F.lit(False))


def is_iso_date(c: Column) -> Column:
    """A day that exists in the calendar, written YYYY-MM-DD and nothing else."""
    return F.coalesce(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.lit(False)) & F.coalesce(F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def clean_code(c: Column) -> Column:
    """Outer white space off, capitals; null stays null."""
    return F.upper(F.btrim(c, F.lit(WHITESPACE)))
