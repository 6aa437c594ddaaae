"""Dates from text in stated orders, serial dates, and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import trim_text

# fixed values: patterns of each order, with and without a time of day
PATTERNS = {
    "DMY": ("d/M/yyyy", "d-M-yyyy", "d/M/yyyy HH:mm:ss", "d-M-yyyy HH:mm:ss"),
    "MDY": ("M/d/yyyy", "M-d-yyyy", "M/d/yyyy HH:mm:ss", "M-d-yyyy HH:mm:ss"),
    "YMD": ("yyyy-M-d", "yyyy/M/d", "yyyy-M-d HH:mm:ss", "yyyy/M/d HH:mm:ss", "yyyy-M-d'T'HH:mm:ss"),
}
LAST_SERIAL = 2_958_465


def _parse(text: Column, order: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in PATTERNS[order]]).cast("date")


def parse_date(c: Column, order: str) -> Column:
    """Struct (value date, invalid). ``UNAMBIGUOUS`` takes ISO dates and those of two orders where one part is over 12."""
    text = trim_text(c)
    if order == "UNAMBIGUOUS":
        shape = r"^(\d{1,2})[-/](\d{1,2})[-/]\d{4}"
        first = F.regexp_extract(text, shape, 1).try_cast("int")
        second = F.regexp_extract(text, shape, 2).try_cast("int")
        value = F.when(text.rlike(r"^\d{4}"), _parse(text, "YMD")).when(first > 12, _parse(text, "DMY")).when(second > 12, _parse(text, "MDY"))
    else:
        value = _parse(text, order)
    return F.struct(value.alias("value"), (c.isNotNull() & value.isNull()).alias("invalid"))


def serial_date(c: Column) -> Column:
    """A spreadsheet's day number (1 to 2,958,465 from 1899-12-30) as a date; the fraction of a day is dropped."""
    day = F.floor(c.try_cast("double"))
    return F.when((day >= 1) & (day <= LAST_SERIAL), F.date_add(F.lit("1899-12-30").cast("date"), day.cast("int")))


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_id(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
