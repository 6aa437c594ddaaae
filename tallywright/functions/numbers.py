"""Localised numbers: decimal and thousands marks, percent and currency; and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import trim_text

# fixed values: markers of each currency, longest first
CURRENCIES = {"PEN": ("S/", "PEN"), "USD": ("US$", "USD", "$"), "EUR": ("€", "EUR")}


def strip_currency(c: Column, currency: str | None) -> Column:
    for marker in CURRENCIES.get(currency or "", ()):
        c = F.replace(c, F.lit(marker), F.lit(""))
    return c


def has_currency(c: Column, currency: str) -> Column:
    """Whether the text carries a marker of the currency (``US$`` is no sign of another dollar)."""
    found = F.lit(False)
    for marker in CURRENCIES[currency]:
        found = found | F.contains(c, F.lit(marker))
    return found


def parse_number(c: Column, decimal: str = ".", thousands: str | None = None, percent: bool = False, currency: str | None = None) -> Column:
    """Struct (value double, invalid boolean) of localised text: null is valid, a missing or unexpected percent sign is not."""
    text = trim_text(c)
    text = trim_text(strip_currency(text, currency))
    signed = F.endswith(text, F.lit("%"))
    body = F.when(signed, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    body = trim_text(F.translate(body, " ", " "))
    if thousands:
        body = F.replace(body, F.lit(thousands), F.lit(""))
    if decimal != ".":
        body = F.replace(body, F.lit(decimal), F.lit("."))
    value = F.when(body.rlike(r"^[0-9+\-.eE]+$") & (signed == F.lit(percent)), body.try_cast("double"))
    if percent:
        value = value / 100
    return F.struct(value.alias("value"), (c.isNotNull() & value.isNull()).alias("invalid"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def as_number(c: Column) -> Column:
    """Any column as a finite double, or null."""
    return finite(c.try_cast("double"))
