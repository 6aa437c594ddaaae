"""Text expressions: trimming, blanks, category merges, examples, exported text, and the semantic type of column names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what the name of an identifier column looks like
ID_NAME = re.compile(r"(^id$|_id$|^id_|uuid|codigo|code$|numero$|operacion)")


def trim_text(c: Column) -> Column:
    """Unicode white space off both ends (``trim`` alone removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def empty_to_null(c: Column) -> Column:
    return F.when(trim_text(c) != "", c)


def merge_categories(c: Column, mapping: dict[str, str]) -> Column:
    """Exact replacement of values; others stay."""
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def to_text(c: Column) -> Column:
    return c.cast("string")


def safe_example(c: Column, most: int = 120) -> Column:
    """Line breaks to blanks, cut to ``most`` characters."""
    return F.substring(F.translate(to_text(c), "\n\r", "  "), 1, most)


def formula_safe(c: Column, keep_numbers: bool = False) -> Column:
    """A quote before text that a spreadsheet would read as a formula; with ``keep_numbers``, numbers stay as they are."""
    risky = c.rlike(r"^[=+\-@\t\r]")
    if keep_numbers:
        risky = risky & ~c.rlike(r"^[+\-]?\d+([.,]\d+)*$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def slug(name: str) -> str:
    """A column name without accents, lower-cased, other characters as underscores."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", name) if not unicodedata.combining(x)).lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def looks_like_id(name: str) -> bool:
    return bool(ID_NAME.search(slug(name)))
