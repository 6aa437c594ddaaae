"""Seeds, row blocks and table digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_seed(*parts: Column) -> Column:
    """31 bits of the SHA-256 of the parts joined by colons."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def seed_of(*parts: object) -> int:
    """The same seed on the driver."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:4], "big") & 0x7FFFFFFF


def row_text(*columns: Column) -> Column:
    """A row's cells in order as one text. Each stands with its length before it, a null as a dash, so no two different rows are written
    alike."""
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (c.cast("string") for c in columns)])


def row_block(*columns: Column) -> Column:
    """SHA-256 of a row's cells in order. Equal rows are one block."""
    return F.sha2(row_text(*columns), 256)


def row_mark(*columns: Column) -> Column:
    """A 128-bit hash of a row's cells, nulls told from everything else: what groups equal rows without shuffling them."""
    nulls = F.concat(F.lit("n"), *[F.isnull(c).cast("int").cast("string") for c in columns])
    return F.struct(*[F.xxhash64(F.lit(seed), nulls, *columns).alias(f"h{seed}") for seed in (1, 2)])


def canonical_hash(document: object) -> str:
    """SHA-256 of a small document as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def table_digest(df: DataFrame, position: str | None = None) -> DataFrame:
    """One row (rows, digest): sums of two halves, of 60 bits each, of the rows' SHA-256. Where a null stands and how often a row is there
    changes it. Without ``position`` the order of rows does not; with it, the name of a column of positions (``operators.tables.numbered``
    makes one in any order wanted), each row is hashed with its place, so order counts too. Partitions sum by themselves."""
    cells = row_text(*[F.col(f"`{c}`") for c in df.columns if c != position])
    text = cells if position is None else F.concat(F.col(f"`{position}`").cast("string"), F.lit("|"), cells)
    halves = df.select(F.sha2(text, 256).alias("h")).select(*[F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)").alias(f"h{at}") for at in (1, 16)])
    return halves.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[F.coalesce(F.sum(f"h{at}"), F.lit(0)).cast("decimal(38,0)").cast("string") for at in (1, 16)]).alias("digest"))
