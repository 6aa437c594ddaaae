"""Readers and writers: delimited text with stated or inspected dialects, Parquet, and prepared versions."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.text import formula_safe
from tallywright.sources.records import records

SEPARATORS = (",", ";", "\t", "|")
ENCODINGS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}
HEAD_BYTES, MOST_COLUMNS = 65_536, 300


def header_names(record: str, sep: str) -> list[str]:
    """Names in a header record: trimmed; an empty one is ``_c`` and its place, one that is met again has its place after it."""
    cells = [c.strip() for c in next(csv.reader(io.StringIO(record, newline=""), delimiter=sep))]
    if len(cells) > MOST_COLUMNS:
        raise ValueError("MAX_COLUMNS_EXCEEDED")
    again = {c for c in cells if cells.count(c) > 1}
    return [f"_c{k}" if not c else f"{c}{k}" if c in again else c for k, c in enumerate(cells)]


# types of a column of text, the narrowest first, with what all of its cells must be
_KINDS = (
    ("int", lambda c: c.rlike(r"^[+-]?[0-9]+$") & c.try_cast("int").isNotNull()),
    ("bigint", lambda c: c.rlike(r"^[+-]?[0-9]+$") & c.try_cast("bigint").isNotNull()),
    ("double", lambda c: c.rlike(r"[0-9]$|^[+-]?(Inf|NaN)$|[.]$") & c.try_cast("double").isNotNull()),
    ("date", lambda c: c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull()),
    ("timestamp", lambda c: c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") & c.try_cast("timestamp").isNotNull()),
    ("boolean", lambda c: F.lower(c).isin("true", "false")),
)


def _inferred(cells: DataFrame) -> list[str]:
    """The narrowest type of each column, from one pass over all cells; text where there are none."""
    checks = [F.coalesce(F.bool_and(fits(F.col(c))), F.lit(False)).alias(f"{c}_{k}") for c in cells.columns for k, (_, fits) in enumerate(_KINDS)]
    told = cells.agg(*checks).first()
    return [next((kind for k, (kind, _) in enumerate(_KINDS) if told[f"{c}_{k}"]), "string") for c in cells.columns]


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", header_row: int = 0, schema: T.StructType | None = None) -> DataFrame:
    """Delimited files. With ``header_row`` = n the first n records of each file are skipped and the next names the columns (those of
    the first file by name); blank lines are no records. Quoted cells may hold line breaks, and a file is read by as many tasks as it
    has splits all the same (see ``records``). Lines end with LF or CRLF.

    Without a schema, types are inferred from all rows where the header comes first; below skipped records every column is text. Over
    ``MOST_COLUMNS`` columns are refused with MAX_COLUMNS_EXCEEDED, a missing header with HEADER_MISSING."""
    if sep not in SEPARATORS or encoding not in ENCODINGS or not 0 <= header_row <= 99:
        raise ValueError("UNSUPPORTED_DIALECT")
    if schema is not None and len(schema) > MOST_COLUMNS:
        raise ValueError("MAX_COLUMNS_EXCEEDED")
    found = records(spark, path, ENCODINGS[encoding], sep)
    body = found.where(F.col("number") > header_row).select("text")

    def parsed(kinds: list[str]) -> DataFrame:
        columns = ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds))
        options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
        return body.select(F.from_csv("text", columns, options).alias("cells")).select("cells.*")

    if schema is not None:
        return parsed([f.dataType.simpleString() for f in schema]).toDF(*schema.names)
    first = found.agg(F.min("file")).first()[0] if header_row else spark.read.text(path).select(F.min("_metadata.file_path")).first()[0]
    head = found.where((F.col("file") == first) & (F.col("number") == header_row)).limit(1).collect() if first else []
    if not head:
        raise ValueError("HEADER_MISSING")
    names = header_names(head[0]["text"], sep)
    text = parsed(["string"] * len(names))
    return (text if header_row else parsed(_inferred(text))).toDF(*names)


def _opened(uri: str):
    """A file for reading, in whatever store pyarrow knows."""
    where, path = pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))
    return where.open_input_stream(path)


def heads(spark: SparkSession, path: str, size: int = HEAD_BYTES, opened: Callable = _opened) -> DataFrame:
    """path, size_bytes, head: the first ``size`` bytes of each file, which is all that is read of it; Spark lists no
    empty files. ``opened`` opens a file in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                with opened(b.column(0)[k].as_py()) as f:
                    yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([f.read(size)], pa.binary())], names=["path", "size_bytes", "head"])

    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))  # no content
    return listed.mapInArrow(read, "path string, size_bytes long, head binary")


def inspect_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, delimiter, size_bytes of each file, from its first 64 KiB: an encoding that decodes, and the separator that
    splits the first lines into equally many parts, most parts first."""
    files = heads(spark, path)
    marked = F.hex(F.substring("head", 1, 3)) == "EFBBBF"
    # a character cut off at the end of the head is no decoding error: some head of up to three bytes less must decode
    shorter = [F.substring("head", 1, HEAD_BYTES - k) for k in range(4)]
    cut = F.length("head") == HEAD_BYTES
    decodes = F.is_valid_utf8(F.col("head").cast("string"))
    for s in shorter[1:]:
        decodes = decodes | (cut & F.is_valid_utf8(s.cast("string")))
    encoding = F.when(marked, "utf-8-sig").when(decodes, "utf-8").otherwise("latin-1")
    lines = F.slice(F.split(F.decode("head", "ISO-8859-1"), "\r?\n"), 1, 20)
    full = F.filter(lines, lambda x: x != "")

    def widths_by(separator: str):
        return F.transform(full, lambda x: F.size(F.split(x, f"[{separator}]")))

    scored = []
    for s in SEPARATORS:
        widths = widths_by(s)
        steady = F.size(F.array_distinct(widths)) == 1
        scored.append(F.struct((steady & (F.array_max(widths) > 1)).alias("steady"), F.coalesce(F.array_min(widths), F.lit(0)).alias("parts"), F.lit(s).alias("sep")))
    best = F.array_max(F.array(*scored))
    return files.select("path", encoding.alias("encoding"), F.when(best["parts"] > 1, best["sep"]).otherwise(",").alias("delimiter"), "size_bytes")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    if options:
        raise ValueError(f"UNKNOWN_OPTIONS: {sorted(options)}")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing, as null is."""
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def write_prepared(prepared, dictionary: DataFrame, quality: DataFrame, path: str, as_csv: bool = False) -> None:
    """Data, quarantine, transformation log, quality comparison and dictionary, each a directory below ``path``."""
    tables = {"data": prepared.data, "quarantine": prepared.quarantine, "transformations": prepared.log, "quality": quality, "dictionary": dictionary}
    for name, df in tables.items():
        if as_csv:
            df.select(*[formula_safe(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]).write.mode("overwrite").csv(f"{path}/{name}", header=True)
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")

