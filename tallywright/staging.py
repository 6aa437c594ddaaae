"""Tables written between steps, in a folder that the driver and all executors share, and their removal.

A table written by ``materialize`` stays until the ``scope`` around it ends: a DataFrame built on it may be read at any later time. Who
consumes a query's result inside of a scope leaves nothing behind. What Spark has shuffled to write a table goes once it stands::

    with staging.scope(spark):
        queries()["op7_simhash"](spark, folder).write.parquet(result)

Scopes belong to the thread that opened them: queries that run in other threads at the same time keep their tables.
"""

from __future__ import annotations

import posixpath
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, in local mode only, below the machine's temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tallywright-checkpoints"
    return posixpath.join(base, f"tallywright-{uuid.uuid4().hex}")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what ``materialize`` has written inside. Results to be kept are written elsewhere by then."""
    written: list[str] = []
    before = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(before)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in written:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_turn, _writing, _as_set = threading.Lock(), 0, "false"


@contextmanager
def _without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files. The setting is the session's, so the last of several threads sets it back."""
    global _writing, _as_set
    with _turn:
        if not _writing:
            _as_set = spark.conf.get(SHUFFLES_GO, "false")
            spark.conf.set(SHUFFLES_GO, "true")
        _writing += 1
    try:
        yield
    finally:
        with _turn:
            _writing -= 1
            if not _writing:
                spark.conf.set(SHUFFLES_GO, _as_set)


def materialize(df: DataFrame, name: str = "stage", outer: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing. With ``outer``
    it belongs to the scope around the present one."""
    path = posixpath.join(shared_folder(df.sparkSession), name)
    with _without_shuffles(df.sparkSession):
        df.write.parquet(path)
    scopes = _scopes.get()[:-1] if outer else _scopes.get()
    if scopes:
        scopes[-1].append(posixpath.dirname(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
