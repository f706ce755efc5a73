"""Stage tables: results that later plans read more than once.

They are written as Parquet under ``spark.checkpoint.dir``, the folder all executors
share (a temporary one only where that is unset under a local master, as in tests): plans
stay small, a lost executor costs a read, and the planner knows their sizes.  A table lives
until the innermost ``scope`` around its writing ends, or else until the interpreter does."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

Table = tuple[SparkSession, str]
_written: list[Table] = []
#: What a table's writing has shuffled is read by nothing else: its files go at the end of the writing, not when the driver collects garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope: ContextVar[list[Table] | None] = ContextVar("scope", default=None)


def folder(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fastenlake-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get()


def kept(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/stage-{uuid.uuid4().hex}"
    own = _scope.get()
    (_written if own is None else own).append((spark, path))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes the stage tables written inside at its end; what reads them must be done by then."""
    own: list[Table] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for table in own:
            _delete(*table)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release() -> None:
    """Deletes the stage tables written so far; no plan over them can run afterwards."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended; its folder goes with it
            return
