"""What the training-data operators share: inputs, shared-folder tables, splits.

Intermediate results that must outlive a lost executor are written as Parquet
under ``spark.checkpoint.dir`` (the folder all executors share).  The setting is
read from the session; only where it is unset and the master is local (tests, a
laptop) a temporary folder is made for the checkpoint directory.  Tables a lazy result
still reads stay until the interpreter exits; whoever has written that result may
``forget`` them before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fastenlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder (one folder for each value of column `by`) and
    read it back; cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stored() tables that no later plan reads."""
    files = [f for t in tables for f in t.inputFiles()]
    _drop([x for x in _written if any(f"/{x[1].rsplit('/', 1)[-1]}/" in f for f in files)])


def stored_alone(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """stored(build()); what build() stored itself is deleted, since its result is written."""
    known = len(_written)
    out = stored(build(), label)
    _drop(_written[known:-1])
    return out


def _drop(items: list[tuple[SparkSession, str]]) -> None:
    for item in items:
        _delete(*item)
        _written.remove(item)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; its folder is then the caller's to drop
            return


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


#: Rows of an Arrow batch: texts can be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on Python operators of this session get BATCH_ROWS rows at once at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(int(spark.conf.get(key, "10000")) or BATCH_ROWS, BATCH_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, for operators that take it in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
