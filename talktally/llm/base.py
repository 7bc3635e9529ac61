"""What the operators of this subpackage share.

Rows that agree in doc_id and text are one document to every operator: they get one and the
same result. Columns an operator does not name are never read, so they may have any name.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The white space between words: space and the controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of a batch on its way to a Python worker, unless the session says otherwise; 10,000 long texts would be many times that.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

# Whether the shuffle files of a query go when it ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared scratch folder and read back: computed once, and safe from lost executors.

    What was shuffled for it is not needed any more and is removed at once, not when the driver happens to collect its garbage.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP_CONF) if before is None else conf.set(CLEANUP_CONF, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run, fields) -> DataFrame:
    """`df.mapInArrow`, with this package on the path of Python workers that share the driver's disk.

    Batches are bounded by bytes as well as by rows. Workers outlive their tasks; before and after each one, memory that is
    free is given back to the machine.
    """
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    conf = df.sparkSession.conf
    conf.set(BATCH_CONF, conf.get(BATCH_CONF, str(BATCH_BYTES)))

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return df.mapInArrow(run_and_release, fields)


def release() -> None:
    """Give free memory back: Arrow's pool, and the C library's heap where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between tasks; workers are reused, so only the last operator's is kept."""
    if name not in _held:
        _held.clear()
        release()
        _held[name] = make()
    return _held[name]


def word_array(text: str | Column) -> Column:
    """The words of a text; of null, none."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), GAP), "")


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each, so memory does not follow the batch size."""
    for batch in batches:
        size = batch.column(text).nbytes
        rows = batch.num_rows
        step = max(1, int(rows * most / size)) if size > most else max(rows, 1)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; of null, an empty one."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
