"""Shared tables, Arrow batches and module shipping for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared place that ``spark.checkpoint.dir`` names.

    Only a session on this machine alone, as in tests, gets a local one where that is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = f"file://{tempfile.gettempdir()}/flowsift"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder: made once, and later reads survive lost executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_value(module: str) -> None:
    """Executors get this module with the functions that use it, and need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: rows of a batch between Spark and Python: whole texts are held several times over on both sides
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches of at most BATCH_ROWS rows."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Memory that this process has freed goes back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def on_batches(function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]):
    """A function for ``mapInArrow`` from one on a batch; batches without rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                yield from [made] if isinstance(made, pa.RecordBatch) else made
                del made, batch
        give_back()

    return run


def text_batches(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about ``most`` characters: (first row, texts), null texts as empty."""
    first, texts, size = 0, [], 0
    for row, text in enumerate(batch.column(column).to_pylist()):
        texts.append(text or "")
        size += len(texts[-1])
        if size >= most:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


by_value(__name__)
