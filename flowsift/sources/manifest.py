"""File integrity: SHA-256 of every input file against an expected list."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

WHOLE_FILE_BYTES = 256 * 1024 * 1024
CHUNK_BYTES = 8 * 1024 * 1024


def digests(spark: SparkSession, paths: str | list[str], whole: int = WHOLE_FILE_BYTES) -> DataFrame:
    """``(path, length, sha256)`` per file.

    Files up to ``whole`` bytes are hashed as one value; larger ones are read by a task in chunks,
    so no file has to fit in memory.
    """
    files = spark.read.format("binaryFile").load(paths)
    short = files.where(F.col("length") <= whole).select(
        "path", "length", F.sha2("content", 256).alias("sha256")
    )
    long = files.select("path", "length").where(F.col("length") > whole)
    return short.unionByName(long.repartition("path").mapInPandas(_chunked, short.schema))


def store_uri(path: str) -> str:
    """A file's address for the chunked reader, which knows object stores by their plain scheme."""
    scheme, found, rest = path.partition("://")
    return f"s3://{rest}" if found and scheme in ("s3a", "s3n") else path


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            store, name = fs.FileSystem.from_uri(store_uri(path))
            digest = hashlib.sha256()
            with store.open_input_stream(name) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``(name, sha256, expected, ok)`` for every expected file name; a missing file is not ok."""
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    wanted = expected.select("name", F.lower("sha256").alias("expected"))
    ok = F.coalesce(F.col("sha256") == F.col("expected"), F.lit(False))
    return wanted.join(named, "name", "left").withColumn("ok", ok)


def require(verified: DataFrame) -> None:
    bad = [r["name"] for r in verified.where(~F.col("ok")).select("name").orderBy("name").collect()]
    if bad:
        raise ValueError(f"files missing or changed: {', '.join(bad)}")


# Tasks get this module's functions with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
