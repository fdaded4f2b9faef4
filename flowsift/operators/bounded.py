"""Keeping joins safe at any size: checked broadcasts, salted joins, a shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_SMALL_ROWS = 20_000
MAX_SMALL_BYTES = 16 * 1024 * 1024
SALTS = 64


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names storage every executor sees. Only where it is unset, as in
    tests, is a local folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows as a table in the shared folder: worked out once, and safe from lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """The rows spread evenly over the tasks by a hash of the ``key`` columns, however they are laid out.

    For steps that cost far more per row than a shuffle of it: a table of one file that can't be
    split would be one task. The number of tasks is fixed, as small tables would be merged again.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64(*[F.col(c) for c in key]))


def small(df: DataFrame, max_rows: int = MAX_SMALL_ROWS, max_bytes: int = MAX_SMALL_BYTES) -> tuple[DataFrame, bool]:
    """``(table, True)`` when the table is proven to have at most ``max_rows`` rows and ``max_bytes``.

    The rows are worked out once and kept: they are measured where they are, and only a proven
    table comes to the driver, as local rows whose size the planner knows. A bigger one comes
    back as the kept rows, so the join that follows doesn't work them out again.
    """
    ours = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    kept = df.persist() if ours else df
    width = F.octet_length(F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string") for c in df.columns])))
    rows, size = kept.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows > max_rows or size > max_bytes:
        return kept, False
    local = kept.toArrow()
    if ours:
        kept.unpersist()
    return df.sparkSession.createDataFrame(local, df.schema), True


def join_small(
    big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", max_rows: int = MAX_SMALL_ROWS
) -> DataFrame:
    """Null-safe join with a table expected to be small: broadcast when proven, shuffled otherwise."""
    side, proven = small(side, max_rows)
    names = {c: f"_r_{c}" for c in on}
    right = side.withColumnsRenamed(names)
    matched = None
    for left_name, right_name in names.items():
        term = big[left_name].eqNullSafe(right[right_name])
        matched = term if matched is None else matched & term
    right = F.broadcast(right) if proven else right
    return big.join(right, matched, how).drop(*names.values())


def hot_share(spark: SparkSession) -> float:
    """A key is hot from half of a shuffle partition's even share on (0.05 % at the least, so the
    list of hot keys stays short)."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(0.5 / partitions, 0.0005), 0.02)


def hot_keys(df: DataFrame, key: str, share: float | None = None) -> list:
    """Every key holding at least ``share`` of the rows (and possibly some more).

    A frequent-items sketch: one pass, no shuffle of rows, at most ``1/share`` keys come back.
    """
    share = hot_share(df.sparkSession) if share is None else share
    found = df.select(key).where(F.col(key).isNotNull()).freqItems([key], share).first()
    return list(found[0] or []) if found else []


def salted_left_join(
    left: DataFrame, right: DataFrame, key: str, row_id: list[str | Column], salts: int = SALTS
) -> DataFrame:
    """Left join on one key with ``right`` unique per key, safe for keys holding much of ``left``.

    Rows of hot keys are spread by a hash of ``row_id`` (deterministic, so a retried task sends
    each row the same way); only the few hot rows of ``right`` are repeated. Rows without a key
    match nothing and are spread over all tasks, however many they are.
    """
    right, proven = small(right)
    if proven:
        return left.join(F.broadcast(right), key, "left")
    hot = hot_keys(left, key)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    row = F.xxhash64(*row_id)
    one = F.lit(0).cast("bigint")
    salt = F.when(F.col(key).isNull(), row).when(is_hot, F.pmod(row, F.lit(salts))).otherwise(one)
    copies = F.when(is_hot, F.sequence(one, F.lit(salts - 1).cast("bigint"))).otherwise(F.array(one))
    right = right.withColumn("_salt", F.explode(copies))
    return left.withColumn("_salt", salt).join(right, [key, "_salt"], "left").drop("_salt")
