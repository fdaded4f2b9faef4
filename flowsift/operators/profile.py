"""Row and class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def row_count(df: DataFrame) -> int:
    return df.count()


def family_counts(splits: dict[str, DataFrame], family: str = "attack_family") -> DataFrame:
    """``(split, family, n, split_rows)`` sorted by split and family."""
    parts = [
        df.groupBy(F.lit(split).alias("split"), F.col(family).alias("family")).agg(
            F.count("*").alias("n")
        )
        for split, df in splits.items()
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    totals = counts.groupBy("split").agg(F.sum("n").alias("split_rows"))
    return counts.join(F.broadcast(totals), "split").orderBy("split", "family")
