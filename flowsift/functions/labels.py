"""Class taxonomy lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.fixed_values import FAMILIES, FAMILY_LABELS


def family_dim(spark: SparkSession, mapping: dict[str, list[str]] = FAMILY_LABELS) -> DataFrame:
    """``(label, family)``: one row per known label (at most a few dozen, safe to broadcast)."""
    pairs = [(label, family) for family, labels in mapping.items() for label in labels]
    labels, families = zip(*pairs)
    return spark.createDataFrame(pa.table({"label": labels, "family": families}))


def add_family(
    df: DataFrame,
    label: str = "label",
    out: str = "attack_family",
    mapping: dict[str, list[str]] = FAMILY_LABELS,
) -> DataFrame:
    """Exact, case-sensitive label lookup; misses and nulls become ``unknown``."""
    dim = family_dim(df.sparkSession, mapping).select(
        F.col("label").alias("_label"), F.col("family").alias("_family")
    )
    joined = df.join(F.broadcast(dim), df[label] == dim["_label"], "left")
    return joined.withColumn(out, F.coalesce("_family", F.lit("unknown"))).drop("_label", "_family")


def label_id(family: Column, families: list[str] = FAMILIES, strict: bool = True) -> Column:
    """Position of the family name; an unknown name stops the job when ``strict``."""
    position = F.array_position(F.array(*map(F.lit, families)), family)
    found = F.when(position > 0, (position - 1).cast("int"))
    if not strict:
        return found
    failure = F.raise_error(F.concat(F.lit("no label id for family "), F.coalesce(family, F.lit("NULL"))))
    return F.coalesce(found, failure.cast("int"))


def family_name(class_id: Column) -> Column:
    """Family of a label id, or ``class_<id>`` outside the taxonomy."""
    known = (class_id >= 0) & (class_id < len(FAMILIES))
    name = F.get(F.array(*map(F.lit, FAMILIES)), class_id.cast("int"))
    return F.when(known, name).otherwise(F.concat(F.lit("class_"), class_id.cast("string")))
