"""Calibration, fusion and alert rules as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.fixed_values import (
    FAMILIES,
    FLAT_SPAN,
    ISOLATION_SHARE,
    ISOLATION_THRESHOLD,
    SUPERVISED_SHARE,
)
from flowsift.functions.validate import unit_interval

NORMAL = FAMILIES.index("normal")


def clip01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def _finite_or_fail(col: Column, what: str) -> Column:
    ok = ~F.isnan(col) & (F.abs(col) < float("inf"))
    return F.when(ok, col).otherwise(F.raise_error(F.lit(f"{what} must all be finite")).cast("double"))


def isolation_risk(score: Column, minimum: Column | float, maximum: Column | float) -> Column:
    """Raw decision score (low = anomalous) mapped to [0, 1] by fixed training bounds.

    Bounds may be numbers (checked here) or columns of a calibration row (checked per row).
    """
    if not isinstance(minimum, Column) and not isinstance(maximum, Column):
        if not (float("-inf") < minimum <= maximum < float("inf")):
            raise ValueError("isolation calibration bounds are invalid")
        minimum, maximum = F.lit(float(minimum)), F.lit(float(maximum))
    score = _finite_or_fail(score.cast("double"), "isolation scores")
    span = maximum - minimum
    flat = F.when(score < minimum, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.abs(span) <= FLAT_SPAN, flat).otherwise(clip01((maximum - score) / span))


def anomaly_probability(p_normal: Column, saw_normal: bool = True) -> Column:
    """P(any class but normal); certain for a model that never saw a normal row."""
    return clip01(F.lit(1.0) - p_normal) if saw_normal else F.lit(1.0)


def alert_reason(rf_anomaly: Column, isolation_anomaly: Column) -> Column:
    return (
        F.when(rf_anomaly & isolation_anomaly, F.lit("both"))
        .when(rf_anomaly, F.lit("random_forest"))
        .when(isolation_anomaly, F.lit("isolation_forest"))
        .otherwise(F.lit("none"))
    )


def fuse(
    df: DataFrame,
    prediction: str = "rf_prediction",
    anomaly_confidence: str = "rf_anomaly_confidence",
    risk: str = "isolation_risk",
    threshold: float = ISOLATION_THRESHOLD,
) -> DataFrame:
    """Adds both detector flags, the fused flag and confidence, and the alert reason."""
    threshold = unit_interval(threshold, "isolation threshold")
    rf = F.col(prediction) != NORMAL
    iso = F.col(risk) >= threshold
    confidence = clip01(SUPERVISED_SHARE * F.col(anomaly_confidence) + ISOLATION_SHARE * F.col(risk))
    return df.withColumns(
        {
            "rf_anomaly": rf,
            "isolation_anomaly": iso,
            "fused_anomaly": rf | iso,
            "fused_confidence": confidence,
            "alert_reason": alert_reason(rf, iso),
        }
    )


def select_row(df: DataFrame, row_id: str, wanted: int | None = None) -> DataFrame:
    """The wanted row, else the first fused alert, else the first row.

    Ordering by a flag and taking one row is a top-1, not a sort of the table.
    """
    if wanted is not None:
        picked = df.where(F.col(row_id) == wanted)
        if wanted < 0 or picked.isEmpty():
            raise IndexError(f"row {wanted} is outside the scored table")
        return picked
    return df.orderBy(F.col("fused_anomaly").desc(), row_id).limit(1)


def select_exemplar(df: DataFrame, row_id: str, truth: str = "label_id") -> DataFrame:
    """First correctly found denial-of-service row, else first fused alert, else first row."""
    dos = FAMILIES.index("dos")
    hit = (F.col("rf_prediction") == dos) & (F.col(truth) == dos)
    priority = F.when(hit, 0).when(F.col("fused_anomaly"), 1).otherwise(2)
    return df.orderBy(priority, row_id).limit(1)
