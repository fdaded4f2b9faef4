"""Spark schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from flowsift.fixed_values import (
    CATEGORICAL,
    CONNECTION_COLUMNS,
    EXTERNAL_CATEGORY,
    EXTERNAL_COLUMNS,
    NOT_MODEL_INPUTS,
)

MODEL_INPUTS = [c for c in CONNECTION_COLUMNS if c not in NOT_MODEL_INPUTS]
NUMERIC = [c for c in MODEL_INPUTS if c not in CATEGORICAL]


def _connection_type(name: str) -> T.DataType:
    if name in CATEGORICAL or name == "label":
        return T.StringType()
    if name == "difficulty":
        return T.IntegerType()
    return T.DoubleType() if name.endswith("_rate") else T.LongType()


LABELLED_CONNECTION = T.StructType(
    [T.StructField(c, _connection_type(c)) for c in CONNECTION_COLUMNS]
)
CONNECTION = T.StructType([T.StructField(c, _connection_type(c)) for c in MODEL_INPUTS])

# Categorical and numeric fields arrive as text so that bad numbers can be told from nulls.
EXTERNAL_FLOW = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*EXTERNAL_COLUMNS.values(), EXTERNAL_CATEGORY]]
)

DRIVER = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("true_value", T.DoubleType()),
        T.StructField("shap_value", T.DoubleType()),
        T.StructField("direction", T.StringType()),
    ]
)

TICKET = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("observed_at", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("predicted_class", T.StringType()),
        T.StructField("rf_confidence", T.DoubleType()),
        T.StructField("fused_confidence", T.DoubleType()),
        T.StructField("alert_reason", T.StringType()),
        T.StructField("raw_record_json", T.StringType()),
        T.StructField("evidence_json", T.StringType()),
        T.StructField("ticket_text", T.StringType()),
        T.StructField("model_version", T.StringType()),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("corrected_class", T.StringType()),
        T.StructField("analyst_notes", T.StringType()),
        T.StructField("reviewed_by", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("observed_at", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("connection", CONNECTION),
    ]
)
