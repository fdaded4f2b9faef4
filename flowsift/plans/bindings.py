"""The test tables seen as connection triage data, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.functions import scoring
from flowsift.functions.labels import add_family, label_id
from flowsift.operators import isolation
from flowsift.plans.registry import table
from flowsift.schema import CONNECTION

# event types as fine labels; "purchase" stays out on purpose and becomes "unknown"
EVENT_FAMILIES = {"normal": ["view"], "dos": ["click"], "probe": ["error"], "r2l": ["signup"]}
THRESHOLD = 0.7


def k_of(props: Column) -> Column:
    return F.from_json(props, "k int")["k"]


def events(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events")
    return raw.withColumn("k", k_of(F.col("props"))).withColumn(
        "source_ip", F.concat(F.lit("192.0.2."), (F.col("event_id") % 253 + 1).cast("string"))
    )


def conn(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a true family and a rule in place of the trained models' outputs."""
    k = F.col("k")
    pred = (
        F.when(k < 40, "normal").when(k < 60, "dos").when(k < 75, "probe").when(k < 90, "r2l").otherwise("u2r")
    )
    shaped = events(spark, sf).withColumnRenamed("event_type", "label").withColumns(
        {"pred": pred, "p_normal": 1 - k / F.lit(100.0), "iso_score": 0.2 - F.col("value") / F.lit(500.0)}
    )
    return add_family(shaped, "label", "family", EVENT_FAMILIES)


CONN_SQL = """
conn AS (
  SELECT event_id, ts, user_id, event_type AS label, value, k,
         '192.0.2.' || CAST(event_id % 253 + 1 AS VARCHAR) AS source_ip,
         CASE event_type WHEN 'view' THEN 'normal' WHEN 'click' THEN 'dos' WHEN 'error' THEN 'probe'
                         WHEN 'signup' THEN 'r2l' ELSE 'unknown' END AS family,
         CASE WHEN k < 40 THEN 'normal' WHEN k < 60 THEN 'dos' WHEN k < 75 THEN 'probe'
              WHEN k < 90 THEN 'r2l' ELSE 'u2r' END AS pred,
         1e0 - k / 100e0 AS p_normal, 0.2e0 - value / 500e0 AS iso_score
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""

FAMILY_ID_SQL = """CASE {0} WHEN 'normal' THEN 0 WHEN 'dos' THEN 1 WHEN 'probe' THEN 2
 WHEN 'r2l' THEN 3 WHEN 'u2r' THEN 4 ELSE 5 END"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """``conn`` with calibrated risk, fused verdict and alert reason."""
    base = conn(spark, sf)
    low, high = isolation.calibrate(base.where(F.col("family") == "normal"), "iso_score")
    ready = base.withColumns(
        {
            "rf_prediction": label_id(F.col("pred")),
            "rf_confidence": F.greatest("p_normal", 1 - F.col("p_normal")),
            "rf_anomaly_confidence": scoring.anomaly_probability(F.col("p_normal")),
            "isolation_score": F.col("iso_score"),
            "isolation_risk": scoring.isolation_risk(F.col("iso_score"), low, high),
        }
    )
    return scoring.fuse(ready, threshold=THRESHOLD)


SCORED_SQL = (
    CONN_SQL
    + """,
bounds AS (SELECT min(iso_score) AS lo, max(iso_score) AS hi FROM conn WHERE family = 'normal'),
risked AS (
  SELECT conn.*, least(greatest((hi - iso_score) / (hi - lo), 0e0), 1e0) AS risk,
         least(greatest(1e0 - p_normal, 0e0), 1e0) AS p_anomaly,
         greatest(p_normal, 1e0 - p_normal) AS rf_confidence
  FROM conn, bounds
),
scored AS (
  SELECT *, pred <> 'normal' AS rf_anomaly, risk >= 0.7e0 AS isolation_anomaly,
         (pred <> 'normal' OR risk >= 0.7e0) AS fused_anomaly,
         least(greatest(0.6e0 * p_anomaly + 0.4e0 * risk, 0e0), 1e0) AS fused_confidence,
         CASE WHEN pred <> 'normal' AND risk >= 0.7e0 THEN 'both' WHEN pred <> 'normal' THEN 'random_forest'
              WHEN risk >= 0.7e0 THEN 'isolation_forest' ELSE 'none' END AS alert_reason
  FROM risked
)"""
)


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """Events as full 41-field connection records with a label, for the real models."""
    e = events(spark, sf)
    k, value, user = F.col("k"), F.col("value"), F.col("user_id")
    special = {
        "protocol_type": F.element_at(F.array(*map(F.lit, ["tcp", "udp", "icmp"])), (k % 3 + 1).cast("int")),
        "service": F.concat(F.lit("svc_"), (user % 11).cast("string")),
        "flag": F.when(k < 50, "SF").when(k < 80, "S0").otherwise("REJ"),
        "duration": F.floor(value / 10),
        "src_bytes": F.floor(value * 100),
        "dst_bytes": user * 7 + k,
        "count": k,
        "srv_count": F.floor(k / 2),
        "dst_host_count": user,
        "logged_in": (k < 40).cast("long"),
        "serror_rate": k / F.lit(100.0),
        "rerror_rate": 1 - k / F.lit(100.0),
        "same_srv_rate": (user % 10) / F.lit(10.0),
    }
    columns = []
    for field in CONNECTION.fields:
        value_of = special.get(field.name, F.lit(0))
        columns.append(value_of.cast(field.dataType).alias(field.name))
    family = F.when(k < 40, "normal").when(k < 60, "neptune").when(k < 75, "satan").when(k < 90, "guess_passwd")
    return e.select(
        "event_id", "ts", "source_ip", *columns, family.otherwise("rootkit").alias("label")
    )


