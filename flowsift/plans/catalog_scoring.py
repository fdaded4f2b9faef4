"""Labels, calibration, fusion, alert selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.functions import fmt, scoring
from flowsift.functions.labels import family_name, label_id
from flowsift.operators import isolation, profile, rank
from flowsift.plans import bindings as B
from flowsift.plans.registry import query, table
from flowsift.streaming.run import feed_view


def r6(column, name=None):
    return F.round(column, 6).alias(name or column)


@query(
    "alert_rollup",
    f"""WITH {B.SCORED_SQL}
SELECT family, alert_reason, count(*) AS n, round(avg(fused_confidence), 6) AS avg_confidence,
       round(avg(risk), 6) AS avg_risk, round(max(fused_confidence), 6) AS max_confidence
FROM scored GROUP BY family, alert_reason""",
)
def alert_rollup(spark, sf):
    return B.scored(spark, sf).groupBy("family", "alert_reason").agg(
        F.count("*").alias("n"),
        F.round(F.avg("fused_confidence"), 6).alias("avg_confidence"),
        F.round(F.avg("isolation_risk"), 6).alias("avg_risk"),
        F.round(F.max("fused_confidence"), 6).alias("max_confidence"),
    )


@query(
    "family_counts",
    f"""WITH {B.CONN_SQL},
parts AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'train' ELSE 'test' END AS split, family FROM conn)
SELECT split, family, count(*) AS n,
       CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_rows
FROM parts GROUP BY split, family""",
)
def family_counts(spark, sf):
    conn = B.conn(spark, sf)
    early = F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")
    return profile.family_counts({"train": conn.where(early), "test": conn.where(~early)}, "family")


@query("row_counts", "SELECT 'events' AS name, count(*) AS n FROM events")
def row_counts(spark, sf):
    n = profile.row_count(table(spark, sf, "events"))
    return spark.createDataFrame([("events", n)], "name string, n bigint")


@query(
    "label_ids",
    f"""WITH {B.CONN_SQL}
SELECT event_id, family, CAST({B.FAMILY_ID_SQL.format('family')} AS INTEGER) AS label_id FROM conn""",
)
def label_ids(spark, sf):
    return B.conn(spark, sf).select("event_id", "family", label_id(F.col("family")).alias("label_id"))


@query(
    "family_name_fallback",
    f"""WITH {B.CONN_SQL}
SELECT event_id, CASE k % 9 WHEN 0 THEN 'normal' WHEN 1 THEN 'dos' WHEN 2 THEN 'probe' WHEN 3 THEN 'r2l'
  WHEN 4 THEN 'u2r' WHEN 5 THEN 'unknown' ELSE 'class_' || CAST(k % 9 AS VARCHAR) END AS family FROM conn""",
)
def family_name_fallback(spark, sf):
    return B.conn(spark, sf).select("event_id", family_name(F.col("k") % 9).alias("family"))


@query(
    "calibration",
    f"""WITH {B.CONN_SQL}
SELECT round(min(iso_score), 9) AS minimum, round(max(iso_score), 9) AS maximum
FROM conn WHERE family = 'normal'""",
)
def calibration(spark, sf):
    low, high = isolation.calibrate(B.conn(spark, sf).where("family = 'normal'"), "iso_score")
    return spark.createDataFrame([(round(low, 9), round(high, 9))], "minimum double, maximum double")


@query(
    "isolation_risk",
    f"WITH {B.SCORED_SQL} SELECT event_id, round(risk, 6) AS isolation_risk FROM scored",
)
def isolation_risk(spark, sf):
    return B.scored(spark, sf).select("event_id", r6("isolation_risk"))


@query(
    "degenerate_risk",
    f"""WITH {B.CONN_SQL}
SELECT event_id, CASE WHEN iso_score < 0.1e0 THEN 1e0 ELSE 0e0 END AS risk FROM conn""",
)
def degenerate_risk(spark, sf):
    risk = scoring.isolation_risk(F.col("iso_score"), 0.1, 0.1)
    return B.conn(spark, sf).select("event_id", risk.alias("risk"))


@query(
    "fuse",
    f"""WITH {B.SCORED_SQL}
SELECT event_id, rf_anomaly, isolation_anomaly, fused_anomaly,
       round(fused_confidence, 6) AS fused_confidence, alert_reason FROM scored""",
)
def fuse(spark, sf):
    return B.scored(spark, sf).select(
        "event_id", "rf_anomaly", "isolation_anomaly", "fused_anomaly", r6("fused_confidence"), "alert_reason"
    )


@query(
    "alert_reasons",
    f"WITH {B.SCORED_SQL} SELECT alert_reason, count(*) AS n FROM scored GROUP BY alert_reason",
)
def alert_reasons(spark, sf):
    return B.scored(spark, sf).groupBy("alert_reason").agg(F.count("*").alias("n"))


@query(
    "anomaly_probability",
    f"""WITH {B.CONN_SQL}
SELECT event_id, round(least(greatest(1e0 - p_normal, 0e0), 1e0), 6) AS p_anomaly, 1e0 AS p_unseen FROM conn""",
)
def anomaly_probability(spark, sf):
    p = F.col("p_normal")
    return B.conn(spark, sf).select(
        "event_id",
        F.round(scoring.anomaly_probability(p), 6).alias("p_anomaly"),
        scoring.anomaly_probability(p, saw_normal=False).alias("p_unseen"),
    )


@query(
    "first_anomaly",
    f"""WITH {B.SCORED_SQL}
SELECT event_id, alert_reason FROM scored ORDER BY fused_anomaly DESC, event_id LIMIT 1""",
)
def first_anomaly(spark, sf):
    return scoring.select_row(B.scored(spark, sf), "event_id").select("event_id", "alert_reason")


@query(
    "exemplar",
    f"""WITH {B.SCORED_SQL}
SELECT event_id, family, alert_reason FROM scored
ORDER BY CASE WHEN pred = 'dos' AND family = 'dos' THEN 0 WHEN fused_anomaly THEN 1 ELSE 2 END, event_id LIMIT 1""",
)
def exemplar(spark, sf):
    scored = B.scored(spark, sf).withColumn("label_id", label_id(F.col("family")))
    return scoring.select_exemplar(scored, "event_id").select("event_id", "family", "alert_reason")


@query(
    "feed_view",
    f"""WITH {B.SCORED_SQL}
SELECT event_id AS event, source_ip,
       CASE WHEN alert_reason = 'isolation_forest' THEN 'anomaly' ELSE pred END AS class,
       round(fused_confidence, 6) AS confidence,
       CASE WHEN fused_anomaly THEN 'alert' ELSE 'normal' END AS verdict FROM scored""",
)
def feed(spark, sf):
    from flowsift.functions import evidence

    feed = feed_view(evidence.build(B.scored(spark, sf), B.THRESHOLD, "rule"))
    return feed.withColumn("confidence", F.round("confidence", 6))


@query(
    "exact_quantile",
    """SELECT round(quantile_cont(value, 0.05), 9) AS q05, round(quantile_cont(value, 0.5), 9) AS q50,
       round(quantile_cont(value, 0.999), 9) AS q999 FROM events""",
)
def exact_quantile(spark, sf):
    events = table(spark, sf, "events")
    found = [round(rank.exact_quantile(events, "value", q), 9) for q in (0.05, 0.5, 0.999)]
    return spark.createDataFrame([tuple(found)], "q05 double, q50 double, q999 double")


@query(
    "number_texts",
    f"""WITH {B.SCORED_SQL}
SELECT event_id, printf('%.1f%%', risk * 100e0) AS risk, printf('%.1f%%', p_normal * 100e0) AS p_normal,
       format('{{:.6g}}', iso_score) AS score, CAST(value AS VARCHAR) AS value FROM scored""",
)
def number_texts(spark, sf):
    return B.scored(spark, sf).select(
        "event_id",
        fmt.percent(F.col("isolation_risk")).alias("risk"),
        fmt.percent(F.col("p_normal")).alias("p_normal"),
        fmt.metric(F.col("iso_score")).alias("score"),
        fmt.shortest(F.col("value")).alias("value"),
    )
