"""Envelopes, replay, live triage, and files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsift.fixed_values import EXTERNAL_COLUMNS
from flowsift.functions.labels import add_family
from flowsift.operators import artifact, tickets
from flowsift.operators.bounded import shared_dir
from flowsift.plans import bindings as B, jobs, live
from flowsift.plans.registry import query, table
from flowsift.schema import LABELLED_CONNECTION, MODEL_INPUTS
from flowsift.sources import files, manifest, replay
from flowsift.streaming import envelope, run

INPUTS = ["protocol_type", "service", "flag", "src_bytes", "count"]


def _short_record(spark, sf):
    """Events as five-field records in JSON pieces shared by the envelope queries."""
    return B.events(spark, sf).withColumn("n", F.col("event_id") % 9).withColumns(
        {
            "service_json": F.when(F.col("n") == 5, F.lit('["http"]')).otherwise(F.lit('"http"')),
            "count_json": F.when(F.col("n") == 6, F.lit('"abc"')).otherwise(F.col("k").cast("string")),
        }
    )


def _messages(spark, sf):
    rows = _short_record(spark, sf)
    service = F.when(F.col("n") == 4, F.lit("")).otherwise(F.concat(F.lit('"service":'), "service_json", F.lit(",")))
    fields = F.concat(
        F.lit('"protocol_type":"'), "event_type", F.lit('",'), service,
        F.lit('"flag":null,"src_bytes":'), F.col("user_id").cast("string"), F.lit(',"count":'), "count_json",
    )
    ident = F.concat(
        F.lit('"event_id":"e'), F.col("event_id").cast("string"), F.lit('","source_ip":"'), "source_ip", F.lit('",')
    )
    record = F.concat(F.lit("{"), fields, F.lit("}"))
    n = F.col("n")
    value = (
        F.when(n == 1, F.concat(F.lit("{"), ident, F.lit('"record":'), record, F.lit("}")))
        .when(n == 2, F.concat(F.lit("{"), fields, F.lit("}")))
        .when(n == 3, F.concat(F.lit("{"), ident, F.lit('"connection":null,'), fields, F.lit("}")))
        .when(n == 7, F.concat(F.lit("not json "), F.col("event_id").cast("string")))
        .when(n == 8, F.concat(F.lit("{"), ident, F.lit('"connection":[1]}')))
        .otherwise(F.concat(F.lit("{"), ident, F.lit('"source":"sensor","connection":'), record, F.lit("}")))
    )
    return rows.select(F.col("event_id").alias("id"), value.alias("value"))


_PROBLEM = """CASE n WHEN 4 THEN 'missing_fields' WHEN 5 THEN 'nested_fields' WHEN 6 THEN 'invalid_numbers'
  WHEN 7 THEN 'not_json' WHEN 8 THEN 'connection_not_an_object' END"""
_NAMED = "'e' || CAST(event_id AS VARCHAR)"
_FLAT_TEXT = """'{"protocol_type":"' || event_type || '","service":"http","flag":null,"src_bytes":'
  || CAST(user_id AS VARCHAR) || ',"count":' || CAST(k AS VARCHAR) || '}'"""
_E = """e AS (SELECT *, event_id % 9 AS n, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""
_NAME_SQL = f"""CASE n WHEN 2 THEN sha256({_FLAT_TEXT}) WHEN 7 THEN sha256('not json ' || CAST(event_id AS VARCHAR))
  ELSE {_NAMED} END"""


@query(
    "envelope_parse",
    f"""WITH {_E}
SELECT event_id AS id, {_NAME_SQL} AS event_id,
  CASE WHEN n IN (2, 7) THEN 'unknown' ELSE '192.0.2.' || CAST(event_id % 253 + 1 AS VARCHAR) END AS source_ip,
  CASE WHEN n IN (0, 4, 5, 6) THEN 'sensor' ELSE 'kafka' END AS source, {_PROBLEM} AS problem,
  CASE WHEN n < 7 THEN CAST(user_id AS DOUBLE) END AS src_bytes,
  CASE n WHEN 4 THEN 'service' WHEN 7 THEN 'protocol_type,service,flag,src_bytes,count'
   WHEN 8 THEN 'protocol_type,service,flag,src_bytes,count' ELSE '' END AS missing FROM e""",
)
def envelope_parse(spark, sf):
    """Envelope, record and flat forms; null connection; missing, nested, bad and unreadable input."""
    messages = _messages(spark, sf)
    parsed = envelope.parse(messages, inputs=INPUTS, now=F.lit("now"))
    return parsed.select(
        "id", "event_id", "source_ip", "source", "problem",
        F.col("connection.src_bytes").alias("src_bytes"),
        F.array_join("missing_fields", ",").alias("missing"),
    )


@query(
    "json_records",
    f"""WITH {_E} SELECT event_id AS id, CASE WHEN n = 4 THEN 'service' ELSE '' END AS missing,
  CASE WHEN n = 5 THEN 'service' ELSE '' END AS nested FROM e WHERE n IN (2, 4, 5)
UNION ALL SELECT event_id, '', '' FROM e WHERE n NOT IN (2, 4, 5)""",
)
def json_records(spark, sf):
    """Plain connection objects: which inputs are missing, which are nested."""
    rows = _short_record(spark, sf)
    service = F.when(F.col("n") == 4, F.lit("")).otherwise(F.concat(F.lit('"service":'), "service_json", F.lit(",")))
    text = F.concat(
        F.lit('{"protocol_type":"tcp",'), service, F.lit('"flag":"SF","extra":[1],"src_bytes":1,"count":'),
        "count_json", F.lit("}"),
    )
    read = files.from_json_records(rows.withColumn("text", text), "text", INPUTS)
    return read.select(
        F.col("event_id").alias("id"),
        F.array_join("missing_fields", ",").alias("missing"),
        F.array_join("nested_fields", ",").alias("nested"),
    )


def _replayed(spark, sf):
    rows = B.connections(spark, sf)
    return replay.replay_frame(rows, "event_id", observed_at=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))


@query(
    "replay_frame",
    """SELECT printf('nsl-kdd-%06d', event_id) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS observed_at,
  '192.0.2.' || CAST(event_id % 253 + 1 AS VARCHAR) AS source_ip, 'nsl-kdd-replay' AS source,
  CAST(floor(value * 100) AS BIGINT) AS src_bytes FROM events""",
)
def replay_frame(spark, sf):
    return _replayed(spark, sf).select(
        "event_id", "observed_at", "source_ip", "source", F.col("connection.src_bytes").alias("src_bytes")
    )


@query(
    "replay_range",
    """SELECT printf('nsl-kdd-%06d', event_id) AS event_id FROM events WHERE event_id >= 100 AND event_id < 600""",
)
def replay_range(spark, sf):
    """The operator's start and limit arguments."""
    return replay.replay_frame(B.connections(spark, sf), "event_id", 100, 500).select("event_id")


@query(
    "publish_frame",
    """SELECT printf('nsl-kdd-%06d', event_id) AS key, 'connection,event_id,observed_at,source,source_ip' AS keys,
  CAST(user_id * 7 + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS VARCHAR) AS dst_bytes, 41 AS fields FROM events""",
)
def publish_frame(spark, sf):
    sent = envelope.publish_frame(_replayed(spark, sf))
    return sent.select(
        "key",
        F.array_join(F.json_object_keys("value"), ",").alias("keys"),
        F.get_json_object("value", "$.connection.dst_bytes").alias("dst_bytes"),
        F.size(F.json_object_keys(F.get_json_object("value", "$.connection"))).alias("fields"),
    )


@query(
    "envelope_roundtrip",
    """SELECT printf('nsl-kdd-%06d', event_id) AS event_id, CAST(NULL AS VARCHAR) AS problem,
  CAST(floor(value * 100) AS DOUBLE) AS src_bytes, 'svc_' || CAST(user_id % 11 AS VARCHAR) AS service FROM events""",
)
def envelope_roundtrip(spark, sf):
    parsed = envelope.parse(envelope.publish_frame(_replayed(spark, sf)))
    return parsed.select("event_id", "problem", "connection.src_bytes", "connection.service")


# ---- live triage ------------------------------------------------------------------------------


def _rule_analysis(events):
    """Stands in for the models: a connection with 40 or more counts is an alert."""
    alert = F.col("connection.count") >= 40
    return events.select(
        "event_id",
        "observed_at",
        F.col("observed_at").alias("created_at"),
        "source",
        "source_ip",
        F.when(alert, "dos").otherwise("normal").alias("predicted_class"),
        F.lit(0.9).alias("rf_confidence"),
        F.lit(0.8).alias("fused_confidence"),
        F.when(alert, "random_forest").otherwise("none").alias("alert_reason"),
        F.to_json("connection").alias("raw_record_json"),
        F.lit("{}").alias("evidence_json"),
        F.when(alert, F.concat(F.lit("ticket for "), "source_ip")).alias("ticket_text"),
        F.lit("rule").alias("model_version"),
        alert.alias("fused_anomaly"),
    )


def _streamed(spark, sf, **options) -> str:
    """All messages as text files, a third of them delivered again, run to the end as a stream."""
    folder = shared_dir(spark, "live")
    sent = _messages(spark, sf)
    again = sent.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 0)
    sent.unionAll(again).select("value").repartition(8).write.text(f"{folder}/inbox")
    messages = run.read_json_lines(spark, f"{folder}/inbox", files_per_trigger=3)
    run.run(messages, _rule_analysis, folder, INPUTS, **options).awaitTermination()
    return folder


@query(
    "stream_alerts",
    f"""WITH {_E} SELECT {_NAME_SQL} AS event_id, CASE WHEN n = 2 THEN 'unknown' ELSE
  '192.0.2.' || CAST(event_id % 253 + 1 AS VARCHAR) END AS source_ip,
  CASE WHEN n = 2 THEN 'ticket for unknown' ELSE 'ticket for 192.0.2.' || CAST(event_id % 253 + 1 AS VARCHAR) END AS ticket_text
FROM e WHERE n < 4 AND k >= 40 AND n <> 2
UNION SELECT {_NAME_SQL}, 'unknown', 'ticket for unknown' FROM e WHERE n = 2 AND k >= 40""",
)
def stream_alerts(spark, sf):
    """Alerts only, each event once though a third were delivered twice."""
    stored = tickets.load(spark, f"{_streamed(spark, sf)}/tickets")
    return stored.select("event_id", "source_ip", "ticket_text")


@query(
    "stream_redelivery",
    f"""WITH {_E}, good AS (SELECT k >= 40 AS alert, {_NAME_SQL} AS name FROM e WHERE n < 4)
SELECT count(DISTINCT name) AS processed, count(DISTINCT name) FILTER (alert) AS alerts,
       count(DISTINCT name) FILTER (alert) AS stored FROM good""",
)
def stream_redelivery(spark, sf):
    """A third of the messages arrive again: the stream's state drops them before they are scored."""
    folder = _streamed(spark, sf, redelivery="1 hour")
    return run.summary(spark, folder).select("processed", "alerts", "stored")


@query(
    "replay_stream",
    """SELECT printf('nsl-kdd-%06d', event_id) AS event_id, CAST(floor(value * 100) AS BIGINT) AS src_bytes, CAST(1 AS BIGINT) AS times
FROM events WHERE event_id >= 50 AND event_id < 950""",
)
def replay_stream(spark, sf):
    """Recorded rows as a stream that is stopped in the middle and started again: each row once."""
    folder = shared_dir(spark, "replay")
    for limit in (400, 900):
        sent = replay.replay_stream(B.connections(spark, sf), "event_id", 50, limit, 250)
        sent = sent.select("event_id", F.col("connection.src_bytes").alias("src_bytes"))
        started = sent.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").start()
        started.processAllAvailable()
        started.stop()
    return spark.read.parquet(f"{folder}/rows").groupBy("event_id", "src_bytes").agg(F.count("*").alias("times"))


@query(
    "stream_quarantine",
    f"WITH {_E} SELECT DISTINCT {_NAME_SQL} AS event_id, {_PROBLEM} AS problem FROM e WHERE n >= 4",
)
def stream_quarantine(spark, sf):
    bad = spark.read.parquet(f"{_streamed(spark, sf)}/quarantine")
    return bad.select("event_id", "problem").distinct()


@query(
    "stream_summary",
    f"""WITH {_E}, good AS (SELECT event_id, k >= 40 AS alert, {_NAME_SQL} AS name FROM e WHERE n < 4)
SELECT TRUE AS adds_up, TRUE AS all_processed, count(DISTINCT name) FILTER (alert) AS stored FROM good""",
)
def stream_summary(spark, sf):
    folder = _streamed(spark, sf)
    found = run.summary(spark, folder)
    sent = spark.read.text(f"{folder}/inbox").count()
    bad = spark.read.parquet(f"{folder}/quarantine").count()
    return found.select(
        (F.col("processed") == F.col("alerts") + F.col("normals")).alias("adds_up"),
        (F.col("processed") + F.lit(bad) == F.lit(sent)).alias("all_processed"),
        "stored",
    )


@query(
    "stream_model",
    "SELECT printf('nsl-kdd-%06d', event_id) AS event_id, TRUE AS same_verdict, TRUE AS same_evidence FROM events",
)
def stream_model(spark, sf):
    """A model trained once at the start triages a stream; every event gets the batch job's verdict."""
    folder = shared_dir(spark, "triage")
    rows = B.connections(spark, sf)
    envelope.publish_frame(_replayed(spark, sf)).select("value").repartition(8).write.text(f"{folder}/inbox", compression="gzip")
    messages = run.read_json_lines(spark, f"{folder}/inbox", files_per_trigger=4)
    live.start(messages, folder, training=add_family(rows), row_id="event_id").awaitTermination()
    found = artifact.load(spark, f"{folder}/model")
    batch = jobs.analyze(found, _replayed(spark, sf).select("event_id", "source_ip", "connection.*"))
    pick = ["event_id", "predicted_class", "alert_reason", "evidence_json"]
    digest = F.unhex(F.sha2("evidence_json", 256))  # texts of kilobytes are not shuffled to be compared
    batch = batch.withColumn("evidence_json", digest)
    live_rows = tickets.load(spark, f"{folder}/tickets").withColumn("evidence_json", digest)
    live_rows = live_rows.select(*[F.col(c).alias(f"_{c}") for c in pick])
    both = batch.select(*pick, "fused_anomaly").join(live_rows, F.col("event_id") == F.col("_event_id"), "full")
    same = (F.col("predicted_class") == F.col("_predicted_class")) & (F.col("alert_reason") == F.col("_alert_reason"))
    stored = F.col("_event_id").isNotNull()
    return both.select(
        F.coalesce("event_id", "_event_id").alias("event_id"),
        ((F.col("fused_anomaly") == stored) & (~stored | same)).alias("same_verdict"),
        (~stored | (F.col("evidence_json") == F.col("_evidence_json"))).alias("same_evidence"),
    )


# ---- files ------------------------------------------------------------------------------------

_FAMILY_OF_K = """CASE WHEN k < 40 THEN 'normal' WHEN k < 60 THEN 'dos' WHEN k < 75 THEN 'probe' WHEN k < 90 THEN 'r2l' ELSE 'u2r' END"""


@query(
    "connection_files",
    f"""WITH {_E} SELECT {_FAMILY_OF_K} AS attack_family, 'svc_' || CAST(user_id % 11 AS VARCHAR) AS service, count(*) AS n,
  CAST(sum(floor(value * 100)) AS BIGINT) AS src_bytes, round(avg(k / 100e0), 9) AS serror_rate FROM e GROUP BY 1, 2""",
)
def connection_files(spark, sf):
    """Headerless 43-column files written and read back under the fixed schema."""
    rows = B.connections(spark, sf).withColumn("difficulty", F.lit(21))
    folder = shared_dir(spark, "files")
    rows.select(*LABELLED_CONNECTION.fieldNames()).write.csv(f"{folder}/KDDTrain+.txt")
    pair = files.read_pair(spark, roots=[folder], require_test=False)
    return pair.train.groupBy("attack_family", "service").agg(
        F.count("*").alias("n"),
        F.sum("src_bytes").alias("src_bytes"),
        F.round(F.avg("serror_rate"), 9).alias("serror_rate"),
    )


@query(
    "external_files",
    """SELECT o_orderpriority AS attack_cat, count(*) AS n, round(sum(o_totalprice), 2) AS dur FROM orders GROUP BY 1""",
)
def external_files(spark, sf):
    """Headered external flows with an extra column, read by name."""
    from flowsift.plans.catalog_quality import ORDER_COLUMNS

    orders = table(spark, sf, "orders")
    named = [F.col(ORDER_COLUMNS[c]).alias(x) for c, x in EXTERNAL_COLUMNS.items()]
    folder = shared_dir(spark, "files")
    orders.select(F.lit("x").alias("extra"), *named, F.col("o_orderpriority").alias("attack_cat")).write.option(
        "header", True
    ).csv(folder)
    found = files.read_external(spark, folder)
    return found.groupBy("attack_cat").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("dur").cast("double")), 2).alias("dur")
    )


@query(
    "row_by_id",
    """SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 1""",
)
def row_by_id(spark, sf):
    """The newest event, fetched by its identity."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0]
    return files.row_by_id(events, last, "event_id").select("event_id", "user_id", "value")


@query("manifest_check")
def manifest_check(spark, sf):
    """Digest of every table file; both ways of hashing agree. File contents are not SQL tables."""
    whole = manifest.digests(spark, f"{sf}/*.parquet")
    chunked = manifest.digests(spark, f"{sf}/*.parquet", whole=0)
    expected = chunked.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return manifest.verify(whole, expected).select("name", "sha256", "ok")


@query(
    "file_digests",
    """WITH r AS (SELECT o_custkey % 5 AS p, o_orderkey, CASE WHEN o_custkey % 5 = 3 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s FROM orders)
SELECT CAST(p AS VARCHAR) AS name, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || ',' || s || chr(10), '' ORDER BY o_orderkey)) AS sha256,
       p <> 3 AS ok FROM r GROUP BY p""",
)
def file_digests(spark, sf):
    """Files of orders against the digests of an earlier writing; one has changed since."""
    folder = shared_dir(spark, "digests")
    part = F.col("o_custkey") % 5
    changed = F.when(part == 3, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    for name, status in (("before", F.col("o_orderstatus")), ("after", changed)):
        lines = table(spark, sf, "orders").select(part.alias("p"), "o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), status).alias("value"))
        lines = lines.repartition(5, "p").sortWithinPartitions("p", "o_orderkey").select("p", "value")
        lines.write.partitionBy("p").text(f"{folder}/{name}")
    named = lambda found: found.withColumn("path", F.regexp_extract("path", "/p=([0-9]+)/", 1))
    known = named(manifest.digests(spark, f"{folder}/before/*/*.txt")).select(F.col("path").alias("name"), "sha256")
    now = named(manifest.digests(spark, f"{folder}/after/*/*.txt", whole=0))
    return manifest.verify(now, known).select("name", "sha256", "ok")


@query(
    "metric_files",
    f"""WITH {B.CONN_SQL} SELECT 'holdout' AS protocol, 'rule' AS protocol_text, count(*) AS rows,
  round(avg(CASE WHEN family = pred THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM conn""",
)
def metric_files(spark, sf):
    """Metric tables written per protocol and read back."""
    tables = jobs.report(B.conn(spark, sf), "family", "pred")
    folder = shared_dir(spark, "metrics")
    jobs.write_report(tables, "rule", "holdout", folder)
    found = spark.read.json(f"{folder}/headline")
    return found.select("protocol", "protocol_text", "rows", F.round("accuracy", 9).alias("accuracy"))


@query(
    "payload_file",
    f"""WITH {B.CONN_SQL}, cells AS (SELECT family AS truth, pred AS prediction, count(*) AS n FROM conn GROUP BY 1, 2)
SELECT 'common-feature Random Forest, zero-tuning transfer' AS protocol, 42 AS random_state, 'rule' AS digest,
       (SELECT count(*) FROM conn) AS source_rows, truth, prediction, n FROM cells""",
)
def payload_file(spark, sf):
    """A report with a table in it, written as one JSON text and read back."""
    rows = B.conn(spark, sf)
    cells = rows.groupBy(F.col("family").alias("truth"), F.col("pred").alias("prediction")).agg(F.count("*").alias("n"))
    made = jobs.transfer_payload(spark, {"cells": cells}, {"source_rows": rows.count()}, "rule")
    folder = shared_dir(spark, "payload")
    jobs.write_payload(made, folder)
    schema = "protocol string, random_state int, target_sha256 string, source_rows long, cells array<struct<truth:string,prediction:string,n:long>>"
    back = spark.read.text(folder).select(F.from_json("value", schema).alias("r")).select("r.*")
    return back.select("protocol", "random_state", F.col("target_sha256").alias("digest"), "source_rows", F.inline("cells"))


@query(
    "model_inputs",
    """SELECT event_id, 41 AS inputs FROM events""",
)
def model_inputs(spark, sf):
    """Only the 41 inputs (and the identity) are kept, in order."""
    from flowsift.operators.features import project_inputs

    rows = add_family(B.connections(spark, sf))
    kept = project_inputs(rows, keep=["event_id"])
    return kept.select("event_id", F.size(F.array(*[F.col(c).cast("string") for c in MODEL_INPUTS])).alias("inputs"))
