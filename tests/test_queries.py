"""Registered queries against their SQL on the smallest tables, and plan properties."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
# the driver checks these too; they train models and take tens of seconds each
SLOW = {"analysis_rejects", "analysis_verdicts", "retrain_report", "stream_model", "stream_quarantine", "transfer_benchmark"}
ORACLES = entry_point.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not available")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_its_sql(spark, con, name):
    verdict = compare(entry_point.queries()[name](spark, SF), ORACLES[name], con)
    assert verdict.startswith("ok"), verdict


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_point.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns_and_push_filters(spark):
    from flowsift.sources.files import row_by_id

    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = _plan(row_by_id(events, 5, "event_id").select("event_id", "value"))
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,5)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_row_selection_is_a_top_n_and_marking_rows_shuffles_nothing(spark):
    from pyspark.sql import functions as F

    from flowsift.functions.scoring import select_row
    from flowsift.operators.rank import mark_first, row_hash
    from flowsift.plans import bindings

    assert "TakeOrderedAndProject" in _plan(select_row(bindings.scored(spark, SF), "event_id"))
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("h", row_hash(F.col("o_orderkey")))
    quotas = spark.createDataFrame([("5-LOW", 3)], "o_orderpriority string, quota long")
    marked = _plan(mark_first(orders, ["o_orderpriority"], "h", quotas, "first"))
    assert "Exchange hashpartitioning" not in marked and "BroadcastHashJoin" in marked


def test_top_three_per_service_is_limited_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from flowsift.operators.enrich import recent_cves

    cves = spark.createDataFrame([], "id string, published string, keywords array<string>, descriptions array<struct<lang:string,value:string>>")
    services = spark.createDataFrame([("http",)], "service string")
    plan = recent_cves(services, cves.repartition(2), "service", F.lit("2026-01-01").cast("timestamp"))
    assert "WindowGroupLimit" in plan._jdf.queryExecution().sparkPlan().toString()
