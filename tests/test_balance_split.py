import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import balance, bounded, rank, split


def _frame(spark, counts):
    rows, i = [], 0
    for label, n in counts.items():
        for _ in range(n):
            rows.append((i, label, 3_000_000_000_000 - i, i % 2))
            i += 1
    return spark.createDataFrame(rows, "row_id long, label string, src_bytes long, land long")


def test_oversampling_repeats_exact_rows_only(spark):
    df = _frame(spark, {"normal": 6, "neptune": 3})
    out = balance.oversample(df, "label", "row_id")
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"normal": 6, "neptune": 6}
    assert out.drop("copy").distinct().exceptAll(df).isEmpty()
    assert df.exceptAll(out.where("copy = 1").drop("copy")).isEmpty()
    report = balance.balancing_report(df, "label").first()
    assert report["balancing_applied"] and report["balancing_method"] == "random_oversampling"


def test_single_class_is_left_alone(spark):
    df = _frame(spark, {"normal": 4})
    assert balance.oversample(df, "label", "row_id").count() == 4
    report = balance.balancing_report(df, "label").first()
    assert not report["balancing_applied"] and report["balancing_method"] == "none"


def test_one_minority_row(spark):
    df = _frame(spark, {"normal": 3, "neptune": 1})
    out = balance.oversample(df, "label", "row_id")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"normal": 3, "neptune": 3}


def test_very_many_copies_are_spread_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(balance, "COPIES_PER_TASK_ROW", 10)
    out = balance.oversample(_frame(spark, {"a": 137, "b": 1, "c": 50}), "label", "row_id")
    counts = out.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("row_id", "copy").alias("d")).collect()
    assert {r["label"]: (r["n"], r["d"]) for r in counts} == {k: (137, 137) for k in "abc"}


def test_class_weights(spark):
    found = {r["label"]: r["weight"] for r in balance.class_weights(_frame(spark, {"a": 6, "b": 2}), "label").collect()}
    assert found == {"a": 8 / 12, "b": 2.0}


@pytest.mark.parametrize("fine", [100_000, 1])
def test_hash_cuts_match_a_full_ranking(spark, monkeypatch, fine):
    """With ``fine`` 1 every narrowing step is used; one class holds most rows."""
    monkeypatch.setattr(rank, "FINE_ROWS", fine)
    counts = {"hot": 3000, "mid": 400, "rare": 1, "none": 5}
    quotas = {"hot": 1234, "mid": 400, "rare": 1, "none": 0}
    df = _frame(spark, counts).withColumn("h", rank.row_hash(F.col("row_id")))
    wanted = spark.createDataFrame(list(quotas.items()), "label string, quota long")
    marked = rank.mark_first(df, ["label"], "h", wanted, "first").collect()
    assert len(marked) == sum(counts.values())
    for label, quota in quotas.items():
        ids = [r["row_id"] for r in marked if r["label"] == label]
        best = sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:quota]
        assert {r["row_id"] for r in marked if r["label"] == label and r["first"]} == set(best)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.999, 1.0])
def test_exact_quantile(spark, monkeypatch, share):
    monkeypatch.setattr(rank, "FINE_ROWS", 5)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), np.full(300, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert math.isclose(rank.exact_quantile(df, "v", share, bins=16), np.quantile(values, share), rel_tol=1e-12)
    assert rank.exact_quantile(df.where("v > 1e10"), "v", share) is None


def test_holdout_counts_and_disjointness(spark):
    df = _frame(spark, {"normal": 101, "dos": 50, "u2r": 7})
    marked = split.holdout(df, "label", "row_id", 0.2)
    held = {r["label"]: r["count"] for r in marked.where("is_holdout").groupBy("label").count().collect()}
    assert sum(held.values()) == math.ceil(158 * 0.2) and set(held) == {"normal", "dos", "u2r"}
    assert marked.count() == 158
    again = split.holdout(df.repartition(5), "label", "row_id", 0.2)
    assert marked.where("is_holdout").select("row_id").exceptAll(again.where("is_holdout").select("row_id")).isEmpty()


def test_unstratifiable_data_uses_a_plain_split(spark):
    df = _frame(spark, {"normal": 4})
    marked = split.holdout(df, "label", "row_id", 0.25)
    assert marked.where("is_holdout").count() == 1
    rare = _frame(spark, {"normal": 9, "u2r": 1})
    assert not split.can_stratify(balance.class_counts(rare, "label"), 0.2).first()["stratified"]
    assert split.holdout(rare, "label", "row_id", 0.2).where("is_holdout").count() == 2
    with pytest.raises(ValueError):
        split.holdout(_frame(spark, {"normal": 1}), "label", "row_id")


@pytest.mark.parametrize("bad", [0.0, 1.0, -1.0, math.nan])
def test_bad_shares(spark, bad):
    with pytest.raises(ValueError):
        split.holdout(_frame(spark, {"a": 4}), "label", "row_id", bad)


def test_protocol_text():
    assert split.protocol_name(0.2, True) == "stratified 80/20 hold-out split of KDDTrain+"
    assert split.protocol_name(0.125, False) == "87.5/12.5 hold-out split of KDDTrain+"


def test_salted_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(bounded, "MAX_SMALL_ROWS", 1)
    left = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("key"))
    right = spark.range(0, 4000, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    right = right.unionByName(spark.createDataFrame([(7, 70)], "key long, v long"))
    assert 7 in bounded.hot_keys(left, "key")
    monkeypatch.setattr(bounded, "small", lambda df: (df, False))
    salted = bounded.salted_left_join(left, right, "key", ["id"]).select("id", "key", "v")
    plain = left.join(right, "key", "left").select("id", "key", "v")
    assert salted.count() == 4000 and salted.exceptAll(plain).isEmpty()


def test_small_tables_are_proven_by_rows(spark):
    df = spark.range(50)
    assert bounded.small(df, 50)[1] and not bounded.small(df, 49)[1]
    joined = bounded.join_small(df, df.withColumn("v", F.col("id") * 2), ["id"], max_rows=10)
    assert joined.count() == 50


def test_rows_without_a_key_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(bounded, "small", lambda df: (df, False))
    left = spark.range(8000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("key"))
    right = spark.range(0, 8000, 20).select(F.col("id").alias("key"), F.lit(1).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = bounded.salted_left_join(left, right, "key", ["id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert joined.count() == 8000 and joined.where("v = 1").count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert len(sizes) > 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_small_tables_are_bounded_by_bytes_and_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def wide(i):
        calls.add(1)
        return "x" * 1000

    df = spark.range(100).select(wide("id").alias("t"))
    table, proven = bounded.small(df, max_bytes=50_000)
    assert not proven and table.count() == 100 and calls.value == 100
    table.unpersist()
    assert bounded.small(df, max_bytes=200_000)[1]


@pytest.mark.parametrize("ids", ["id % 20", "if(id < 995, null, id)", "cast(null as long)"])
def test_repeated_and_missing_ids_give_exact_counts(spark, monkeypatch, ids):
    monkeypatch.setattr(rank, "FINE_ROWS", 10)
    df = spark.range(1000).selectExpr(f"{ids} as row_id", "if(id < 100, 'a', 'b') as label", "id")
    marked = split.holdout(df, "label", "row_id", 0.2)
    held = {r["label"]: r["held"] for r in marked.groupBy("label").agg(F.count_if("is_holdout").alias("held")).collect()}
    assert held == {"a": 20, "b": 180} and marked.select("id").distinct().count() == marked.count() == 1000
    assert balance.oversample(df, "label", "row_id").count() == 1800


@pytest.mark.parametrize("odd", ["Infinity", "-Infinity", "NaN"])
def test_a_quantile_refuses_values_that_are_not_finite(spark, monkeypatch, odd):
    monkeypatch.setattr(rank, "FINE_ROWS", 10)
    df = spark.range(200).selectExpr(f"if(id = 7, double('{odd}'), double(id)) as v")
    with pytest.raises(ValueError, match="not finite"):
        rank.exact_quantile(df, "v", 0.5)
    wide = spark.range(201).selectExpr("(id - 100) * 1.7e306 as v")
    assert rank.exact_quantile(wide, "v", 0.5) == 0.0
