import math

import pytest
from pyspark.sql import functions as F

from flowsift.fixed_values import FAMILIES, FAMILY_LABELS
from flowsift.functions import scoring
from flowsift.functions.labels import add_family, family_name, label_id


def _risk(spark, scores, low, high):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i int, s double")
    rows = df.select("i", scoring.isolation_risk(F.col("s"), low, high).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_fine_labels_map_to_families(spark):
    labels = ["normal", "neptune", "nmap", "guess_passwd", "buffer_overflow", "brand_new_zero_day", "Neptune", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, label string")
    found = add_family(df).orderBy("i").collect()
    assert [r["attack_family"] for r in found] == [
        "normal", "dos", "probe", "r2l", "u2r", "unknown", "unknown", "unknown"]
    assert df.columns == ["i", "label"]
    assert sum(map(len, FAMILY_LABELS.values())) == 40


def test_label_ids_and_names_round_trip(spark):
    df = spark.createDataFrame([(f,) for f in FAMILIES], "f string")
    rows = df.select("f", label_id(F.col("f")).alias("i")).withColumn("g", family_name(F.col("i"))).collect()
    assert [(r["f"], r["i"]) for r in rows] == [(f, i) for i, f in enumerate(FAMILIES)]
    assert all(r["f"] == r["g"] for r in rows)
    with pytest.raises(Exception, match="no label id"):
        spark.createDataFrame([("other",)], "f string").select(label_id(F.col("f"))).collect()


def test_risk_is_bounded_and_falls_with_the_score(spark):
    got = _risk(spark, [-0.5, -0.1, 0.0, 0.2, 0.8], -0.3, 0.5)
    assert got == sorted(got, reverse=True) and got[0] == 1.0 and got[-1] == 0.0


def test_degenerate_calibration(spark):
    assert _risk(spark, [0.1, 0.0, 0.2], 0.1, 0.1) == [0.0, 1.0, 0.0]


def test_risk_does_not_depend_on_other_rows(spark):
    assert _risk(spark, [2.0], 0, 10) == [0.8]
    assert _risk(spark, [2.0, 1000.0, -1000.0], 0, 10)[0] == 0.8


def test_bad_bounds_and_scores_are_errors(spark):
    with pytest.raises(ValueError):
        scoring.isolation_risk(F.col("s"), 1.0, 0.0)
    with pytest.raises(Exception, match="finite"):
        _risk(spark, [math.nan], 0, 1)


def _fused(spark, prediction, p_normal, risk, threshold=0.7, saw_normal=True):
    df = spark.createDataFrame([(prediction, p_normal, risk)], "rf_prediction int, p double, isolation_risk double")
    df = df.withColumn("rf_anomaly_confidence", scoring.anomaly_probability(F.col("p"), saw_normal))
    return scoring.fuse(df, threshold=threshold).first()


def test_outlier_below_threshold_is_no_alert(spark):
    row = _fused(spark, 0, 0.98, 0.1)
    assert not row["fused_anomaly"] and row["alert_reason"] == "none"


def test_confidence_is_about_anomaly_not_class(spark):
    assert abs(_fused(spark, 0, 0.99, 0.0)["fused_confidence"] - 0.006) < 1e-12


def test_isolation_only_alert(spark):
    row = _fused(spark, 0, 0.98, 0.9)
    assert row["fused_anomaly"] and row["alert_reason"] == "isolation_forest"


def test_unknown_class_counts_as_anomalous_and_unseen_normal_is_certain(spark):
    assert _fused(spark, 5, 0.5, 0.0)["alert_reason"] == "random_forest"
    assert _fused(spark, 1, 0.5, 0.0, saw_normal=False)["rf_anomaly_confidence"] == 1.0


@pytest.mark.parametrize("p, risk, fused", [(1.0, 0.825992, 0.930397), (1.0, 0.716998, 0.886799)])
def test_published_fused_confidences(spark, p, risk, fused):
    row = _fused(spark, 1, 1.0 - p, risk)
    assert abs(row["fused_confidence"] - fused) < 1e-6 and row["alert_reason"] == "both"


@pytest.mark.parametrize("bad", [-0.01, 1.01, math.nan, math.inf])
def test_bad_thresholds(spark, bad):
    with pytest.raises(ValueError):
        _fused(spark, 0, 0.5, 0.5, threshold=bad)


def test_row_selection(spark):
    rows = [(0, False, 0, 0), (1, True, 2, 2), (2, True, 1, 1), (3, False, 0, 1)]
    df = spark.createDataFrame(rows, "row_id int, fused_anomaly boolean, rf_prediction int, label_id int")
    assert scoring.select_row(df, "row_id").first()["row_id"] == 1
    assert scoring.select_row(df, "row_id", 3).first()["row_id"] == 3
    assert scoring.select_exemplar(df, "row_id").first()["row_id"] == 2
    quiet = df.withColumn("fused_anomaly", F.lit(False)).where("row_id <> 2")
    assert scoring.select_row(quiet, "row_id").first()["row_id"] == 0
    assert scoring.select_exemplar(quiet, "row_id").first()["row_id"] == 0
    with pytest.raises(IndexError):
        scoring.select_row(df, "row_id", 9)
