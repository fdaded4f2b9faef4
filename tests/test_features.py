import math

import pytest
from pyspark.sql import functions as F

from flowsift.operators import features
from flowsift.schema import CONNECTION, MODEL_INPUTS, NUMERIC

TRAIN = [("tcp", "http", "SF", 10, 1), ("udp", "dns", "SF", 20, 2), ("tcp", "ftp", "S0", 30, 3), ("icmp", "http", "SF", 40, 4)]
SHAPE = "protocol_type string, service string, flag string, src_bytes long, count long"


@pytest.fixture(scope="module")
def model(spark):
    return features.fit(spark.createDataFrame(TRAIN, SHAPE), ["src_bytes", "count"])


def test_names_are_numbers_then_sorted_categories(model):
    assert model.names == [
        "src_bytes", "count", "protocol_type_icmp", "protocol_type_tcp", "protocol_type_udp",
        "service_dns", "service_ftp", "service_http", "flag_S0", "flag_SF"]


def test_unseen_and_missing_categories_become_zero_blocks(spark, model):
    rows = spark.createDataFrame([("tcp", "telnet", "SF", 10, 1), ("tcp", None, "SF", 10, 1)], SHAPE)
    for row in model.apply(rows).collect():
        assert row["raw_features"] == [10.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_scaling_uses_population_deviation_and_leaves_constants(spark):
    df = spark.createDataFrame([(1.0, 7.1), (2.0, 7.1), (3.0, 7.1), (4.0, 7.1)], "x double, c double")
    model = features.fit(df, ["x", "c"], [])
    assert model.scale == [pytest.approx(math.sqrt(1.25)), 1.0]
    out = model.apply(df).orderBy("x").collect()
    assert out[0]["scaled_features"][0] == pytest.approx(-1.5 / math.sqrt(1.25))
    assert abs(out[0]["scaled_features"][1]) < 1e-12
    back = model.apply(df).select("x", features.unscaled(F.col("scaled_features"), model.mean, model.scale).alias("b"))
    assert all(abs(r["b"][0] - r["x"]) < 1e-12 for r in back.collect())


def test_one_row_alone_equals_the_row_in_a_batch(spark, model):
    batch = spark.createDataFrame(TRAIN, SHAPE)
    whole = model.apply(batch).where("src_bytes = 30").first()
    alone = model.apply(batch.where("src_bytes = 30")).first()
    assert whole["scaled_features"] == alone["scaled_features"]


def test_extra_columns_are_ignored_and_missing_ones_are_named(spark):
    row = {c: "tcp" if f.dataType.simpleString() == "string" else 1 for c, f in zip(MODEL_INPUTS, CONNECTION.fields)}
    df = spark.createDataFrame([tuple([*row.values(), "x"])], ", ".join(f"{c} string" for c in [*row, "extra"]))
    assert features.project_inputs(df).columns == MODEL_INPUTS
    with pytest.raises(ValueError, match="duration, dst_bytes"):
        features.project_inputs(df.drop("duration", "dst_bytes"))


def test_bad_numbers_are_set_aside_with_their_names(spark):
    columns = ", ".join(f"{c} string" for c in NUMERIC)
    good = ["1"] * len(NUMERIC)
    bad = ["inf", "abc", None, *good[3:]]
    df = spark.createDataFrame([tuple(good), tuple(bad)], columns)
    fine, rejected = features.split_valid(df)
    assert fine.count() == 1
    assert rejected.first()["bad_fields"] == NUMERIC[:3]


@pytest.mark.parametrize("number", [float("inf"), float("-inf"), float("nan"), None])
def test_missing_and_non_finite_numbers_are_refused(spark, number):
    schema = "x double, c string"
    good, bad = (spark.createDataFrame([(v, "a"), (2.0, "b")], schema) for v in (1.0, number))
    with pytest.raises(Exception, match="non-finite"):
        features.fit(bad, ["x"], ["c"])
    with pytest.raises(Exception, match="non-finite"):
        features.fit(good, ["x"], ["c"]).apply(bad).collect()


def test_an_empty_table_fails_the_job_that_reads_it(spark, model):
    from flowsift.functions.validate import non_empty

    rows = spark.createDataFrame(TRAIN, SHAPE)
    assert non_empty(rows).orderBy("count").collect() == rows.orderBy("count").collect()
    empty = non_empty(rows.where("count > 99"))  # nothing is read yet
    with pytest.raises(Exception, match="at least one connection record"):
        empty.collect()
    with pytest.raises(ValueError, match="no training rows"):
        features.fit(rows.limit(0), ["count"])


def test_rows_of_another_layout_fail_the_job_that_reads_them(spark, model):
    rows = spark.createDataFrame(TRAIN, SHAPE)
    good = model.encode(rows)
    assert model.guarded(good, names=["src_bytes", "count", "protocol_type", "service", "flag"]).select("features").collect() == good.select("features").collect()
    with pytest.raises(ValueError, match="encoded columns"):
        model.guarded(good, names=["count", "src_bytes", "protocol_type", "service", "flag"])
    hot, numbers = F.col("features.hot"), F.col("features.numbers")
    for wrong_numbers, wrong_hot in ((F.slice(numbers, 1, 1), hot), (numbers, F.slice(hot, 1, 2)), (numbers, F.reverse(hot))):
        bad = good.withColumn("features", F.struct(wrong_numbers.alias("numbers"), wrong_hot.alias("hot")))
        with pytest.raises(Exception, match="do not fit the model"):
            model.guarded(bad).select("features").collect()


def test_many_categories_are_joined_and_not_kept_on_the_driver(spark, monkeypatch):
    rows = spark.range(3000).select(F.concat(F.lit("user "), F.col("id") % 1500).alias("user"), F.when(F.col("id") % 2 == 0, "a").alias("kind"), (F.col("id") % 7).alias("x"))
    small = features.fit(rows, ["x"], ["user", "kind"])
    monkeypatch.setattr(features, "small", lambda side: (side, False))  # as if not proven small
    wide = features.fit(rows.repartition(5), ["x"], ["user", "kind"])
    assert wide.width == 1 + 1500 + 2 and wide.blocks == small.blocks == [(1, 1500), (1501, 2)]
    found = [{(r["user"], r["kind"]): r["features"] for r in m.encode(rows).collect() if r["features"]["numbers"] == [3.0]} for m in (small, wide)]
    assert found[0] == found[1]
    order = sorted({f"user {i % 1500}" for i in range(3000)})
    assert found[0][("user 3", None)]["hot"] == [1 + order.index("user 3"), 1501]
    unseen = rows.limit(1).select(F.lit("nobody").alias("user"), F.lit("a").alias("kind"), F.lit(1).alias("x"))
    assert wide.encode(unseen).first()["features"]["hot"] == [-1, 1502]
