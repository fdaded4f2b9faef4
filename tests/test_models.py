import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsift.functions import drivers
from flowsift.functions.labels import add_family
from flowsift.operators import artifact as artifacts, forest, isolation, shap
from flowsift.plans import jobs
from flowsift.plans.catalog import QUERIES

SHAPE = "event_id long, source_ip string, protocol_type string, service string, flag string, src_bytes double, count double, label string"
NUMBERS = ["src_bytes", "count"]


def _connections(spark, n=600, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = ["normal", "normal", "neptune", "satan"][i % 4]
        centre = {"normal": 0.0, "neptune": 6.0, "satan": -6.0}[kind]
        rows.append((i, f"192.0.2.{i % 253 + 1}", "tcp", ["http", "dns"][i % 2], "S0" if kind == "neptune" else "SF",
                     float(rng.normal(centre, 1)), float(rng.normal(centre / 2, 1)), kind))
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rows = add_family(_connections(spark))
    path = str(tmp_path_factory.mktemp("model") / "v1")
    return jobs.train(rows, "event_id", path, NUMBERS, version="t1", forest_options={"trees": 12, "depth": 5},
                      isolation_options={"trees": 40})


def test_training_finds_the_classes(spark, trained):
    scored = jobs.score(trained, _connections(spark, 400, 9)).withColumn("ok", F.expr(
        "rf_prediction = case label when 'normal' then 0 when 'neptune' then 1 else 2 end"))
    assert scored.agg(F.avg(F.col("ok").cast("double"))).first()[0] > 0.97
    assert trained.classes == [0, 1, 2]


def test_a_row_scores_the_same_alone_and_in_any_partitioning(spark, trained):
    rows = _connections(spark, 50, 3)
    pick = ["event_id", "rf_confidence", "isolation_score", "fused_confidence", "alert_reason"]
    whole = {r["event_id"]: r for r in jobs.score(trained, rows.repartition(7)).select(pick).collect()}
    alone = jobs.score(trained, rows.where("event_id = 11")).select(pick).first()
    assert whole[11] == alone


def _parts(df):
    return df.select(F.spark_partition_id()).distinct().count()


def _noted(monkeypatch):
    """Over how many tasks the rows were spread that jobs stored, by the table's name."""
    seen = {}
    monkeypatch.setattr(jobs, "stored", lambda df, name, keep=jobs.stored: seen.update({name: _parts(df)}) or keep(df, name))
    return seen


def test_rows_of_one_file_are_walked_through_the_trees_by_many_tasks(spark, trained, monkeypatch):
    rows = add_family(_connections(spark, 300, 3)).coalesce(1)
    pick = ["event_id", "fused_confidence", "isolation_score"]
    dealt, narrow = jobs.score(trained, rows, "event_id"), jobs.score(trained, rows)
    assert _parts(dealt.select(*pick)) > 4 and _parts(narrow.select(*pick)) == 1
    assert dealt.select(pick).exceptAll(narrow.select(pick)).isEmpty() and dealt.count() == 300
    seen = _noted(monkeypatch)
    jobs.train(rows, "event_id", numbers=NUMBERS, forest_options={"trees": 2, "depth": 3}, isolation_options={"trees": 4})
    assert seen["features"] > 4


def test_transfer_rows_of_one_file_are_dealt_to_many_tasks(spark, monkeypatch):
    flows = add_family(_connections(spark, 300, 3)).coalesce(1)
    seen = _noted(monkeypatch)
    monkeypatch.setattr(jobs, "EXTERNAL_COLUMNS", dict.fromkeys(["protocol_type", "service", "flag", *NUMBERS]))
    model = jobs.fit_transfer(flows, "attack_family", {"trees": 2, "depth": 3})
    assert _parts(jobs.predict_transfer(*model, flows).select("predicted")) > 4 and seen["features"] > 4


def test_retraining_deals_rows_of_one_file_to_many_tasks(spark, trained, monkeypatch):
    rows = add_family(_connections(spark, 300, 3)).coalesce(1)
    seen = _noted(monkeypatch)
    fixes = rows.where("label = 'satan'").withColumn("label_id", F.lit(0))
    _, report = jobs.retrain(rows, fixes, trained, rows, "event_id", forest_options={"trees": 2, "depth": 3})
    assert min(seen[name] for name in ("features", "evaluation", "corrections")) > 4
    assert report.first()["evaluation_rows"] == 300


def test_artifact_reads_back_and_rejects_foreign_folders(spark, trained, tmp_path):
    again = artifacts.load(spark, trained.path)
    rows = _connections(spark, 60, 2)
    a, b = (jobs.score(x, rows).select("event_id", "fused_confidence", "alert_reason") for x in (trained, again))
    assert a.exceptAll(b).isEmpty() and again.version == "t1" and again.calibration == trained.calibration
    with pytest.raises(ValueError):
        artifacts.load(spark, str(tmp_path / "nothing"))
    spark.createDataFrame([('{"kind": "other"}',)], "value string").write.text(str(tmp_path / "x" / "manifest"))
    with pytest.raises(ValueError, match="does not contain"):
        artifacts.load(spark, str(tmp_path / "x"))
    text = '{"kind": "flowsift-artifact", "format_version": 2}'
    spark.createDataFrame([(text,)], "value string").write.text(str(tmp_path / "y" / "manifest"))
    with pytest.raises(ValueError, match="format 2"):
        artifacts.load(spark, str(tmp_path / "y"))


def test_attributions_add_up_and_blocks_agree(spark, trained):
    scored = jobs.score(trained, _connections(spark, 80, 4))
    nodes = trained.nodes(spark)
    whole = shap.explain(scored, nodes).select("event_id", "shap", "base_value", "rf_confidence").orderBy("event_id")
    packed = shap.pack(nodes, budget=900)
    assert len(packed.groups) > 12  # most trees are cut
    blocked = shap.explain(scored, packed).select("event_id", "shap").orderBy("event_id")
    for a, b in zip(whole.collect(), blocked.collect()):
        assert abs(a["base_value"] + sum(s["value"] for s in a["shap"]) - a["rf_confidence"]) < 1e-9
        assert [(s["feature"], s["seen"]) for s in a["shap"]] == [(s["feature"], s["seen"]) for s in b["shap"]]
        assert np.allclose([s["value"] for s in a["shap"]], [s["value"] for s in b["shap"]], atol=1e-12)


def test_blocks_hold_every_leaf_once_within_the_budget():
    sizes = [(0, 10, 400), (1, 100, 4000), (2, 3, 120), (3, 7, 280), (4, 1, 5000), (5, 2, 80)]
    made = shap.blocks(sizes, 1000)
    held = [(t, i) for block in made for t, a, b in block for i in range(a, b)]
    assert held == [(t, i) for t, n, _ in sizes for i in range(n)]
    per = {t: size / n for t, n, size in sizes}
    assert all(sum(per[t] * (b - a) for t, a, b in block) <= 1000 or len(block) == 1 for block in made)


def _dense(row, width):
    hot = set(row["features"]["hot"])
    return [*row["features"]["numbers"], *(float(i in hot) for i in range(len(row["features"]["numbers"]), width))]


def _leaf(tree, x):
    n = tree[0]
    while n["left"] >= 0:
        n = tree[n["left"] if x[n["feature"]] <= n["threshold"] else n["right"]]
    return n


def _trees(nodes):
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n["tree_id"], {})[n["node_id"]] = n
    return trees


def test_probabilities_equal_a_walk_of_the_node_table(spark, trained):
    rows = jobs.score(trained, _connections(spark, 120, 8)).select("features", "rf_probabilities", "rf_prediction", "rf_confidence").collect()
    trees = _trees(trained.nodes(spark))
    assert len(trees) == 12
    for row in rows:
        x = _dense(row, trained.features.width)
        want = np.mean([_leaf(t, x)["share"] for t in trees.values()], axis=0)
        assert np.allclose(row["rf_probabilities"], want, atol=1e-12)
        assert row["rf_prediction"] == int(np.argmax(row["rf_probabilities"])) and row["rf_confidence"] == max(row["rf_probabilities"])


def test_groups_of_trees_score_like_one(spark, trained, monkeypatch):
    rows = _connections(spark, 60, 2)
    whole = jobs.score(trained, rows).select("event_id", "rf_probabilities").orderBy("event_id").collect()
    monkeypatch.setattr(forest, "MODEL_BYTES", 2000)
    again = artifacts.load(spark, trained.path)
    assert len(again.forest.packed) > 2
    for a, b in zip(whole, jobs.score(again, rows).select("event_id", "rf_probabilities").orderBy("event_id").collect()):
        assert np.allclose(a["rf_probabilities"], b["rf_probabilities"], atol=1e-12)


def test_trees_keep_their_limits_and_split_as_well_as_any(spark):
    """Every inner node's split is the best there is among all features when all are tried."""
    rng = np.random.default_rng(4)
    numbers, hot = rng.integers(0, 6, (60, 1)).astype(float), np.full((60, 0), -1)
    label = ((numbers[:, 0] > 2) ^ (rng.random(60) < 0.2)).astype(int)
    draws = rng.integers(1, 3, 60)
    nodes = forest.grow(numbers, hot, label, draws, 2, 4, 2, rng)
    assert all(n[6] >= 2 for n in nodes) and sum(n[6] for n in nodes if n[1] < 0) == draws.sum()

    def gini(mask):
        held = np.bincount(label[mask], draws[mask], 2)
        return held.sum() - (held**2).sum() / max(held.sum(), 1)

    todo = [(0, np.ones(60, bool), 0)]
    while todo:
        k, mask, level = todo.pop()
        _, left, right, _, _, cut, cover, share = nodes[k]
        assert cover == draws[mask].sum() and np.allclose(share, np.bincount(label[mask], draws[mask], 2) / cover) and level <= 4
        if left >= 0:
            sides = [mask & (numbers[:, 0] <= t) for t in np.arange(-0.5, 6)]
            fits = [gini(s) + gini(mask & ~s) for s in sides if draws[s].sum() >= 2 and draws[mask & ~s].sum() >= 2]
            got = mask & (numbers[:, 0] <= cut)
            assert gini(got) + gini(mask & ~got) == pytest.approx(min(fits))
            todo += [(left, got, level + 1), (right, mask & ~got, level + 1)]


def test_draws_are_bounded_balanced_and_repeatable(spark):
    rows = spark.range(40_000).select(
        F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"),
        (F.col("id") % 1000 == 0).cast("int").alias("label_id"), F.when(F.col("id") % 1000 == 0, 999.0).otherwise(1.0).alias("weight"))
    total = 39_960 + 40 * 999.0
    ready = rows.select(F.struct("x", F.array().cast("array<int>")).alias("_x"), F.col("label_id").alias("_y"), F.col("weight").alias("_w"), F.xxhash64("row_id").alias("_k"))
    drawn = forest._draws(ready, total, 40_000, 10, 2000, 3)
    counts = {(r["_draw"], r["_y"]): r["n"] for r in drawn.groupBy("_draw", "_y").agg(F.sum("_n").alias("n")).collect()}
    assert len(counts) == 20 and all(850 <= n <= 1150 for n in counts.values())
    assert drawn.exceptAll(forest._draws(ready.repartition(7), total, 40_000, 10, 2000, 3)).isEmpty()
    model = forest.fit(rows, "x", trees=9, depth=30, fit_rows=2000, row_id="row_id")
    sizes = model.nodes.where("node_id = 0").select("cover").collect()
    assert len(sizes) == 9 and {r["cover"] for r in sizes} == {2000.0}
    again = forest.fit(rows.repartition(5), "x", trees=9, depth=30, fit_rows=2000, row_id="row_id")
    assert model.nodes.exceptAll(again.nodes).isEmpty()


def test_attributions_match_brute_force_shapley(spark, trained):
    """Every subset of features, path-dependent expectation, all trees."""
    scored = jobs.score(trained, _connections(spark, 6, 8))
    rows = shap.explain(scored, trained.nodes(spark)).select("features", "rf_prediction", "shap").collect()
    trees = _trees(trained.nodes(spark))
    width = trained.features.width

    def value(tree, node, x, known, target):
        n = tree[node]
        if n["left"] < 0:
            return n["share"][target]
        if n["feature"] in known:
            side = n["left"] if x[n["feature"]] <= n["threshold"] else n["right"]
            return value(tree, side, x, known, target)
        total = n["cover"]
        return sum(tree[c]["cover"] / total * value(tree, c, x, known, target) for c in (n["left"], n["right"]))

    for row in rows:
        x, target = _dense(row, width), row["rf_prediction"]
        game = {
            s: np.mean([value(t, 0, x, s, target) for t in trees.values()])
            for k in range(width + 1) for s in map(frozenset, itertools.combinations(range(width), k))
        }
        got = {s["feature"]: s for s in row["shap"]}
        assert all(s["seen"] == x[f] for f, s in got.items())
        for j in range(width):
            want = sum(
                math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width) * (game[s | {j}] - v)
                for s, v in game.items() if j not in s
            )
            assert abs((got[j]["value"] if j in got else 0.0) - want) < 1e-9


def _grown(n, features, classes, whole, trees=3):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, (n, features)).astype(float) if whole else rng.normal(size=(n, features))
    label = (x[:, 0] // 10).astype(int) % classes if whole else rng.integers(0, classes, n)
    out = []
    for tree in range(trees):
        made = forest.grow(x, np.zeros((n, 0), int), label, np.ones(n, int), classes, 25, 2, np.random.default_rng([1, tree]))
        out.append(pd.DataFrame([(tree, *node) for node in made], columns=[c.split()[0] for c in forest.NODES.split(", ")]))
    return x, rng.integers(0, classes, n), out


def _walks(spark, trees, features):
    plain = [[*row[:-1], row[-1].tolist()] for tree in trees for row in tree.astype(object).itertuples(index=False, name=None)]
    nodes = spark.createDataFrame(plain, forest.NODES)
    steps = shap.step_table(nodes).toPandas()
    return [shap._pack(own, {f: f for f in range(features)}) for _, own in steps.groupby("tree_id")]


def test_rows_that_a_tree_cannot_tell_apart_are_walked_once(spark, monkeypatch):
    x, target, trees = _grown(400, 3, 2, True)
    block = _walks(spark, trees, 3)
    many = np.tile(x, (10, 1))
    whole = shap._forest_values(block, many, np.tile(target, 10))
    walked = []
    plain = shap.Walk.values
    monkeypatch.setattr(shap.Walk, "values", lambda self, x, target: walked.append(len(x)) or plain(self, x, target))
    again = shap._forest_values(block, many, np.tile(target, 10))
    assert (whole == again).all() and len(walked) == 3 and max(walked) <= 400
    apart = np.concatenate([sum(t.values(x[i : i + 1], target[i : i + 1]) for t in block) for i in range(0, 400, 40)], axis=1)
    assert (apart == whole[:, 0:400:40]).all()  # whatever rows are beside it


def test_attributions_of_deep_trees_add_up(spark):
    x, target, trees = _grown(300, 30, 3, False)
    block = _walks(spark, trees, 30)
    assert max(w.width for w in block) > 8
    x[5, 2] = np.inf
    found = shap._forest_values(block, x, target).sum(axis=0)
    for row in range(0, 300, 7):
        want = 0.0
        for tree in trees:
            at = {n.node_id: n._asdict() for n in tree.itertuples()}
            leaves = tree[tree["left"] < 0]
            base = sum(n.cover * n.share[target[row]] for n in leaves.itertuples()) / leaves["cover"].sum()
            want += _leaf(at, x[row])["share"][target[row]] - base
        assert abs(found[row] - want) < 1e-9


def test_few_vectors_are_explained_on_all_cores(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(v) for v in rng.normal(size=5)]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["shap_local_accuracy"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.where("adds_up").count() == 30


def test_drivers_carry_names_and_unscaled_values(spark, trained):
    rows = _connections(spark, 40, 6)
    done = jobs.analyze(trained, rows, spread=False, explain_normal=True)
    numbers = {r["event_id"]: r.asDict() for r in rows.collect()}
    for r in done.select("event_id", "evidence.top_shap_drivers").collect():
        own = numbers[r["event_id"]]
        for d in r["top_shap_drivers"]:
            want = {"src_bytes": own["src_bytes"], "count": own["count"]}
            want |= {f"{c}_{v}": float(own[c] == v) for c, vs in (("service", ["http", "dns"]), ("flag", ["S0", "SF"]), ("protocol_type", ["tcp"])) for v in vs}
            assert d["true_value"] == want[d["feature"]]


def test_a_forest_of_single_leaves_is_explained_by_its_base(spark):
    df = spark.createDataFrame([(i, [1.0], i % 2) for i in range(10)], "row_id long, x array<double>, label_id int")
    model = forest.fit(df, "x", weight=None, trees=3)
    found = shap.explain(forest.score(model, df, [0, 1], "x"), model.nodes, "x").first()
    assert found["shap"] == [] and abs(found["base_value"] - found["rf_confidence"]) < 1e-12


def test_rows_without_features_are_not_explained(spark, trained):
    scored = jobs.score(trained, _connections(spark, 10, 4)).withColumn(
        "gated", F.when(F.col("event_id") % 2 == 0, F.col("features")))
    found = shap.explain(scored, trained.nodes(spark), "gated").select("event_id", "shap").collect()
    assert all((r["shap"] is not None) == (r["event_id"] % 2 == 0) for r in found)


def test_analysis_with_and_without_spreading_agree(spark, trained):
    rows = _connections(spark, 60, 6)
    when = F.lit("2026-08-10T00:00:00+00:00")
    pick = ["event_id", "verdict", "message", "predicted_class", "evidence_json"]
    spread, narrow = (jobs.analyze(trained, rows, detected_at=when, spread=s).select(pick) for s in (True, False))
    a = {r["event_id"]: r for r in spread.collect()}
    b = {r["event_id"]: r for r in narrow.collect()}
    assert len(a) == 60 and a.keys() == b.keys()
    assert all(a[k]["message"] == b[k]["message"] and a[k]["verdict"] == b[k]["verdict"] for k in a)
    alerts = [r for r in a.values() if r["verdict"] == "alert"]
    assert alerts and all(r["message"].startswith("1. Incident Summary") for r in alerts)
    normal = [r for r in a.values() if r["verdict"] == "normal"]
    assert normal and all(r["message"].startswith("Connection classified NORMAL") for r in normal)


def test_rows_with_bad_numbers_go_to_the_rejects_table(spark, trained, tmp_path):
    odd = F.when(F.col("event_id") == 1, F.lit(float("inf"))).when(F.col("event_id") == 2, F.lit(float("nan")))
    rows = _connections(spark, 12, 6).withColumn("count", F.when(F.col("event_id") != 3, F.coalesce(odd, F.col("count"))))
    folder = str(tmp_path / "rejects")
    done = jobs.analyze(trained, rows, rejects=folder)
    assert sorted(r["event_id"] for r in done.collect()) == [0, *range(4, 12)]
    refused = {r["event_id"]: r["bad_fields"] for r in spark.read.parquet(folder).collect()}
    assert refused == {i: ["count"] for i in (1, 2, 3)}
    with pytest.raises(Exception, match="count holds a missing or non-finite number"):
        jobs.analyze(trained, rows, spread=False).select("message").collect()


def test_packed_trees_give_the_same_attributions(spark, trained):
    scored = jobs.score(trained, _connections(spark, 30, 8))
    packed = jobs.pack_trees(trained, spark)
    a, b = (shap.explain(scored, x).select("event_id", "shap", "base_value") for x in (packed, trained.nodes(spark)))
    assert a.collect() == b.collect() and trained.isolation.packed is trained.isolation.packed
    packed.close()


def test_bad_source_address_stops_an_alert(spark, trained):
    rows = _connections(spark, 8, 6).withColumn("source_ip", F.lit('127.0.0.1" | delete'))
    with pytest.raises(Exception, match="valid source IP"):
        jobs.analyze(trained, rows, spread=False).select("message").collect()


def test_isolation_ranks_outliers_first(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(800)] + [(900, [9.0, 9.0, -9.0])]
    df = spark.createDataFrame(rows, "row_id long, x array<double>")
    model = isolation.fit(df.where("row_id < 800"), "x", "row_id", trees=60)
    scored = isolation.score(model, df, "x")
    worst = scored.orderBy("isolation_score").first()
    assert worst["row_id"] == 900 and worst["isolation_outlier"]
    flagged = scored.where("row_id < 800 and isolation_outlier").count()
    assert flagged == 40  # five per cent of the training rows lie below the offset
    assert model.nodes.groupBy("tree_id").count().count() == 60
    same = isolation.fit(df.where("row_id < 800").repartition(5), "x", "row_id", trees=60)
    assert (same.offset, same.minimum, same.maximum) == (model.offset, model.minimum, model.maximum)
    low, high = isolation.calibrate(scored.where("row_id < 800"))
    assert (low, high) == (pytest.approx(model.minimum, abs=1e-12), pytest.approx(model.maximum, abs=1e-12))


def test_isolation_edge_cases(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "row_id long, x array<double>")
    model = isolation.fit(one, "x", "row_id", trees=3)
    assert isolation.score(model, one, "x").first()["isolation_score"] == 0.0
    with pytest.raises(ValueError):
        isolation.fit(one.limit(0), "x", "row_id")
    labelled = spark.createDataFrame([(1, 1), (2, 1)], "row_id long, label_id int")
    assert isolation.training_rows(labelled).count() == 2  # no normal row: all rows
    assert isolation.training_rows(labelled.withColumn("label_id", F.col("row_id").cast("int") - 1)).count() == 1


def test_sparse_classes_keep_their_slots(spark):
    rows = [(i, [float(i % 2)], (i % 2) * 2) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, label_id int")
    fitted = forest.fit(df, "x", "label_id", None, trees=5, depth=3)
    assert forest.classes_seen(df) == [0, 2]
    out = forest.score(fitted, df, [0, 2], "x").orderBy("row_id").collect()
    assert [r["rf_prediction"] for r in out[:2]] == [0, 2] and len(out[0]["rf_probabilities"]) == 3
    never_normal = forest.score(fitted, df, [2], "x").first()
    assert never_normal["rf_anomaly_confidence"] == 1.0


def test_driver_directions_order_and_bars(spark):
    df = spark.createDataFrame([([0.5, -0.2, 0.0, 0.5], [1.0, float("nan"), 3.0, 4.0])], "s array<double>, v array<double>")
    top = drivers.top_drivers(F.col("s"), F.col("v"), ["a", "b", "c", "d"], 4)
    row = df.select(top.alias("t"), drivers.relative_bars(top).alias("b")).first()
    assert [(d["feature"], d["true_value"]) for d in row["t"]] == [("d", 4.0), ("a", 1.0), ("b", None), ("c", 3.0)]
    assert [d["direction"].split()[0] for d in row["t"]] == ["supports", "supports", "opposes", "is"]
    assert [(b["share"], b["tag"]) for b in row["b"]] == [(1.0, "SUPPORTS"), (1.0, "SUPPORTS"), (0.4, "OPPOSES"), (0.0, "NEUTRAL")]
    with pytest.raises(ValueError):
        drivers.top_drivers(F.col("s"), F.col("v"), ["a"], 0)


def test_retraining_moves_the_corrected_rows_only_in_the_forest(spark, trained):
    rows = add_family(_connections(spark))
    fixes = (
        rows.where("attack_family = 'probe' and src_bytes > -5.5")
        .withColumn("event_id", F.col("event_id").cast("string")).withColumn("label_id", F.lit(0))
    )
    updated, report = jobs.retrain(rows, fixes, trained, rows, "event_id", forest_options={"trees": 12, "depth": 5})
    got = report.first()
    assert got["mean_probability_after"] > got["mean_probability_before"]
    assert got["corrected_after"] >= got["corrected_before"] and got["evaluation_rows"] == 600
    assert updated.calibration == trained.calibration and updated.version.startswith("feedback-")
    assert updated.metadata["isolation_forest_updated"] is False
    with pytest.raises(ValueError, match="no reviewed"):
        jobs.retrain(rows, fixes.limit(0), trained, rows, "event_id")
    with pytest.raises(ValueError, match="never seen"):
        jobs.retrain(rows, fixes.withColumn("label_id", F.lit(4)), trained, rows, "event_id")
    with pytest.raises(ValueError):
        jobs.retrain(rows, fixes, trained, rows, "event_id", weight=0)


def test_evaluation_protocols(spark, tmp_path):
    rows = add_family(_connections(spark, 400))
    options = dict(numbers=NUMBERS, forest_options={"trees": 8, "depth": 4}, isolation_options={"trees": 10})
    protocol, tables, _, scored = jobs.evaluate(rows, "event_id", **options)
    assert protocol.startswith("stratified 80/20") and scored.count() == 80
    assert tables["headline"].first()["accuracy"] > 0.9
    jobs.write_report(tables, protocol, "holdout", str(tmp_path))
    crossed, other, _, _ = jobs.evaluate(rows, "event_id", test=rows.where("event_id < 40"), **options)
    jobs.write_report(other, crossed, "cross_distribution", str(tmp_path))
    found = spark.read.json(str(tmp_path / "headline"))
    assert {r["protocol"]: r["rows"] for r in found.collect()} == {"holdout": 80, "cross_distribution": 40}


def test_every_tree_draws_from_all_rows(spark):
    """A table of more than 20,000 rows: bootstraps are as large as it, repeatable, and every row has its chance."""
    rows = spark.range(25_000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), (F.col("id") >= 24_990).cast("int").alias("label_id"))
    options = dict(weight=None, trees=3, depth=2, row_id="row_id")
    nodes = forest.fit(rows, "x", **options).nodes.drop("name")
    roots = nodes.where("node_id = 0").collect()
    assert [r["cover"] for r in roots] == [25_000.0] * 3 and all(r["feature"] == 0 for r in roots)
    assert all(24_970 < r["threshold"] < 24_999 for r in roots)
    assert nodes.exceptAll(forest.fit(rows.repartition(5), "x", **options).nodes.drop("name")).isEmpty()


def test_cuts_found_in_blocks_are_the_best_of_all(monkeypatch):
    rng = np.random.default_rng(6)
    for block in (7, 1000):
        monkeypatch.setattr(forest, "BLOCK", block)
        for kind in ("places", "few", "wide"):
            values = rng.integers(0, 40, 300) if kind != "wide" else rng.normal(size=300).round(2).astype(np.float32)
            label, draws = rng.integers(0, 3, 300), rng.integers(1, 4, 300)
            levels = np.arange(40) * 1.5 if kind == "places" else np.arange(5000) * 1.5 if kind == "few" else None
            column = values if levels is None else values.astype(np.uint16)
            held = np.bincount(label, draws, 3)
            score, cut = forest._split(forest._runs(column, levels, label, draws, 3), held, 5)
            seen = values.astype(float) if levels is None else levels[values]
            want = -1.0
            for t in np.unique(seen)[:-1]:
                left = np.bincount(label[seen <= t], draws[seen <= t], 3)
                if 5 <= left.sum() <= held.sum() - 5:
                    want = max(want, (left**2).sum() / left.sum() + ((held - left) ** 2).sum() / (held - left).sum())
            got = np.bincount(label[seen <= cut], draws[seen <= cut], 3)
            assert score == pytest.approx(want) == (got**2).sum() / got.sum() + ((held - got) ** 2).sum() / (held - got).sum()


def test_training_and_transfer_use_all_rows(spark, monkeypatch):
    rows = add_family(_connections(spark, 21_000))
    roots = lambda found: {r["cover"] for r in found.nodes.where("node_id = 0").collect()}
    few = {"trees": 2, "depth": 2}
    found = jobs.train(rows, "event_id", numbers=NUMBERS, forest_options=few, isolation_options={"trees": 2})
    assert roots(found.forest) == {31_500.0}  # three classes of as many rows as the largest has
    monkeypatch.setattr(jobs, "EXTERNAL_COLUMNS", dict.fromkeys(["protocol_type", "service", "flag", *NUMBERS]))
    assert roots(jobs.fit_transfer(rows, "attack_family", few)[1]) == {21_000.0}
