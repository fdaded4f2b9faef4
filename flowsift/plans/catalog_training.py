"""Encoding, scaling, balancing, splitting, models, attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsift.functions import drivers, evidence
from flowsift.functions.labels import add_family, label_id
from flowsift.operators import balance, features, forest, isolation, shap, split
from flowsift.operators.bounded import shared_dir
from flowsift.plans import bindings as B, jobs
from flowsift.plans.registry import query, table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _scaling_sql(select: str) -> str:
    return f"""WITH s AS (
  SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp,
         avg(l_discount) md, stddev_pop(l_discount) sd FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {select} FROM lineitem, s"""


@query(
    "onehot_unseen",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS f0,
  CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END AS f1, CASE WHEN l_returnflag = 'N' THEN 1e0 ELSE 0e0 END AS f2,
  CASE WHEN l_linestatus = 'F' THEN 1e0 ELSE 0e0 END AS f3, CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END AS f4,
  'l_quantity l_returnflag_A l_returnflag_N l_linestatus_F l_linestatus_O' AS names FROM lineitem""",
)
def onehot_unseen(spark, sf):
    """Fitted without return flag R, so R becomes an all-zero block."""
    lines = table(spark, sf, "lineitem")
    model = features.fit(lines.where("l_returnflag <> 'R'"), ["l_quantity"], ["l_returnflag", "l_linestatus"])
    found = model.apply(lines)
    columns = [F.col("raw_features")[i].alias(f"f{i}") for i in range(5)]
    return found.select(*LINE_KEY, *columns, F.lit(" ".join(model.names)).alias("names"))


def _scaled_lines(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("constant", F.lit(7.0))
    return features.fit(lines, ["l_quantity", "l_extendedprice", "l_discount", "constant"], []), lines


@query(
    "scale_numeric",
    _scaling_sql(
        """round((l_quantity - mq) / sq, 6) + 0e0 AS quantity, round((l_extendedprice - mp) / sp, 6) + 0e0 AS price,
  round((l_discount - md) / sd, 6) + 0e0 AS discount, 0e0 AS constant"""
    ),
)
def scale_numeric(spark, sf):
    model, lines = _scaled_lines(spark, sf)
    names = ["quantity", "price", "discount", "constant"]
    columns = [
        (F.round(F.col("scaled_features")[i], 6) + F.lit(0.0)).alias(name) for i, name in enumerate(names)
    ]
    return model.apply(lines).select(*LINE_KEY, *columns)


@query(
    "unscale",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 4) AS quantity,
  round(l_extendedprice, 4) AS price, round(l_discount, 4) AS discount, 7e0 AS constant FROM lineitem""",
)
def unscale(spark, sf):
    model, lines = _scaled_lines(spark, sf)
    back = features.unscaled(F.col("scaled_features"), model.mean, model.scale)
    names = ["quantity", "price", "discount", "constant"]
    found = model.apply(lines).withColumn("back", back)
    return found.select(*LINE_KEY, *[F.round(F.col("back")[i], 4).alias(n) for i, n in enumerate(names)])


@query(
    "oversample_counts",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n, (SELECT max(n) FROM c) AS balanced, TRUE AS balancing_applied,
       'random_oversampling' AS balancing_method FROM c""",
)
def oversample_counts(spark, sf):
    orders = table(spark, sf, "orders")
    weighted = balance.with_copies(orders, "o_orderpriority", "o_orderkey")
    applied = balance.balancing_report(orders, "o_orderpriority").first()
    counts = weighted.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum("copies").alias("balanced")
    )
    return counts.withColumns({k: F.lit(applied[k]) for k in ("balancing_applied", "balancing_method")})


@query(
    "oversample_rows",
    """WITH c AS (SELECT *, quality * 2 + toxic AS class FROM labels),
n AS (SELECT class, count(*) AS n FROM c GROUP BY class),
r AS (SELECT c.*, n.n, row_number() OVER (PARTITION BY c.class ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r,
             (SELECT max(n) FROM n) AS top FROM c JOIN n USING (class)),
k AS (SELECT *, top // n + CASE WHEN r <= top % n THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, class, unnest(generate_series(1, copies)) AS copy FROM k""",
)
def oversample_rows(spark, sf):
    labels = table(spark, sf, "labels").withColumn("class", F.col("quality") * 2 + F.col("toxic"))
    return balance.oversample(labels, "class", "doc_id").select("doc_id", "class", "copy")


@query(
    "repeated_id_split",
    """WITH c AS (SELECT l_returnflag AS p, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(sum(n) * 0.2e0) AS BIGINT) AS held FROM c),
x AS (SELECT p, n * held / total AS exact, floor(n * held / total) AS base, held FROM c, t),
q AS (SELECT p, base + CASE WHEN row_number() OVER (ORDER BY base - exact, p)
                              <= held - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM x),
r AS (SELECT l_orderkey, l_returnflag,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(CAST(l_orderkey AS VARCHAR))) AS r FROM lineitem)
SELECT l_orderkey, l_returnflag, count(*) AS n, CAST(count_if(r <= quota) AS BIGINT) AS held
FROM r JOIN q ON p = l_returnflag GROUP BY 1, 2""",
)
def repeated_id_split(spark, sf):
    """Ids that several rows share: the quota ends among the rows of one."""
    marked = split.holdout(table(spark, sf, "lineitem"), "l_returnflag", "l_orderkey", 0.2)
    return marked.groupBy("l_orderkey", "l_returnflag").agg(
        F.count("*").alias("n"), F.count_if("is_holdout").alias("held")
    )


@query(
    "missing_id_copies",
    """WITH s AS (SELECT l_returnflag, nullif(l_suppkey % 7, 0) AS id FROM lineitem),
n AS (SELECT l_returnflag, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT s.*, n.n, (SELECT max(n) FROM n) AS top,
             row_number() OVER (PARTITION BY s.l_returnflag ORDER BY md5(coalesce(CAST(id AS VARCHAR), ''))) AS r
      FROM s JOIN n USING (l_returnflag))
SELECT l_returnflag, coalesce(id, -1) AS id, count(*) AS n,
       CAST(sum(top // n + CASE WHEN r <= top % n THEN 1 ELSE 0 END) AS BIGINT) AS copies FROM r GROUP BY 1, 2""",
)
def missing_id_copies(spark, sf):
    """A handful of ids for all rows, one of them missing: copies still add up exactly."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", F.expr("nullif(l_suppkey % 7, 0)").alias("id"))
    return balance.with_copies(lines, "l_returnflag", "id").groupBy(
        "l_returnflag", F.coalesce("id", F.lit(-1)).alias("id")
    ).agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))


@query(
    "class_weights",
    """SELECT c_mktsegment, count(*) AS n,
       round((SELECT count(*) FROM customer) / ((SELECT count(DISTINCT c_mktsegment) FROM customer) * count(*)), 9) AS weight
FROM customer GROUP BY c_mktsegment""",
)
def class_weights(spark, sf):
    found = balance.class_weights(table(spark, sf, "customer"), "c_mktsegment")
    return found.withColumn("weight", F.round("weight", 9))


@query(
    "stratified_split",
    """WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(sum(n) * 0.2e0) AS BIGINT) AS held FROM c),
x AS (SELECT p, n * held / total AS exact, floor(n * held / total) AS base, held FROM c, t),
q AS (SELECT p, base + CASE WHEN row_number() OVER (ORDER BY base - exact, p)
                              <= held - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM x),
r AS (SELECT o_orderkey, o_orderpriority,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS r FROM orders)
SELECT o_orderkey, o_orderpriority, r <= quota AS is_holdout FROM r JOIN q ON p = o_orderpriority""",
)
def stratified_split(spark, sf):
    marked = split.holdout(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", 0.2)
    return marked.select("o_orderkey", "o_orderpriority", "is_holdout")


@query(
    "plain_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS r,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, r <= ceil(n * 0.25e0) AS is_holdout FROM r""",
)
def plain_split(spark, sf):
    """One row per class: nothing to stratify, so the split falls back to the plain one."""
    orders = table(spark, sf, "orders").withColumn(
        "rare", F.when(F.col("o_orderkey") == 0, "only").otherwise("rest")
    )
    return split.holdout(orders, "rare", "o_orderkey", 0.25).select("o_orderkey", "is_holdout")


@query(
    "can_stratify",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, min(n) AS min_count,
       CAST(ceil(sum(n) * 0.2e0) AS BIGINT) AS holdout_rows, TRUE AS stratified,
       'stratified 80/20 hold-out split of KDDTrain+' AS protocol FROM c""",
)
def can_stratify(spark, sf):
    counts = balance.class_counts(table(spark, sf, "orders"), "o_orderpriority")
    found = split.can_stratify(counts, 0.2)
    return found.withColumn("protocol", F.lit(split.protocol_name(0.2, True)))


# ---- models: checked by properties that hold for every row ------------------------------------


def _embeddings(spark, sf):
    raw = table(spark, sf, "embeddings")
    return raw.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query(
    "forest_scores",
    "SELECT vec_id, label, TRUE AS sums_to_one, TRUE AS top_is_prediction, 10 AS classes FROM embeddings",
)
def forest_scores(spark, sf):
    data = _embeddings(spark, sf)
    fitted = forest.fit(data, "x", "label", None, row_id="vec_id")
    scored = forest.score(fitted, data, forest.classes_seen(data, "label"), "x")
    total = F.aggregate("rf_probabilities", F.lit(0.0), lambda a, p: a + p)
    top = F.get("rf_probabilities", F.col("rf_prediction")) == F.col("rf_confidence")
    return scored.select(
        "vec_id",
        "label",
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        top.alias("top_is_prediction"),
        F.size("rf_probabilities").alias("classes"),
    )


@query(
    "shap_local_accuracy",
    "SELECT vec_id, label, TRUE AS adds_up, 64 AS features, 8 AS drivers FROM embeddings",
)
def shap_local_accuracy(spark, sf):
    """Base value plus all attributions is the predicted class's probability, for every row."""
    data = _embeddings(spark, sf)
    fitted = forest.fit(data, "x", "label", None, row_id="vec_id")
    scored = forest.score(fitted, data, forest.classes_seen(data, "label"), "x")
    # a few small files of vectors are much work: dealt evenly to all cores before they are explained
    tasks = 2 * spark.sparkContext.defaultParallelism
    found = shap.explain(scored.repartition(tasks, F.xxhash64("vec_id", "x")), fitted.nodes, "x")
    total = F.aggregate("shap", F.col("base_value"), lambda a, s: a + s["value"])
    top = drivers.largest(F.col("shap"))
    return found.select(
        "vec_id",
        "label",
        (F.abs(total - F.col("rf_confidence")) < 1e-9).alias("adds_up"),
        F.size("shap").alias("features"),
        F.size(top).alias("drivers"),
    )


@query(
    "isolation_scores",
    "SELECT event_id, TRUE AS in_range, TRUE AS risk_in_range, TRUE AS flag_matches_score FROM events",
)
def isolation_scores(spark, sf):
    rows = B.connections(spark, sf)
    data = add_family(rows)
    model = features.fit(rows)
    ready = model.encode(data)
    normal = ready.where("attack_family = 'normal'")
    detector = isolation.fit(normal, row_id="event_id")
    scored = isolation.score(detector, ready)
    from flowsift.functions.scoring import isolation_risk

    score = F.col("isolation_score")
    risk = isolation_risk(score, detector.minimum, detector.maximum)
    return scored.select(
        "event_id",
        score.between(-1.0 - detector.offset, -detector.offset).alias("in_range"),
        risk.between(0.0, 1.0).alias("risk_in_range"),
        (F.col("isolation_outlier") == (score < 0)).alias("flag_matches_score"),
    )


@query(
    "analysis_verdicts",
    f"""SELECT event_id, '192.0.2.' || CAST(event_id % 253 + 1 AS VARCHAR) AS source_ip,
  TRUE AS alert_has_ticket, TRUE AS class_matches_reason, TRUE AS explained_when_alert,
  TRUE AS model_version_kept FROM events""",
)
def analysis_verdicts(spark, sf):
    """Train, save, score, explain and write tickets for every event."""
    rows = B.connections(spark, sf)
    found = jobs.train(
        add_family(rows),
        "event_id",
        version="catalog",
    )
    done = jobs.analyze(found, rows)
    alert = F.col("fused_anomaly")
    isolation_only = F.col("alert_reason") == "isolation_forest"
    return done.select(
        "event_id",
        "source_ip",
        (alert == F.col("ticket_text").isNotNull()).alias("alert_has_ticket"),
        (isolation_only == (F.col("predicted_class") == "anomaly")).alias("class_matches_reason"),
        (alert == (F.size("evidence.top_shap_drivers") == 8)).alias("explained_when_alert"),
        (F.col("evidence.model_version") == "catalog").alias("model_version_kept"),
    )


REJECTED_FIELDS = """CASE event_id % 10 WHEN 1 THEN 'src_bytes' WHEN 2 THEN 'src_bytes' WHEN 3 THEN 'src_bytes'
  WHEN 4 THEN 'src_bytes' WHEN 5 THEN 'dst_bytes,count' END"""


@query(
    "analysis_rejects",
    f"""SELECT event_id, {REJECTED_FIELDS} AS bad_fields, event_id % 10 NOT BETWEEN 1 AND 5 AS analysed FROM events""",
)
def analysis_rejects(spark, sf):
    """Missing, infinite, NaN and text numbers go to the rejects table with their fields; the rest get verdicts."""
    rows = B.connections(spark, sf)
    n = F.col("event_id") % 10
    spoiled = F.when(n == 2, "Infinity").when(n == 3, "NaN").when(n == 4, "many").otherwise(F.col("src_bytes").cast("string"))
    bad = rows.withColumns(
        {
            "src_bytes": F.when(n != 1, spoiled),
            "dst_bytes": F.when(n != 5, F.col("dst_bytes")),
            "count": F.when(n != 5, F.col("count")),
        }
    )
    found = jobs.train(add_family(rows), "event_id")
    rejects = shared_dir(spark, "rejects")
    done = jobs.analyze(found, bad, rejects=rejects)
    kept = done.select("event_id", F.lit(None).cast("string").alias("bad_fields"), F.col("verdict").isNotNull().alias("analysed"))
    refused = spark.read.parquet(rejects).select("event_id", F.array_join("bad_fields", ","), F.lit(False))
    return kept.unionAll(refused)


@query("artifact_roundtrip", "SELECT event_id, TRUE AS same_score FROM events")
def artifact_roundtrip(spark, sf):
    """Scores of a trained model and of the same model read back agree on every row."""
    from flowsift.operators import artifact

    rows = B.connections(spark, sf)
    found = jobs.train(add_family(rows), "event_id")
    again = artifact.load(spark, found.path)
    columns = ["event_id", "fused_confidence", "alert_reason", "isolation_score"]
    left = jobs.score(found, rows, "event_id").select(columns)
    right = jobs.score(again, rows, "event_id").select(
        F.col("event_id"), *[F.col(c).alias(f"_{c}") for c in columns[1:]]
    )
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, "event_id").select("event_id", same.alias("same_score"))


_FAMILIES_SQL = """f AS (
  SELECT event_id, k, floor(value / 10) AS duration,
         CASE WHEN k < 40 THEN 'normal' WHEN k < 60 THEN 'dos' WHEN k < 75 THEN 'probe' WHEN k < 90 THEN 'r2l' ELSE 'u2r' END AS family
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""


def _quotas_sql(rows: str, label: str) -> str:
    """Per class the rows that the stratified fifth holds out."""
    return f"""c AS (SELECT {label} AS p, count(*) AS n FROM {rows} GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(sum(n) * 0.2e0) AS BIGINT) AS held FROM c),
x AS (SELECT p, n * held / total AS exact, floor(n * held / total) AS base, held FROM c, t),
q AS (SELECT p, CAST(base + CASE WHEN row_number() OVER (ORDER BY base - exact, p)
                                   <= held - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM x)"""


@query(
    "evaluation_holdout",
    f"""WITH {_FAMILIES_SQL}, {_quotas_sql("f", "family")}
SELECT p AS label, quota AS support, TRUE AS learned FROM q""",
)
def evaluation_holdout(spark, sf):
    """Per-class support of the hold-out protocol; the family follows from one input, so every class is learned."""
    data = add_family(B.connections(spark, sf))
    _, tables, _, _ = jobs.evaluate(data, "event_id")
    return tables["per_class"].select("label", "support", (F.col("f1") > 0.95).alias("learned"))


@query(
    "transfer_benchmark",
    f"""WITH {_FAMILIES_SQL}, {_quotas_sql("f", "family")}
SELECT 'control' AS domain, CAST(sum(quota) AS BIGINT) AS rows, TRUE AS better_at_home FROM q UNION ALL
SELECT 'transfer', count(*), FALSE FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED')""",
)
def transfer_benchmark(spark, sf):
    """Control and transfer rows, and where the model does better; the external flows are the orders table."""
    from flowsift.plans.catalog_quality import ORDER_COLUMNS, ORDER_FAMILIES

    source = add_family(B.connections(spark, sf))
    tables = jobs.transfer_benchmark(
        source,
        table(spark, sf, "orders"),
        "event_id",
        columns=ORDER_COLUMNS,
        category="o_orderpriority",
        families=ORDER_FAMILIES,
    )
    heads = {name: tables[f"{name}_headline"].first() for name in ("control", "transfer")}
    other = {"control": "transfer", "transfer": "control"}
    rows = [(name, int(h["rows"]), h["accuracy"] > heads[other[name]]["accuracy"]) for name, h in heads.items()]
    return spark.createDataFrame(rows, "domain string, rows bigint, better_at_home boolean")


@query(
    "retrain_report",
    f"""WITH {_FAMILIES_SQL}
SELECT count(*) FILTER (family = 'probe' AND duration < 2) AS feedback_examples, 25e0 AS feedback_weight,
       count(*) AS evaluation_rows, TRUE AS moved, TRUE AS no_fewer_corrected FROM f""",
)
def retrain_report(spark, sf):
    """Baseline, corrections of every normal-looking probe, retrained forest, before/after report."""
    rows = B.connections(spark, sf)
    data = add_family(rows)
    found = jobs.train(data, "event_id")
    fixes = (
        data.where("attack_family = 'probe' and duration < 2")
        .withColumn("label_id", F.lit(0))
        .withColumn("event_id", F.col("event_id").cast("string"))
    )
    updated, report = jobs.retrain(data, fixes, found, data, "event_id")
    if updated.corrected.count() != fixes.count():
        raise AssertionError("the artifact keeps the ids of all corrections")
    return report.select(
        "feedback_examples", "feedback_weight", F.col("evaluation_rows").cast("long").alias("evaluation_rows"),
        (F.col("mean_probability_after") > F.col("mean_probability_before")).alias("moved"),
        (F.col("corrected_after") >= F.col("corrected_before")).alias("no_fewer_corrected"),
    )


@query(
    "corrections_training_set",
    f"""WITH {_FAMILIES_SQL},
fix AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'normal' ELSE 'dos' END AS family FROM f
        WHERE event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 4 <> 3),
n AS (SELECT family, count(*) AS n FROM f GROUP BY 1),
e AS (SELECT family, count(*) AS c FROM fix GROUP BY 1),
a AS (SELECT family, n, coalesce(c, 0) AS c, max(n) OVER () AS top FROM n LEFT JOIN e USING (family)),
w AS (SELECT *, sum(top + c) OVER () / (count(*) OVER () * (top + c)) AS weight FROM a)
SELECT CASE family WHEN 'normal' THEN 0 WHEN 'dos' THEN 1 WHEN 'probe' THEN 2 WHEN 'r2l' THEN 3 ELSE 4 END AS label_id,
       n + c AS rows, CAST(top + c AS BIGINT) AS copies, round(weight * (top + 25e0 * c), 6) AS total_weight, c AS corrections FROM w""",
)
def corrections_training_set(spark, sf):
    """From stored reviews to the weighted training set: the newest review decides, two are refused or not false positives."""
    from flowsift.operators import tickets
    from flowsift.schema import CONNECTION, MODEL_INPUTS, REVIEW

    rows = add_family(B.connections(spark, sf))
    inputs = CONNECTION.__class__([f for f in CONNECTION.fields if f.name in MODEL_INPUTS])
    opened = rows.where("event_id % 3 = 0").select(
        F.col("event_id").cast("string").alias("event_id"), F.to_json(F.struct(*MODEL_INPUTS)).alias("raw_record_json")
    )
    n = F.col("event_id").cast("long")

    def review(number: int, disposition, corrected) -> DataFrame:
        return opened.select(
            (n * 2 + number).alias("review_id"), "event_id", F.lit(f"2026-01-0{number}T00:00:00+00:00").alias("created_at"),
            disposition.alias("disposition"), corrected.alias("corrected_class"), F.lit("seen").alias("analyst_notes"), F.lit("analyst").alias("reviewed_by"),
        )

    folder = shared_dir(spark, "reviews")
    first = review(1, F.lit("false_positive"), F.lit("u2r"))
    # decided again: some confirmed, some corrected by default, some to another class
    decided = F.when(n % 5 == 0, "confirmed_attack").otherwise("false_positive")
    second = review(2, decided, F.when(n % 4 != 0, "dos")).where(n % 4 != 3)
    third = review(2, F.lit("confirmed_attack"), F.lit(None).cast("string")).where(n % 4 == 3)
    refused = review(2, F.lit("closed"), F.lit("probe"))
    for batch, reviews in enumerate((first, second.unionByName(third), refused)):
        tickets.append_reviews(reviews, opened, folder, batch)
    fixes = jobs.corrections(opened, tickets.load(spark, folder, REVIEW), inputs)
    model = features.fit(rows)
    ready = model.encode(rows.withColumn("label_id", label_id(F.col("attack_family"))))
    chosen = jobs.training_set(ready.select(F.col("event_id").alias("row_id"), "label_id", "features"), extra=model.encode(fixes))
    return chosen.groupBy("label_id").agg(
        F.count("*").alias("rows"), F.sum("copies").alias("copies"), F.round(F.sum("weight"), 6).alias("total_weight"),
        F.count_if(F.col("trust") > 1).alias("corrections"),
    )


@query(
    "wide_categories",
    """WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS v, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 7 <> 0 GROUP BY 1),
i AS (SELECT v, n, 1 + row_number() OVER (ORDER BY v) - 1 AS i FROM v),
s AS (SELECT l_linestatus AS v, (SELECT count(*) FROM v) + row_number() OVER (ORDER BY l_linestatus) AS i
      FROM (SELECT DISTINCT l_linestatus FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 7 <> 0))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 0e0 AS number, CAST(coalesce(i.i, -1) AS INTEGER) AS order_index,
       CAST(coalesce(s.i, -1) AS INTEGER) AS status_index, CAST(coalesce(i.n, 0) AS BIGINT) AS seen
FROM lineitem LEFT JOIN i ON i.v = CAST(l_orderkey AS VARCHAR) LEFT JOIN s ON s.v = l_linestatus""",
)
def wide_categories(spark, sf):
    """A category for every order: far more than a row could have columns for."""
    lines = table(spark, sf, "lineitem")
    model = features.fit(lines.where("l_linenumber <= 2 and l_orderkey % 7 <> 0"), ["l_quantity"], ["l_orderkey", "l_linestatus"])
    found = model.encode(lines)
    hot = F.col("features.hot")
    known = model.categories.select(F.col("index").alias("order_index"), F.col("n").alias("seen"))
    out = found.select(*LINE_KEY, F.col("features.numbers")[0].alias("number"), hot[0].alias("order_index"), hot[1].alias("status_index"))
    return out.join(known, "order_index", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))


# ---- attribution arrays -----------------------------------------------------------------------

_RANKED = """WITH v AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(CAST(x AS DOUBLE)) DESC, i DESC) AS r FROM v),
t AS (SELECT *, CAST(x AS DOUBLE) AS d, max(abs(CAST(x AS DOUBLE))) OVER (PARTITION BY vec_id) AS peak FROM r WHERE r <= 8)
"""


def _top(spark, sf):
    data = _embeddings(spark, sf)
    names = [f"e{i}" for i in range(64)]
    return data.withColumn("top", drivers.top_drivers(F.col("x"), F.col("x"), names))


@query(
    "driver_topk",
    _RANKED
    + """SELECT vec_id, CAST(r AS INTEGER) AS rank, 'e' || CAST(i AS VARCHAR) AS feature, round(d, 6) AS shap_value,
  CASE WHEN abs(d) <= 1e-12 THEN 'is neutral for the predicted class' WHEN d > 0 THEN 'supports the predicted class'
       ELSE 'opposes the predicted class' END AS direction FROM t""",
)
def driver_topk(spark, sf):
    rows = _top(spark, sf).select("vec_id", F.posexplode("top").alias("rank", "d"))
    return rows.select(
        "vec_id",
        (F.col("rank") + 1).alias("rank"),
        "d.feature",
        F.round("d.shap_value", 6).alias("shap_value"),
        "d.direction",
    )


@query(
    "relative_bars",
    _RANKED
    + """SELECT vec_id, CAST(r AS INTEGER) AS rank, round(abs(d) / peak, 6) AS share,
  CASE WHEN abs(d) <= 1e-12 THEN 'NEUTRAL' WHEN d > 0 THEN 'SUPPORTS' ELSE 'OPPOSES' END AS tag FROM t""",
)
def relative_bars(spark, sf):
    bars = _top(spark, sf).withColumn("bars", drivers.relative_bars(F.col("top")))
    rows = bars.select("vec_id", F.posexplode("bars").alias("rank", "b"))
    return rows.select(
        "vec_id", (F.col("rank") + 1).alias("rank"), F.round("b.share", 6).alias("share"), "b.tag"
    )


@query(
    "evidence_json",
    f"""WITH {B.SCORED_SQL}
SELECT event_id, CASE WHEN alert_reason = 'isolation_forest' THEN 'anomaly' ELSE pred END AS predicted_class,
  pred AS rf_predicted_class, round(risk, 6) AS isolation_risk, round(fused_confidence, 6) AS fused_confidence,
  alert_reason, source_ip, 0.7e0 AS isolation_threshold, 16 AS keys FROM scored""",
)
def evidence_json(spark, sf):
    built = evidence.build(B.scored(spark, sf), B.THRESHOLD, "rule")
    text = built.select("event_id", evidence.to_json().alias("j"))
    read = F.from_json(
        "j",
        "predicted_class string, rf_predicted_class string, isolation_risk double, fused_confidence double, "
        "alert_reason string, source_ip string, isolation_threshold double",
    )
    keys = F.size(F.json_object_keys("j")).alias("keys")
    found = text.select("event_id", read.alias("r"), keys).select("event_id", "r.*", "keys")
    return found.withColumns({c: F.round(c, 6) for c in ("isolation_risk", "fused_confidence")})


