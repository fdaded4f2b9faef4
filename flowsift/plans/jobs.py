"""Whole jobs: train, analyse, evaluate, retrain from reviews, transfer."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.fixed_values import (
    CATEGORICAL,
    CROSS_PROTOCOL,
    EXTERNAL_COLUMNS,
    EXTERNAL_FAMILIES,
    FAMILIES,
    FEEDBACK_WEIGHT,
    ISOLATION_THRESHOLD,
    NORMAL_VERDICT,
    SEED,
    TRANSFER_FAMILIES,
    TRANSFER_PROTOCOL,
)
from flowsift.functions import drivers, evidence, scoring, ticket_text
from flowsift.functions.labels import family_name, label_id
from flowsift.functions.validate import non_empty, positive, source_ip, unit_interval
from flowsift.operators import (
    artifact as artifacts,
    balance,
    drift,
    features,
    forest,
    isolation,
    metrics,
    shap,
    split,
    tickets,
    transfer,
)
from flowsift.operators.artifact import Artifact
from flowsift.operators.bounded import dealt, shared_dir, small, stored
from flowsift.schema import NUMERIC

# ---- training ---------------------------------------------------------------------------------


def train(
    df: DataFrame,
    row_id: str,
    path: str | None = None,
    numbers: list[str] = NUMERIC,
    categorical: list[str] = CATEGORICAL,
    balanced: bool = True,
    threshold: float = ISOLATION_THRESHOLD,
    version: str = "baseline",
    forest_options: dict | None = None,
    isolation_options: dict | None = None,
    seed: int = SEED,
) -> Artifact:
    """Fits encoder, scaler, forest and isolation forest on rows with ``attack_family``.

    Oversampling enters the forest as whole-number weights: the trees see the same class totals
    as with repeated rows, but no copy is ever written or shuffled. The isolation forest and its
    calibration use the unbalanced rows.
    """
    threshold = unit_interval(threshold, "isolation threshold")
    model = features.fit(df, numbers, categorical)
    labelled = df.withColumn("label_id", label_id(F.col("attack_family")))
    ready = model.encode(labelled).select(F.col(row_id).alias("row_id"), "label_id", "features")
    # Written once, by all tasks: both fits pass over the features many times, counting and balancing read two columns.
    ready = stored(dealt(ready, *ready.columns), "features")
    fitted, classes = _fit_forest(model, ready, balanced, forest_options, seed)
    normal = isolation.training_rows(ready)
    detector = isolation.fit(normal, seed=seed, **(isolation_options or {}))
    found = Artifact(model, fitted, classes, detector, threshold, version)
    artifacts.check_schema(found)
    return artifacts.save(found, df.sparkSession, path or shared_dir(df.sparkSession, "artifact"))


def training_set(
    ready: DataFrame,
    balanced: bool = True,
    seed: int = SEED,
    extra: DataFrame | None = None,
    extra_weight: float = FEEDBACK_WEIGHT,
) -> DataFrame:
    """The forest's rows with their ``weight``: balanced rows, and corrections that weigh ``extra_weight`` each.

    ``ready`` has ``row_id``, ``label_id`` and ``features``, ``extra`` the corrections with ``event_id``.
    ``copies`` is how often a row stands in the balanced set; class weights are taken over copies and
    corrections together.
    """
    rows = balance.with_copies(ready, "label_id", "row_id", seed) if balanced else ready.withColumn(
        "copies", F.lit(1).cast("bigint")
    )
    rows = rows.select(F.col("row_id").cast("string").alias("row_id"), "label_id", "features", "copies", F.lit(1.0).alias("trust"))
    if extra is not None:
        added = extra.select(
            F.concat(F.lit("correction "), F.col("event_id").cast("string")).alias("row_id"),
            "label_id",
            "features",
            F.lit(1).cast("bigint").alias("copies"),
            F.lit(float(extra_weight)).alias("trust"),
        )
        rows = rows.unionByName(added)
    return balance.add_class_weight(rows, "label_id", F.col("trust") * F.col("copies"), F.col("copies"))


def _fit_forest(
    model: features.FeatureModel,
    ready: DataFrame,
    balanced: bool,
    options: dict | None,
    seed: int,
    extra: DataFrame | None = None,
    extra_weight: float = 1.0,
):
    """Forest on the (weight-)balanced rows plus ``extra`` rows of a given weight."""
    weighted = training_set(ready, balanced, seed, extra, extra_weight)
    known = {"row_id": "row_id", "names": model.name_table(), "width": model.width, "seed": seed}
    fitted = forest.fit(weighted, **known, **(options or {}))
    return fitted, forest.classes_seen(weighted)


# ---- scoring and analysis ---------------------------------------------------------------------


def score(found: Artifact, df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Adds features, both detectors' outputs and the fused verdict. A row's result does not depend
    on the rows beside it.

    Narrow, unless ``row_id`` is given: then the rows are dealt to all tasks first, as suits a table
    of few files, since both detectors walk hundreds of trees for each row.
    """
    if row_id is not None:
        df = dealt(df, row_id, *found.features.numeric, *found.features.categorical)
    ready = found.features.encode(df)
    scored = forest.score(found.forest, ready, found.classes)
    scored = isolation.score(found.isolation, scored)
    risk = scoring.isolation_risk(F.col("isolation_score"), *found.calibration)
    return scoring.fuse(scored.withColumn("isolation_risk", risk), threshold=found.threshold)


def analyze(
    found: Artifact,
    df: DataFrame,
    row_id: str = "event_id",
    detected_at: Column | None = None,
    explain_normal: bool = False,
    spread: bool = True,
    rejects: str | None = None,
    packed: shap.Packed | None = None,
) -> DataFrame:
    """Scores rows, explains alerts, and writes their tickets.

    With ``rejects``, rows whose numbers are missing, not numbers or not finite are written to
    that folder with their ``bad_fields`` and left out; without it such a row stops the job.
    ``packed`` are the trees made ready by :func:`pack_trees`, so that many calls share them.

    ``df`` has the model inputs, ``source_ip`` and ``row_id``. Attribution costs far more than
    scoring and alerts come in bursts, so with ``spread`` the rows are dealt to all tasks, scored and
    (without their features) stored once, and only the alerts are shuffled, evenly by row identity, and explained.
    Without it everything happens in one narrow pass, which suits micro-batches. An empty table is
    an error of the batch form; a micro-batch may be empty.
    """
    artifacts.check_schema(found)
    if spread:
        df = non_empty(df)
    if rejects is not None:
        df, bad = features.split_valid(df, found.features.numeric)
        bad.write.mode("overwrite").parquet(rejects)
    scored = score(found, df, row_id if spread else None)
    wanted = F.lit(True) if explain_normal else F.col("fused_anomaly")
    if spread:
        scored = stored(scored.drop("features"), "scored")
        chosen = dealt(scored.where(wanted), row_id)
        done = add_ticket(_explained(found, found.features.encode(chosen), packed=packed).drop("features"), detected_at)
        if explain_normal:
            return done
        rest = evidence.build(scored.where(~wanted), found.threshold, found.version)
        return done.unionByName(add_ticket(rest, detected_at))
    gated = scored.withColumn("_gated", F.when(wanted, F.col("features")))
    return add_ticket(_explained(found, gated, "_gated", packed).drop("_gated", "features"), detected_at)


def pack_trees(found: Artifact, spark: SparkSession) -> shap.Packed:
    """The artifact's trees, ready for any number of ``analyze`` calls."""
    return shap.pack(found.nodes(spark))


def _explained(
    found: Artifact, df: DataFrame, values: str = "features", packed: shap.Packed | None = None
) -> DataFrame:
    """Adds the evidence bundle with the top drivers of rows that have ``values``, as they were before any scaling."""
    packed = packed or pack_trees(found, df.sparkSession)
    out = shap.explain(df, packed, values)
    out = out.withColumn("_largest", drivers.largest(F.col("shap"))).drop("shap")
    out = out.withColumn("_names", shap.named(packed, F.transform("_largest", lambda s: s["feature"])))
    top = F.when(F.col("_largest").isNotNull(), drivers.described(F.col("_largest"), F.col("_names")))
    out = out.withColumns({"_top": top, "base_value": F.when(F.col("_largest").isNotNull(), F.col("base_value"))})
    built = evidence.build(out, found.threshold, found.version, "_top", "base_value")
    return built.drop("base_value", "_top", "_largest", "_names")


def add_ticket(df: DataFrame, detected_at: Column | None = None) -> DataFrame:
    """Adds ``ticket_text`` for alerts, ``verdict``, ``message`` and ``evidence_json``.

    An alert whose source address is neither absent nor valid stops the job.
    """
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    alert = F.col("fused_anomaly")
    failure = F.raise_error(F.lit("a valid source IP address is required")).cast("string")
    address = F.when(alert, F.coalesce(source_ip(F.col("source_ip")), failure))
    prepared = df.withColumn("_ip", address).withColumn(
        "_safe", F.when(alert, evidence.sanitize("evidence", F.col("_ip")))
    )
    texts = ticket_text.render(prepared, "_safe", now if detected_at is None else detected_at)
    return texts.withColumns(
        {
            "ticket_text": F.when(alert, F.col("ticket_text")),
            "verdict": F.when(alert, F.lit("alert")).otherwise(F.lit("normal")),
            "message": F.when(alert, F.col("ticket_text")).otherwise(F.lit(NORMAL_VERDICT)),
            "predicted_class": F.col("evidence.predicted_class"),
            "evidence_json": evidence.to_json("evidence"),
        }
    ).drop("_ip", "_safe", "ticket_text_classification", "ticket_text_evidence")


def ticket_rows(analysed: DataFrame, inputs: list[str], source: str | Column = "batch") -> DataFrame:
    """Ticket-table columns of analysed rows (``fused_anomaly`` kept for the caller's filter)."""
    created = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    observed = F.col("observed_at") if "observed_at" in analysed.columns else created
    origin = source if isinstance(source, Column) else F.lit(source)
    return analysed.select(
        F.col("event_id").cast("string").alias("event_id"),
        observed.alias("observed_at"),
        created.alias("created_at"),
        origin.alias("source"),
        F.coalesce("source_ip", F.lit("unknown")).alias("source_ip"),
        "predicted_class",
        "rf_confidence",
        "fused_confidence",
        "alert_reason",
        F.to_json(F.struct(*sorted(inputs)), {"ignoreNullFields": "false"}).alias("raw_record_json"),
        "evidence_json",
        "ticket_text",
        F.col("evidence.model_version").alias("model_version"),
        "fused_anomaly",
    )


# ---- evaluation -------------------------------------------------------------------------------


def report(scored: DataFrame, truth: str, prediction: str, labels: list | None = None) -> dict[str, DataFrame]:
    """Headline, per-class and confusion tables from one pass over the predictions."""
    cells, _ = small(metrics.cell_counts(scored, truth, prediction))
    matrix = metrics.confusion(cells, labels)
    classes = metrics.per_class(matrix)
    return {
        "headline": metrics.headline(classes),
        "per_class": classes,
        "confusion": matrix,
        "cells": cells,
    }


def evaluate(
    df: DataFrame,
    row_id: str,
    test: DataFrame | None = None,
    share: float = 0.2,
    seed: int = SEED,
    **options,
) -> tuple[str, dict[str, DataFrame], Artifact, DataFrame]:
    """Hold-out protocol on ``df``, or cross-distribution when a separate ``test`` is given."""
    if test is None:
        counts = df.groupBy("attack_family").agg(F.count("*").alias("n"))
        stratified = split.can_stratify(counts, share).first()["stratified"]
        protocol = split.protocol_name(share, stratified)
        marked = split.holdout(df, "attack_family", row_id, share, seed)
        fit_rows, test_rows = marked.where(~F.col("is_holdout")), marked.where("is_holdout")
    else:
        protocol = CROSS_PROTOCOL
        fit_rows, test_rows = df, test
    found = train(fit_rows, row_id, seed=seed, **options)
    truth = label_id(F.col("attack_family"))
    scored = score(found, test_rows.withColumn("label_id", truth), row_id)
    named = scored.withColumns(
        {"truth_family": F.col("attack_family"), "predicted_family": family_name(F.col("rf_prediction"))}
    )
    return protocol, report(named, "truth_family", "predicted_family"), found, scored


def write_report(tables: dict[str, DataFrame], protocol: str, key: str, path: str) -> None:
    """Metric tables as JSON under one folder per protocol, so protocols never overwrite each other."""
    for name in ("headline", "per_class", "confusion"):
        table = tables[name].withColumn("protocol_text", F.lit(protocol))
        folder = f"{path.rstrip('/')}/{name}/protocol={key}"
        table.coalesce(1).write.mode("overwrite").json(folder)  # a few rows


# ---- feedback ---------------------------------------------------------------------------------


def parse_examples(examples: DataFrame, schema, record: str = "raw_record_json") -> DataFrame:
    """Feedback examples as input columns plus the corrected label id."""
    parsed = examples.withColumn("_r", F.from_json(record, schema))
    fields = [F.col("_r")[f].alias(f) for f in schema.fieldNames()]
    return parsed.select("event_id", label_id(F.col("corrected_class")).alias("label_id"), *fields)


def corrections(ticket_table: DataFrame, reviews: DataFrame, schema, order: list[str] = ("created_at", "review_id")) -> DataFrame:
    """Corrected records from the ticket and review tables: ``(event_id, label_id, inputs...)``.

    A ticket counts if its newest review calls it a false positive of a known class; its inputs are
    those the ticket keeps as text.
    """
    reviewed = tickets.with_latest_review(ticket_table, reviews, list(order))
    return parse_examples(tickets.feedback_examples(reviewed), schema)


def effect(before: DataFrame, after: DataFrame, key: str = "event_id") -> DataFrame:
    """One row comparing two scorings of the same examples (``label_id`` is the corrected class)."""
    pick = lambda df, side: df.select(
        key,
        F.col("label_id").alias(f"{side}_label"),
        F.col("rf_prediction").alias(f"{side}_prediction"),
        F.get("rf_probabilities", F.col("label_id")).alias(f"{side}_p"),
    )
    both = pick(before, "before").join(pick(after, "after"), key)
    return both.agg(
        F.count("*").alias("feedback_examples"),
        F.count_if(F.col("before_prediction") != F.col("after_prediction")).alias("predictions_changed"),
        F.count_if(F.col("before_prediction") == F.col("before_label")).alias("corrected_before"),
        F.count_if(F.col("after_prediction") == F.col("after_label")).alias("corrected_after"),
        F.avg("before_p").alias("mean_probability_before"),
        F.avg("after_p").alias("mean_probability_after"),
    )


def retrain(
    df: DataFrame,
    examples: DataFrame,
    baseline: Artifact,
    test: DataFrame,
    row_id: str,
    weight: float = FEEDBACK_WEIGHT,
    balanced: bool = True,
    path: str | None = None,
    forest_options: dict | None = None,
    seed: int = SEED,
) -> tuple[Artifact, DataFrame]:
    """Refits the forest with analyst corrections; detector, calibration and encoders stay.

    ``examples`` has the model inputs, ``event_id`` and ``label_id``. Returns the saved artifact
    and a one-row report.
    """
    weight = positive(weight, "feedback weight")
    spark = df.sparkSession
    n = examples.count()
    if n == 0:
        raise ValueError("no reviewed false positives are available")
    known = set(baseline.classes)
    unseen = [r[0] for r in examples.select("label_id").distinct().collect() if r[0] not in known]
    if unseen:
        raise ValueError(f"corrected classes never seen in training: {sorted(unseen)}")
    model = baseline.features
    labelled = df.withColumn("label_id", label_id(F.col("attack_family")))
    ready = model.encode(labelled).select(F.col(row_id).alias("row_id"), "label_id", "features")
    ready = stored(dealt(ready, *ready.columns), "features")
    added = model.encode(examples).select(F.col("event_id").cast("string").alias("event_id"), "label_id", "features")
    added = stored(dealt(added, *added.columns), "corrections")
    fitted, classes = _fit_forest(model, ready, balanced, forest_options, seed, added, weight)

    moment = datetime.now(timezone.utc)
    updated = replace(
        baseline,
        forest=fitted,
        classes=classes,
        version=moment.strftime("feedback-%Y%m%dT%H%M%SZ"),
        metadata={
            "trained_at": moment.isoformat(timespec="seconds"),
            "feedback_examples": n,
            "feedback_weight": weight,
            "random_forest_updated": True,
            "isolation_forest_updated": False,
        },
        corrected=added.select("event_id"),
    )
    updated = artifacts.save(updated, spark, path or shared_dir(spark, "artifact"))
    scored = [
        forest.score(a.forest, added, a.classes) for a in (baseline, updated)
    ]
    change = effect(*scored)
    truth = test.withColumn("label_id", label_id(F.col("attack_family")))
    ready_test = model.encode(truth).select("label_id", "features")
    ready_test = stored(dealt(ready_test, *ready_test.columns), "evaluation")  # scored by both forests
    sides = []
    for name, a in (("baseline", baseline), ("updated", updated)):
        tables = report(forest.score(a.forest, ready_test, a.classes), "label_id", "rf_prediction")
        head = tables["headline"].first()
        sides.append((name, head))
    lit = {f"{name}_{k}": F.lit(head[k]) for name, head in sides for k in ("accuracy", "macro_f1")}
    out = change.withColumns(
        {
            "model_version": F.lit(updated.version),
            "trained_at": F.lit(updated.metadata["trained_at"]),
            "feedback_weight": F.lit(weight),
            "evaluation_rows": F.lit(sides[0][1]["rows"]),
            **lit,
            "accuracy_change": F.lit(sides[1][1]["accuracy"] - sides[0][1]["accuracy"]),
            "output_model": F.lit(updated.path),
        }
    )
    return updated, out


# ---- transfer ---------------------------------------------------------------------------------


def fit_transfer(df: DataFrame, target: str, forest_options: dict | None = None, seed: int = SEED):
    """Reduced-schema model: three encoded categories and four scaled numbers into a forest."""
    columns = list(EXTERNAL_COLUMNS)
    numbers = [c for c in columns if c not in CATEGORICAL]
    model = features.fit(df, numbers, CATEGORICAL)
    ready = model.encode(df.withColumn("label_id", label_id(F.col(target), TRANSFER_FAMILIES)))
    ready = ready.select("label_id", "features")
    weighted = balance.add_class_weight(stored(dealt(ready, *ready.columns), "features"), "label_id")
    return model, forest.fit(weighted, names=model.name_table(), width=model.width, seed=seed, **(forest_options or {}))


def predict_transfer(model, fitted, df: DataFrame) -> DataFrame:
    """Adds ``predicted``; rows are dealt to all tasks first, for the walk through the trees."""
    ready = model.encode(df)
    scored = forest.score(fitted, dealt(ready, "features"), list(range(len(TRANSFER_FAMILIES))))
    return scored.withColumn("predicted", family_name(F.col("rf_prediction")))


def transfer_benchmark(
    source: DataFrame,
    external: DataFrame,
    row_id: str,
    share: float = 0.2,
    forest_options: dict | None = None,
    seed: int = SEED,
    **harmonize_options,
) -> dict[str, DataFrame]:
    """In-domain control on a hold-out, then a refit on all source rows scored on the external
    flows without tuning. Returns metric tables of both, category novelty and exclusions."""
    rows = transfer.source_rows(source).select(row_id, *EXTERNAL_COLUMNS, "attack_family")
    marked = split.holdout(rows, "attack_family", row_id, share, seed)
    out: dict[str, DataFrame] = {}
    control = fit_transfer(marked.where(~F.col("is_holdout")), "attack_family", forest_options, seed)
    held = predict_transfer(*control, marked.where("is_holdout"))
    flows = transfer.harmonize(external, **harmonize_options)
    whole = fit_transfer(rows, "attack_family", forest_options, seed)
    moved = predict_transfer(*whole, flows)
    for name, scored, truth in (("control", held, "attack_family"), ("transfer", moved, "target")):
        tables = report(scored, truth, "predicted", TRANSFER_FAMILIES)
        for key in ("headline", "per_class", "confusion"):
            out[f"{name}_{key}"] = tables[key]
        out[f"{name}_binary"] = metrics.binary(tables["cells"])
    out["novelty"] = drift.novelty(rows, flows, CATEGORICAL)
    options = {k: v for k, v in harmonize_options.items() if k in ("category", "families")}
    out["exclusions"] = transfer.exclusions(external, **options)
    return out


def transfer_payload(spark: SparkSession, tables: dict[str, DataFrame], rows: dict[str, int], digest: str) -> DataFrame:
    """Summary of a transfer run as one row of JSON: protocol, mappings, row counts and all metric rows."""
    facts = {
        "protocol": TRANSFER_PROTOCOL,
        "random_state": SEED,
        "common_features": EXTERNAL_COLUMNS,
        "label_mapping": EXTERNAL_FAMILIES,
        "families": FAMILIES,
        "target_sha256": digest,
        **rows,
    }
    return payload(spark, facts, tables)


def payload(spark: SparkSession, facts: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """``value``: one JSON object with sorted keys, of plain facts and of tables as arrays of their rows.

    Tables are turned to text and put together by Spark, row by row in order of their text; no row
    of theirs comes to the driver.
    """
    entry = "key string, value string"
    parts = spark.createDataFrame([(k, json.dumps(v, sort_keys=True, default=str)) for k, v in facts.items()], entry)
    for name, df in tables.items():
        rows = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("r"))
        text = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit("]"))
        parts = parts.union(rows.agg(text.alias("value")).select(F.lit(name).alias("key"), "value"))
    sorted_parts = F.array_sort(F.collect_list(F.struct("key", "value")))
    members = F.transform(sorted_parts, lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), p["value"]))
    return parts.agg(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("value"))


def write_payload(made: DataFrame, path: str) -> None:
    """A report (retraining or transfer) as one JSON text, written where it was put together."""
    made.select("value").write.mode("overwrite").text(path)


def report_payload(report_row: DataFrame) -> DataFrame:
    """A one-row report as one JSON object with sorted keys."""
    fields = F.struct(*sorted(report_row.columns))
    return report_row.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))
