"""Times the headline queries: one JSON line with seconds per query and their sum.

Every query runs in full into a sink that keeps nothing. ``BENCH_SF_DIR`` picks the tables,
``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a comma-separated subset (``all`` for every query).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = """
alert_rollup family_counts isolation_risk fuse number_texts exact_quantile onehot_unseen
scale_numeric oversample_counts oversample_rows stratified_split class_weights forest_scores
shap_local_accuracy isolation_scores analysis_verdicts driver_topk evidence_json ticket_text
candidate_check resolve_ticket query_fence_check extract_response sanitize_evidence latest_review
queue_list queue_summary validate_reviews idempotent_append ip_enrich top_cves confusion headline
harmonize novelty canonical_ip clean_text envelope_parse envelope_roundtrip publish_frame
stream_alerts connection_files manifest_check wide_categories corrections_training_set payload_file
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowsift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from flowsift.plans.catalog import QUERIES

    picked = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if picked == "all" else picked.split(",") if picked else HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
