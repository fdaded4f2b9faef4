"""Threat-intelligence snapshots joined to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.fixed_values import (
    CVE_HEADER,
    CVE_ID_CHARS,
    CVE_ID_FALLBACK,
    CVE_INVALID,
    CVE_NONE,
    CVE_PER_SERVICE,
    CVE_TEXT_CHARS,
    CVE_TEXT_FALLBACK,
    CVE_WINDOW_DAYS,
    IP_INVALID,
    IP_REPORT,
    ISP_CHARS,
    ISP_FALLBACK,
)
from flowsift.functions.text import clean, fill
from flowsift.functions.validate import canonical_ip, service_name
from flowsift.operators.bounded import join_small, salted_left_join


def ip_reputation(
    alerts: DataFrame, reputation: DataFrame, ip: str, row_id: list[str], out: str = "ip_report"
) -> DataFrame:
    """Adds the reputation line of each alert's address.

    ``reputation`` has unique canonical ``ip`` with ``abuse_score``, ``isp``, ``total_reports``.
    Only canonical addresses are looked up; invalid ones get a fixed message, and addresses
    absent from the snapshot null. One source may raise a large share of all alerts, so the join
    is salted.
    """
    report = fill(
        IP_REPORT,
        {
            "ip": F.col("ip"),
            "score": F.coalesce(F.col("abuse_score").cast("int"), F.lit(0)).cast("string"),
            "isp": clean(F.col("isp"), ISP_FALLBACK, ISP_CHARS),
            "reports": F.coalesce(F.col("total_reports").cast("int"), F.lit(0)).cast("string"),
        },
    )
    side = reputation.select(F.col("ip").alias("_ip"), report.alias("_report"))
    keyed = alerts.withColumn("_ip", canonical_ip(F.col(ip)))
    joined = salted_left_join(keyed, side, "_ip", row_id)
    line = F.when(F.col("_ip").isNull(), F.lit(IP_INVALID)).otherwise(F.col("_report"))
    return joined.withColumn(out, line).drop("_ip", "_report")


def recent_cves(services: DataFrame, cves: DataFrame, service: str, as_of: Column) -> DataFrame:
    """``(service, cve_summary)`` per distinct valid service: the three newest entries.

    ``cves`` has ``id``, ``published`` (text or timestamp), ``keywords`` and ``descriptions``
    (language, value). Dates that cannot be read sort last. The top-3 filter is applied before
    the shuffle too, so a keyword on many entries moves three rows per task; services are met
    only afterwards.
    """
    names = services.select(service_name(F.col(service)).alias("service")).where("service is not null")
    names = names.distinct()
    published = F.try_to_timestamp(F.col("published").cast("string"))
    start = as_of - F.make_dt_interval(days=F.lit(CVE_WINDOW_DAYS))
    english = F.filter("descriptions", lambda d: d["lang"] == "en")
    text = clean(F.get(english, F.lit(0))["value"], CVE_TEXT_FALLBACK, CVE_TEXT_CHARS)
    line = F.concat(F.lit("- "), clean(F.col("id"), CVE_ID_FALLBACK, CVE_ID_CHARS), F.lit(": "), text)
    recent = (
        cves.withColumn("_at", published)
        .where(F.col("_at").isNull() | F.col("_at").between(start, as_of))
        .select(F.explode(F.array_distinct("keywords")).alias("service"), "_at", "id", line.alias("_line"))
    )
    order = Window.partitionBy("service").orderBy(F.col("_at").desc_nulls_last(), "id")
    newest = recent.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= CVE_PER_SERVICE)
    grouped = newest.groupBy("service").agg(
        F.array_sort(F.collect_list(F.struct("_r", "_line"))).alias("_lines")  # at most three
    )
    lines = F.array_join(F.transform("_lines", lambda s: s["_line"]), "\n")
    found = fill(CVE_HEADER + "\n{lines}", {
        "n": F.size("_lines").cast("string"), "service": F.col("service"), "lines": lines,
    })
    none = fill(CVE_NONE, {"service": F.col("service")})
    return names.join(grouped, "service", "left").select(
        "service", F.when(F.col("_lines").isNotNull(), found).otherwise(none).alias("cve_summary")
    )


def add_cves(
    alerts: DataFrame, cves: DataFrame, service: str, as_of: Column, out: str = "cve_summary"
) -> DataFrame:
    """Adds the summary to every alert; a service name that is not allowed gets a fixed message."""
    found = recent_cves(alerts, cves, service, as_of).withColumnRenamed("service", "_service")
    keyed = alerts.withColumn("_service", service_name(F.col(service)))
    joined = join_small(keyed, found.withColumnRenamed("cve_summary", "_cves"), ["_service"], "left")
    shown = F.when(F.col("_service").isNull(), F.lit(CVE_INVALID)).otherwise(F.col("_cves"))
    return joined.withColumn(out, shown).drop("_service", "_cves")
