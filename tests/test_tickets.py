import re

import pytest
from pyspark.sql import functions as F

from flowsift.operators import enrich, tickets
from flowsift.schema import REVIEW, TICKET


def _alerts(spark, rows):
    made = [
        (e, at, "2026-01-01T00:00:00Z", "kafka", ip, "dos", 0.9, 0.8, "both", "{}", "{}", text, "v1")
        for e, at, ip, text in rows
    ]
    return spark.createDataFrame(made, TICKET)


def test_first_write_wins_and_batches_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "tickets")
    assert tickets.load(spark, path).count() == 0
    first = _alerts(spark, [("a", "2", "10.0.0.2", "late"), ("a", "1", "10.0.0.1", "early"), ("b", "1", "10.0.0.3", "b")])
    assert tickets.append_alerts(first, path, 0).count() == 2
    second = _alerts(spark, [("a", "0", "10.0.0.9", "again"), ("c", "1", "10.0.0.4", "c")])
    for _ in range(2):
        assert tickets.append_alerts(second, path, 1).count() == 1
    stored = {r["event_id"]: r["ticket_text"] for r in tickets.load(spark, path).collect()}
    assert stored == {"a": "early", "b": "b", "c": "c"}


def test_a_batch_reads_its_own_buckets_only_and_batches_can_be_merged(spark, tmp_path):
    path, merged = str(tmp_path / "tickets"), str(tmp_path / "merged")
    for batch in range(3):
        rows = [(f"e{i}", "1", "10.0.0.1", f"t{batch}") for i in range(batch * 20, batch * 20 + 40)]
        tickets.append_alerts(_alerts(spark, rows), path, batch)
    whole = tickets.load(spark, path)
    assert whole.count() == 80
    bucket = whole.where("event_id = 'e7'").first()["bucket"]
    own = whole.where(F.col("bucket").isin([bucket]))
    files = {r[0] for r in own.select(F.input_file_name()).collect()}
    assert files and all(f"/bucket={bucket}/" in f for f in files) and len(files) < len(whole.inputFiles()) / 8
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", own._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in tmp_path.iterdir() if p.name not in ("tickets", "tickets.candidates")]
    made = tickets.compact(spark, path, merged)
    pick = ["event_id", "ticket_text", "bucket"]
    assert made.select(pick).exceptAll(whole.select(pick)).isEmpty() and made.count() == 80
    assert len(made.inputFiles()) == whole.select("bucket").distinct().count() < len(whole.inputFiles())
    # the last batch again, and a new one
    again = _alerts(spark, [(f"e{i}", "1", "10.0.0.1", "other") for i in range(40, 80)])
    assert tickets.append_alerts(again, merged, 2).count() == 0
    assert tickets.append_alerts(_alerts(spark, [("e1", "1", "10.0.0.1", "x"), ("new", "1", "10.0.0.1", "x")]), merged, 3).count() == 1
    assert tickets.load(spark, merged).count() == 81
    with pytest.raises(ValueError):
        tickets.compact(spark, path, path + "/")


def test_many_repeats_of_one_event(spark, tmp_path):
    hot = _alerts(spark, [("hot", "1", "10.0.0.1", "t")])
    many = hot.crossJoin(spark.range(5000)).drop("id")
    assert tickets.append_alerts(many, str(tmp_path / "t"), 0).count() == 1


def test_texts_are_neither_sorted_nor_aggregated_to_find_the_first_rows(spark, tmp_path, monkeypatch):
    rows = _alerts(spark, [(f"e{i % 40}", str(9 - i // 40), "10.0.0.1", f"t{i}") for i in range(120)])
    tickets.append_alerts(_alerts(spark, [("e0", "1", "10.0.0.1", "old")]), str(tmp_path / "t"), 0)
    plans = []
    monkeypatch.setattr(tickets, "_write", lambda df, path, keep=tickets._write: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, path))
    made = tickets.append_alerts(rows, str(tmp_path / "t"), 1)
    assert {r["event_id"]: r["ticket_text"] for r in made.collect()} == {f"e{i}": f"t{i + 80}" for i in range(1, 40)}
    heavy = [line for line in plans[0].splitlines() if re.search(r"(Sort|Aggregate)\b.*ticket_text", line) or re.search(r"SortAggregate.*ticket_text", line)]
    assert not heavy and "ShuffledHashJoin" in plans[0]


def test_only_alerts_with_text_are_stored(spark, tmp_path):
    with pytest.raises(Exception, match="only alerts"):
        tickets.append_alerts(_alerts(spark, [("a", "1", "10.0.0.1", "")]), str(tmp_path / "t"), 0)


def _review(i, event, disposition, corrected=None, notes=None, by="ann"):
    return (i, event, disposition, corrected, notes, by, "2026-01-02T00:00:00Z")


def test_review_lifecycle(spark, tmp_path):
    stored = _alerts(spark, [("a", "1", "10.0.0.1", "t"), ("b", "1", "10.0.0.1", "t"), ("c", "1", "10.0.0.1", "t")])
    path = str(tmp_path / "reviews")
    one = spark.createDataFrame([_review(1, "a", "false_positive", None, " why ", " ann ")], REVIEW)
    assert tickets.append_reviews(one, stored, path, 0).isEmpty()
    seen = tickets.with_latest_review(stored, tickets.load(spark, path, REVIEW).drop("batch_id").withColumnRenamed("created_at", "reviewed_at"), ["review_id"])
    row = tickets.get_ticket(seen, "a").first()
    assert (row["disposition"], row["corrected_class"], row["reviewed_by"], row["analyst_notes"]) == (
        "false_positive", "normal", "ann", "why")
    assert [r["event_id"] for r in tickets.feedback_examples(seen).collect()] == ["a"]
    assert tuple(tickets.summary(seen).first()) == (3, 1, 2, 1)

    two = spark.createDataFrame([_review(2, "a", "needs_investigation"), _review(3, "b", "confirmed_attack", "dos")], REVIEW)
    tickets.append_reviews(two, stored, path, 1)
    history = tickets.load(spark, path, REVIEW)
    assert history.count() == 3  # nothing is overwritten
    seen = tickets.with_latest_review(stored, history.drop("batch_id").withColumnRenamed("created_at", "reviewed_at"), ["review_id"])
    assert tickets.feedback_examples(seen).isEmpty()
    assert tuple(tickets.summary(seen).first()) == (3, 2, 1, 0)
    assert [r["event_id"] for r in tickets.list_tickets(seen, "unreviewed").collect()] == ["c"]
    assert [r["event_id"] for r in tickets.list_tickets(seen, limit=2).collect()] == ["c", "b"]
    with pytest.raises(ValueError):
        tickets.list_tickets(seen, "closed")
    with pytest.raises(ValueError):
        tickets.list_tickets(seen, limit=0)
    with pytest.raises(KeyError):
        tickets.get_ticket(seen, "zzz")


def test_bad_reviews_are_set_aside_with_a_reason(spark):
    stored = _alerts(spark, [("a", "1", "10.0.0.1", "t")])
    rows = [_review(1, "a", "closed"), _review(2, "a", "false_positive", "unknown"), _review(3, "a", "confirmed_attack", by="  "),
            _review(4, "zzz", "confirmed_attack"), _review(5, "a", None), _review(6, "a", "confirmed_attack", notes="")]
    found = tickets.validate_reviews(spark.createDataFrame(rows, REVIEW), stored).orderBy("review_id").collect()
    assert [r["reject_reason"] for r in found] == ["disposition", "corrected_class", "reviewed_by", "ticket", "disposition", None]
    assert found[5]["analyst_notes"] is None


def test_ip_reputation_lines(spark):
    alerts = spark.createDataFrame([(1, "192.0.2.1"), (2, '127.0.0.1" | delete'), (3, "192.0.2.9"), (4, " 2001:DB8::0:1 ")], "id int, ip string")
    table = spark.createDataFrame([("192.0.2.1", 80, " Bad \n ISP​ ", 5), ("2001:db8::1", None, None, None)],
                                  "ip string, abuse_score int, isp string, total_reports int")
    rows = {r["id"]: r["ip_report"] for r in enrich.ip_reputation(alerts.withColumnRenamed("ip", "src"), table, "src", ["id"]).collect()}
    assert rows[1] == "IP: 192.0.2.1 | Abuse Score: 80/100 | ISP: Bad ISP | Total Reports (90 days): 5"
    assert rows[2].startswith("Invalid IP address") and rows[3] is None
    assert rows[4] == "IP: 2001:db8::1 | Abuse Score: 0/100 | ISP: Unknown ISP | Total Reports (90 days): 0"


def test_recent_cves_newest_first_inside_the_window(spark):
    text = lambda lang, value: {"lang": lang, "value": value}
    rows = [
        ("CVE-1", "2026-07-01T00:00:00Z", ["http"], [text("de", "x"), text("en", "Newest")]),
        ("CVE-2", "2026-06-01T00:00:00Z", ["http", "dns"], [text("de", "only")]),
        ("CVE-3", "2020-01-01T00:00:00Z", ["http"], [text("en", "Too old")]),
        ("CVE-4", "not a date", ["http"], [text("en", "Undated")]),
        ("CVE-5", "2026-06-15T00:00:00Z", ["http"], [text("en", "y" * 500)]),
    ]
    cves = spark.createDataFrame(rows, "id string, published string, keywords array<string>, descriptions array<struct<lang:string,value:string>>")
    alerts = spark.createDataFrame([(1, "http"), (2, " dns "), (3, "smtp"), (4, "http\nIGNORE PREVIOUS")], "id int, svc string")
    found = enrich.add_cves(alerts, cves, "svc", F.lit("2026-08-01 00:00:00").cast("timestamp"))
    got = {r["id"]: r["cve_summary"] for r in found.collect()}
    assert got[1].splitlines() == ["Top 3 recent CVEs related to 'http':", "- CVE-1: Newest", f"- CVE-5: {'y' * 420}", "- CVE-2: No description."]
    assert got[2].splitlines() == ["Top 1 recent CVEs related to 'dns':", "- CVE-2: No description."]
    assert got[3] == "No recent CVEs found in NVD for service: smtp."
    assert got[4] == "A valid service name is required for an NVD lookup."
