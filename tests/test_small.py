"""Small functions and readers with expected values."""

import json
import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vane.functions import text as T
from vane.operators import incidents, report, rollup, scan, severity
from vane.plans.expiring import use_timers
from vane.sources import wire

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_percent_bytes_ratios_and_sigmoid(spark):
    one = spark.range(1)
    of = lambda f, *vs: one.select(f(*[F.lit(v) for v in vs])).first()[0]
    assert [of(T.percent_text, v) for v in (12.0, 12.34, 0.05, 100.0)] == ["12%", "12.3%", "0.1%", "100%"]
    assert [of(T.bytes_text, v) for v in (2048, 1048575, 5 * 1048576)] == ["2 KB", "1024 KB", "5.0 MB"]
    assert [of(T.burst_ratio, a, b) for a, b in ((9, 0), (9, 3), (1, 4))] == [9.0, 3.0, 0.25]
    assert math.isclose(of(T.sigmoid, 1.5), 1 / (1 + math.exp(-1.5))) and [of(T.tone_of, s) for s in ("critical", "warning", "info")] == ["danger", "warning", "accent"]


def test_read_limits_are_checked(spark):
    df = spark.range(5).select(F.lit("m").alias("name"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("timestamp"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"))
    assert [r.seq for r in scan.query_metrics(df, limit=2).orderBy("seq").collect()] == [3, 4] and scan.query_metrics(df).count() == 5
    for bad in (0, -1, scan.MAX_LIMIT + 1):
        with pytest.raises(ValueError):
            scan.query_metrics(df, limit=bad)


def test_fan_out_caps_and_future_clamp(spark):
    doc = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": "9000000000000000000", "count": "6", "bucketCounts": ["1", "2", "3"], "explicitBounds": [1, 5]}]}}, {"name": "s", "summary": {"dataPoints": [{"timeUnixNano": "1000000000", "count": "4", "quantileValues": [{"quantile": q, "value": 2} for q in (0.1, 0.5, 0.9)]}]}}]}]}]}
    payload = spark.createDataFrame([(json.dumps(doc),)], "value string")
    rows = wire.otlp_metrics(payload, now=F.lit(T0), max_buckets=1, max_quantiles=2).collect()
    assert sorted((r.name, r.labels.get("le") or r.labels.get("quantile")) for r in rows if r.labels) == [("h_bucket", "1.0"), ("s", "0.1"), ("s", "0.5")]
    assert {r.name for r in wire.otlp_metrics(payload, now=F.lit(T0)).where(F.col("timestamp") == F.lit(T0)).collect()} == {"h_count", "h_bucket"}
    assert wire.otlp_metrics(payload).count() == 7


def test_log_files_with_a_model_and_as_a_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "web.log").write_text("disk gone bad\n\n" + "x" * 200 + "\nall fine here\nfatal words\n")
    known = spark.createDataFrame([(f"disk gone bad {i}", "error") for i in range(30)] + [(f"all fine here {i}", "debug") for i in range(30)], "message string, severity string")
    rows = wire.ingest_log_files(spark, str(folder), max_bytes=100, model=severity.severity_fit(known)).collect()
    assert {(r.source, r.message): r.severity for r in rows} == {("web", "disk gone bad"): "error", ("web", "all fine here"): "debug", ("web", "fatal words"): "error"} and all(r.severity_inferred for r in rows)
    use_timers(spark)
    q = wire.ingest_log_files(spark, str(folder), max_bytes=100, stream=True).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (folder / "web.log.1").write_text("warned once\n")  # a rotated file is another file
    q.processAllAvailable()
    q.stop()
    assert {(r.source, r.message, r.severity) for r in spark.sql("SELECT * FROM tailed").collect()} == {("web", "disk gone bad", "info"), ("web", "all fine here", "info"), ("web", "fatal words", "error"), ("web.log", "warned once", "warn")}


def test_findings_as_json_and_payloads(spark):
    kind = "id string, kind string, severity string, title string, description string, source string, metric string, value double, time timestamp, related array<string>"
    rows = [("b", "anomaly", "warning", "late\nline", "d" * 30, "s", "m", 1.5, T0 + timedelta(1), ["r"]), ("a", "anomaly", "critical", "first", "x", "s", None, 2.0, T0, None)]
    df = spark.createDataFrame(rows, kind)
    assert {json.loads(r.value)["id"] for r in report.findings_json(df).collect()} == {"a", "b"}
    payload = json.loads(report.insight_payload(df, "source", most=10).first().payload)
    assert [(p["rank"], p["title"], p["description"]) for p in payload] == [(1, "first", "x"), (2, "late line", "d" * 10 + "…")]
    clusters = spark.createDataFrame([("t1", "s", 5, 1), ("t2", "s", 9, 0)], "template string, source string, lines long, errors long")
    doc = json.loads(report.summary_document(df, clusters, n_insights=1).first().payload)
    assert [i["title"] for i in doc["insights"]] == ["first"] and [c["template"] for c in doc["clusters"]] == ["t2", "t1"] and doc["clusters"][1]["errorCount"] == 1
    empty = json.loads(report.summary_document(df.limit(0), clusters.limit(0)).first().payload)
    assert empty == {"insights": [], "clusters": []}
    assert [r[0] for r in spark.range(1).select(incidents.event_text(F.lit("k"), F.array(F.lit("a"), F.lit("b")))).collect()] == ["k · a → b"]


def test_unknown_and_stale_services_come_first(spark):
    now = T0 + timedelta(minutes=10)
    seen = spark.createDataFrame([("a", now), ("b", T0), ("c", None), ("d", now)], "service string, last_seen timestamp")
    found = spark.createDataFrame([("a", "warning"), ("b", "critical"), ("c", "critical")], "service string, severity string")
    got = {r.service: r.status for r in rollup.service_status(found, "service", seen, F.lit(now)).collect()}
    assert got == {"a": "degraded", "b": "stale", "c": "unknown", "d": "operational"}
