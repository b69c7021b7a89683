"""Sequential operators against plain loops, and hand-made cases."""

import math
import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from vane.functions import text as T
from vane.operators import baseline, bursts, incidents, scan, sequential, severity, traces
from vane.plans.components import connected_components
from vane.plans.ordered import stream_scan
from vane.sources import wire
from vane.streaming import jobs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def series(spark, values, name="m"):
    return spark.createDataFrame([(name, float(v), T0 + timedelta(seconds=i), i) for i, v in enumerate(values)], "name string, value double, timestamp timestamp, seq long")


def test_zscore_is_out_of_sample_and_flat_series_use_the_inclusive_estimate(spark):
    rng = random.Random(1)
    values = [rng.gauss(100, 5) for _ in range(60)]
    got = [r.z for r in baseline.metric_zscore(series(spark, values), "name").orderBy("seq").collect()]
    for i, z in enumerate(got):
        past = values[:i]
        want = None if i + 1 < 12 else (values[i] - np.mean(past)) / np.std(past, ddof=1)
        assert z is None if want is None else math.isclose(z, want, rel_tol=1e-9)
    flat = [7.0] * 20 + [9.0]
    last = baseline.metric_zscore(series(spark, flat), "name").orderBy("seq").collect()
    assert last[-2].z is None and math.isclose(last[-1].z, (9 - np.mean(flat)) / np.std(flat, ddof=1))


def test_changepoints_equal_a_loop(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(100)] + [rng.gauss(4, 1) for _ in range(100)]
    scored = baseline.metric_zscore(series(spark, values), "name")
    rows = scored.orderBy("seq").collect()
    hi = lo = 0.0
    want = []
    for r in rows:
        if r.z is None:
            hi = lo = 0.0
            continue
        hi, lo = max(0.0, hi + r.z - 0.5), max(0.0, lo - r.z - 0.5)
        if max(hi, lo) >= 5:
            want.append(r.seq)
            hi = lo = 0.0
    got = sorted(r.seq for r in baseline.changepoints(scored, "name").collect())
    assert got == want and any(100 <= s < 115 for s in got)


def test_p2_is_near_the_true_quantile():
    rng = random.Random(3)
    values = [rng.random() for _ in range(2000)]
    for p in (0.5, 0.99):
        e = sequential.P2(p)
        for v in values:
            e.observe(v)
        assert abs(e.value() - np.quantile(values, p)) < 0.02


def test_counter_reset_moves_the_baseline(spark):
    got = [r.delta for r in baseline.counter_delta(series(spark, [5, 9, 2, 4]), "value", "name").orderBy("seq").collect()]
    assert got == [None, 4.0, None, 2.0]


def test_host_outliers_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(50, 3, (80, 2))
    x[70] = (80, 20)
    df = spark.createDataFrame([("h", T0 + timedelta(seconds=i), i, float(a), float(b)) for i, (a, b) in enumerate(x)], "host string, timestamp timestamp, seq long, a double, b double")
    got = {r.seq: r for r in baseline.host_outliers(df, ["a", "b"], [0.25, 0.25]).collect()}
    for i in (49, 70, 79):
        d = x[i] - x[: i + 1].mean(0)
        assert math.isclose(got[i].d2, d @ np.linalg.inv(np.cov(x[: i + 1].T)) @ d, rel_tol=1e-6)
    assert got[48].d2 is None and got[70].severity == "critical"


def test_components_of_a_shuffled_chain(spark):
    rng = random.Random(7)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(10_000)]
    edges = [*zip(ids, ids[1:]), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: min(ids) for i in ids} | {5: 5}


def test_components_follow_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_incidents_chain_and_common_sources_do_not_link(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("a", "svc", ["x"], "warning", at(0), "A"), ("b", "detector", ["x", "y"], "critical", at(4), "B"), ("c", "other", ["y"], "info", at(8), "C"), ("d", "detector", [], "info", at(1), "D"), ("e", "detector", [], "info", at(1), "E"), ("f", "svc", ["x"], "info", at(60), "F")]
    df = spark.createDataFrame(rows, "id string, source string, related array<string>, severity string, time timestamp, title string")
    got = {r.incident: (r.members, r.severity, r.story) for r in incidents.incidents(df).collect()}
    assert got == {"a": (3, "critical", "A · B · C"), "d": (1, "info", "D"), "e": (1, "info", "E"), "f": (1, "info", "F")}


def test_depth_and_critical_path(spark):
    rows = [("t", "r", None, "root", 9.0, "ok"), ("t", "a", "r", "a", 5.0, "ok"), ("t", "b", "a", "b", 2.0, "error"), ("t", "x", "gone", "x", 1.0, "ok"), ("u", "p", "q", "p", 1.0, "ok"), ("u", "q", "p", "q", 1.0, "ok")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, name string, duration_ms double, status string")
    depth = {(r.trace_id, r.span_id): r.depth for r in traces.span_depth(df).collect()}
    assert [depth["t", s] for s in "rabx"] == [0, 1, 2, 1]
    assert {r.trace_id: r.path for r in traces.critical_path(df).collect()}["t"] == "root > a > b"


def test_text_functions(spark):
    df = spark.createDataFrame([("  took 15ms from 10.0.0.1 id 0xFF n 3.5 ",)], "m string")
    r = df.select(T.log_template(df.m).alias("t"), T.severity_tokens(df.m).alias("k")).first()
    assert r.t == "took 15ms from <*> id <*> n <*>" and r.k == ["took", "15ms", "from", "id", "0xff"]
    h = 2166136261
    for b in b"error":
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    from pyspark.sql import functions as F

    assert df.select(T.token_bucket(F.lit("error"))).first()[0] == h % 4096
    phrase = lambda a, b: df.select(T.projection_phrase(F.lit(a), F.lit(b))).first()[0]
    assert [phrase(0, 0), phrase(30, 40), phrase(20, 3600), phrase(2520, 0), phrase(2400, 9000)] == ["already spent", "in under a minute", "within 1h", "in about 40m", "in 40m to 2h30m"]
    cut = spark.createDataFrame([("é" * 10,)], "m string").select(scan.cut_bytes(F.col("m"), 5)).first()[0]
    assert cut == "éé"


def test_statsd_gauges_and_malformed_lines(spark):
    rows = [("g:5|g", 0), ("g:+2|g", 1), ("g:-1|g", 2), ("c:3|c|#b,a:1|@0.5", 3), ("bad", 4), ("s:x|s", 5), ("t:1|ms|@0.5", 6), ("t:9|d", 7), ("n:NaN|c", 7), ("c2:3|c|@2|@bad", 8), (":1|c", 8), ("u:1|s", 8)]
    df = spark.createDataFrame([(v, T0 + timedelta(seconds=s), s) for v, s in rows], "value string, timestamp timestamp, seq long")
    rolled = wire.statsd_rollup(df, "10 seconds")
    got = {(r.name, r.tags, r.quantile): r.value for r in rolled.collect()}
    assert got == {("g", "", None): 6.0, ("c", "a:1,b", None): 6.0, ("c2", "", None): 1.5, ("t_count", "", None): 2.0, ("t_sum", "", None): 10.0, ("t", "", "0.5"): 1.0, ("t", "", "0.9"): 1.0, ("t", "", "0.99"): 1.0}
    labels = {(r.name, r.value): r.labels for r in wire.statsd_metrics(rolled).collect()}
    assert labels["c", 6.0] == {"a": "1", "b": ""} and labels["g", 6.0] == {}
    carried = wire.statsd_rollup(df, "10 seconds", carry_seconds=10).where("name = 'g'")
    assert carried.count() == 60


def test_histograms_become_cumulative(spark):
    doc = '{"resourceMetrics":[{"resource":{"attributes":[{"key":"k","value":{"stringValue":"r"}}]},"scopeMetrics":[{"metrics":[{"name":"h","histogram":{"dataPoints":[{"timeUnixNano":"1000000000","count":"6","sum":9.5,"bucketCounts":["1","2","3"],"explicitBounds":[1,5],"attributes":[{"key":"k","value":{"intValue":"7"}}]}]}}]}]}]}'
    got = {(r.name, r.labels.get("le")): (r.value, r.labels["k"]) for r in wire.otlp_metrics(spark.createDataFrame([(doc,)], "value string")).collect()}
    assert got == {("h_count", None): (6.0, "7"), ("h_sum", None): (9.5, "7"), ("h_bucket", "1.0"): (1.0, "7"), ("h_bucket", "5.0"): (3.0, "7")}


def test_summaries_and_exponential_histograms(spark):
    doc = '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"s","summary":{"dataPoints":[{"timeUnixNano":"1000000000","count":"4","sum":8,"quantileValues":[{"quantile":0.5,"value":2}]}]}},{"name":"e","exponentialHistogram":{"dataPoints":[{"timeUnixNano":"9000000000000000","count":"2","sum":3}]}},{"name":"c","sum":{"dataPoints":[{"timeUnixNano":"1000000000","asInt":"7"}]}}]}]}]}'
    got = {(r.name, r.labels.get("quantile")): (r.value, r.timestamp) for r in wire.otlp_metrics(spark.createDataFrame([(doc,)], "value string"), now=F.lit(T0)).collect()}
    assert {k: v[0] for k, v in got.items()} == {("s_count", None): 4.0, ("s_sum", None): 8.0, ("s", "0.5"): 2.0, ("e_count", None): 2.0, ("e_sum", None): 3.0, ("c", None): 7.0}


def test_exposition_drops_a_bad_scrape_whole(spark):
    text = '# HELP x\n# TYPE h histogram\nx{k="v\\"w\\\\n\\n"} 1\ny +Inf\nh_bucket{le="1"} 2 1500\nh_bucket{le="+Inf"} 3\nh_count 3\nx{job="own"} 5\n'
    df = spark.createDataFrame([("a", text), ("b", "x 1\nbroken line here now\n"), ("c", "x{k=oops} 1\n")], "scrape string, value string")
    got = wire.exposition_samples(df, F.create_map(F.lit("job"), F.lit("t")), F.lit(T0)).collect()
    assert {r.scrape for r in got} == {"a"}
    assert sorted((r.name, r.kind, r.value) for r in got) == [("h_bucket", "histogram", 2.0), ("h_bucket", "histogram", 3.0), ("h_count", "histogram", 3.0), ("x", "untyped", 1.0), ("x", "untyped", 5.0), ("y", "untyped", math.inf)]
    labels = {(r.name, r.value): r.labels for r in got}
    assert labels["x", 1.0] == {"job": "t", "k": 'v"w\\n\n'} and labels["x", 5.0] == {"job": "own"} and labels["h_bucket", 3.0] == {"job": "t", "le": "+Inf"}


def test_severity_model_equals_a_loop(spark):
    lines = [(0, "disk failure on node", "error"), (1, "disk ok again", "info"), (2, "node ready", "info"), (3, "failure again", "error")]
    df = spark.createDataFrame(lines, "seq long, message string, severity string")
    hits, classes = severity.severity_fit(df)
    got = {r.seq: (r.predicted, r.confidence) for r in severity.severity_score(df, hits, classes).collect()}
    toks = {i: [t for t in m.split() if len(t) > 1] for i, m, _ in lines}
    for i, _, _ in lines:
        score = {}
        for c in ("error", "info"):
            seen = [t for j, _, s in lines if s == c for t in toks[j]]
            score[c] = math.log(2 / 4) + sum(math.log((seen.count(t) + 0.5) / (len(seen) + 0.5 * 4096)) for t in toks[i])
        best = max(score, key=score.get)
        assert got[i][0] == best and math.isclose(got[i][1], 1 / sum(math.exp(s - score[best]) for s in score.values()), rel_tol=1e-6)


def test_stream_equals_batch(spark, tmp_path):
    from vane.streaming import jobs

    df = series(spark, [float(i % 7) + (50 if i == 40 else 0) for i in range(60)])
    src = str(tmp_path / "in")
    df.repartition(1).write.parquet(src)
    q = jobs.zscore_stream(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("zs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.seq: r.z for r in spark.sql("SELECT * FROM zs").collect()}
    want = {r.seq: r.z for r in baseline.metric_zscore(df, "name").collect()}
    assert got.keys() == want.keys() and all((want[k] is None and got[k] is None) or math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def streamed(spark, df, tmp_path, job, files=3, order="timestamp"):
    """Rows of a stream over df, which comes in several files in order."""
    src = str(tmp_path / "in")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"q{abs(hash(str(tmp_path)))}"
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_slow_spans_and_thresholds_stream_as_in_batch(spark, tmp_path):
    rng = random.Random(9)
    ms = [rng.lognormvariate(3.7, 0.6) for _ in range(600)]
    ms[400:410] = [5_000.0] * 10
    ms[500:] = [x * 4 for x in ms[500:]]
    df = spark.createDataFrame([("svc", T0 + timedelta(seconds=i), f"t{i}", f"s{i:04d}", x, "error" if i == 405 else "ok") for i, x in enumerate(ms)], "service string, start timestamp, trace_id string, span_id string, duration_ms double, status string")
    batch = traces.slow_spans(df, "service", min_samples=40).collect()
    state, want = traces.Latency(), []
    for i, x in enumerate(ms):
        run, p99, _ = state.observe(x, 12, 40, 0.5, 5.0)
        if run >= 3:
            want.append((f"s{i:04d}", run, p99))
    assert sorted((r.span_id, r.run, r.p99) for r in batch) == want and len(want) >= 3
    got = streamed(spark, df, tmp_path, lambda s: traces.slow_spans(s, "service", min_samples=40, scan=stream_scan), order="start")
    assert sorted((r.span_id, r.run, r.p99, r.severity) for r in got) == sorted((r.span_id, r.run, r.p99, r.severity) for r in batch)


def test_log_bursts_stream_as_in_batch(spark, tmp_path):
    times = [*range(0, 200, 25), *range(300, 330, 2), *range(900, 930)]
    rows = [(T0 + timedelta(seconds=s), "error" if s == 310 else "info", "app", f"worker {i} died", i) for i, s in enumerate(times)]
    df = spark.createDataFrame(rows, "timestamp timestamp, severity string, source string, message string, seq long")
    want = {(r.seq, r.recent, r.previous, r.lines, r.errors, r.burst_severity) for r in bursts.log_bursts(df, "source", stretch=400).collect()}
    assert want == {(r.seq, r.recent, r.previous, r.lines, r.errors, r.burst_severity) for r in bursts.log_bursts(df, "source").collect()} and len(want) > 5
    got = streamed(spark, df, tmp_path, lambda s: jobs.log_bursts_stream(s, "source"))
    assert {(r.seq, r.recent, r.previous, r.lines, r.errors, r.burst_severity) for r in got} == want


def test_host_outliers_stream_as_in_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(50, 3, (80, 2))
    x[70] = (80, 20)
    df = spark.createDataFrame([("h", T0 + timedelta(seconds=i), i, float(a), float(b)) for i, (a, b) in enumerate(x)], "host string, timestamp timestamp, seq long, a double, b double")
    want = {r.seq: r for r in baseline.host_outliers(df, ["a", "b"], [0.25, 0.25]).collect()}
    got = {r.seq: r for r in streamed(spark, df, tmp_path, lambda s: jobs.host_outliers_stream(s, ["a", "b"], [0.25, 0.25]))}
    assert all(got[i].severity == want[i].severity and (want[i].d2 is None or math.isclose(got[i].d2, want[i].d2, rel_tol=1e-6)) for i in range(80)) and got[70].severity == "critical"


def test_burn_forecast_cases(spark):
    def run(values, **kw):
        df = spark.createDataFrame([("s", float(3600 * i), float(v)) for i, v in enumerate(values)], "source string, seconds double, consumed double")
        return sequential.burn_forecast(df, "source", **kw).first()

    middle = (100 - 58) / 2 * 3600
    steady = run([2 * i for i in range(30)])  # the first step's error is all there is
    assert 0.9 * middle < steady.soonest < middle < steady.latest < 1.1 * middle
    assert run([2 * i for i in range(19)]).soonest is None
    assert (run([50] * 25 + [100, 100]).soonest, run([50] * 25 + [100, 100]).latest) == (0.0, 0.0)
    assert run([50] * 30).soonest is None and run([60 - i for i in range(30)]).soonest is None
    noisy = [30 + 0.2 * i + (5 if i % 2 else -5) for i in range(60)]
    assert run(noisy, horizon_hours=1e6).soonest is None  # the trend does not stand out of the errors
    beyond = run([2 * i for i in range(30)], horizon_hours=steady.latest / 3600 - 0.1)
    assert math.isclose(beyond.soonest, steady.soonest) and beyond.latest == 0.0


def test_paging_learns_templates_apart(spark):
    rows = []
    for i in range(60):
        for t, y in (("disk", True), ("chat", False)):
            rows.append(("all", t, 1_000_000 * (600 * i + (t == "chat")), i, y, 1_000_000 * (600 * i + 300), 1.0, 0.5, 0.5, 0.0, True))
    cols = "source string, template string, opened bigint, seq bigint, followed boolean, resolved bigint, f_bias double, f_errors double, f_ratio double, f_critical double, rule boolean"
    graded = bursts.paging_graded(spark.createDataFrame(rows, cols), "source", "template", scope=["source"])
    ready = bursts.paging_readiness(graded, "source").first()
    assert ready.accuracy >= 0.85 and ready.rule_accuracy == 0.5 and ready.ready
    w = {r.template: r.w_bias for r in bursts.paging_fit(graded, "source", "template").collect()}
    assert w["disk"] > 0 > w["chat"]


def test_numbers_levels_and_states(spark, tmp_path):
    one = spark.range(1)
    text = lambda f, *vs: [one.select(f(F.lit(v))).first()[0] for v in vs]
    assert text(T.compact_number, 0.042, 1240.0, 42.4, 100_000.0, 0.0, -1.5e6, 2.34e9, 0.5) == ["0.042", "1.2k", "42", "100k", "0", "-1.5M", "2.3B", "0.5"]
    assert text(T.duration_text, 0.4, 940.0, 1250.0, 90_000.0) == ["0.4ms", "940ms", "1.25s", "1.5min"]
    level = lambda n, t: one.select(T.otlp_severity(F.lit(n).cast("int"), F.lit(t))).first()[0]
    assert [level(None, t) for t in ("WARNING", " fatal ", "trace", "critical", "panic", "information", None)] == ["warn", "error", "debug", "error", "error", "info", "info"] and level(13, "debug") == "warn"
    assert text(T.known_severity, " WARN ", "notice") == ["warn", None] and text(T.container_name, "/web") == ["web"] and text(T.short_id, "0123456789abcdef") == ["0123456789ab"]
    from vane.plans import state

    state.save_state({"a": one, "b": one}, str(tmp_path), {"a": 1, "b": 1})
    assert set(state.load_state(spark, str(tmp_path), {"a": 1, "b": 2, "c": 1})) == {"a"}
    df = spark.createDataFrame([(T0, 1.0)], "at timestamp, value double")
    from vane.operators import report

    wrote, row = report.export_if_changed(df, str(tmp_path / "x"), None, "m", "at")
    again, _ = report.export_if_changed(df, str(tmp_path / "x"), row, "m", "at")
    moved, _ = report.export_if_changed(df.withColumn("at", F.lit(T0 + timedelta(minutes=1))), str(tmp_path / "x"), row, "m", "at")
    assert (wrote, again, moved) == (True, False, True)
    dated = spark.createDataFrame([("2024-01-02T00:00:00Z",), ("2023-01-01T00:00:00Z",), ("soon",)], "time string")
    assert sorted(r.time for r in scan.since_or_undated(dated, T0).collect()) == ["2024-01-02T00:00:00Z", "soon"]


def test_changepoints_by_day_equal_one_pass_for_any_chunk(spark):
    rng = random.Random(12)
    rows = []
    for name, n in (("a", 900), ("b", 40), (None, 30)):
        for i in range(n):
            z = None if rng.random() < 0.01 else 0.501 if name == "a" and 300 < i < 700 else rng.gauss(0.4, 1.5)  # a long stretch in which nothing is forgotten
            rows.append((name, T0 + timedelta(hours=i), i, z))
    df = spark.createDataFrame(rows, "name string, timestamp timestamp, seq long, z double")
    from vane.plans.ordered import ordered_scan

    want = sorted((str(r.name), r.seq, round(r.arm, 9), r.direction) for r in baseline.changepoints(df, "name", scan=ordered_scan).collect())
    got = sorted((str(r.name), r.seq, round(r.arm, 9), r.direction) for r in baseline.changepoints(df, "name").collect())
    assert got == want and len(want) > 10
    assert baseline.changepoints(df.limit(0), "name").count() == 0


def depth_loop(spans):
    parents = dict(spans)
    out = {}
    for s in parents:
        chain, at = [], s
        while parents[at] in parents and at not in chain:
            chain.append(at)
            at = parents[at]
        if at in chain:
            cycle = chain[chain.index(at) :]
            way, x = 1, parents[at]
            while x != min(cycle):
                way, x = way + 1, parents[x]
            out[s] = way + chain.index(at)
        else:
            out[s] = len(chain) + (parents[at] is not None)
    return out


def test_deep_branching_and_cyclic_traces_in_steps(spark):
    rng = random.Random(3)
    traces_of = {"chain": [(i, i - 1 if i else None) for i in range(150)], "tree": [(i, rng.randrange(i) if i else None) for i in range(320)], "lost": [(1, 99), (2, 1), (3, 2)]}
    traces_of["cycles"] = [(10, 12), (11, 10), (12, 11), (1, 11), (2, 1), (20, 20), (21, 20), (30, None), (31, 30), (5, 2)]
    rows = [(t, s, p, f"n{s}", "error" if t == "tree" and s in (57, 300) else "ok", float(s % 17)) for t, spans in traces_of.items() for s, p in spans] + [(None, 1, None, "x", "ok", 1.0), ("lost", None, 1, "y", "ok", 1.0)]
    df = spark.createDataFrame(rows, "trace_id string, span_id long, parent_id long, name string, status string, duration_ms double").repartition(4)
    want = {(t, s): d for t, spans in traces_of.items() for s, d in depth_loop(spans).items()}
    for large in (10**6, 2):
        assert {(r.trace_id, r.span_id): r.depth for r in traces.span_depth(df, large=large).collect()} == want
    paths = [{r.trace_id: r.path for r in traces.critical_path(df, large=large).collect()} for large in (10**6, 2)]
    assert paths[0] == paths[1] and paths[0].keys() == traces_of.keys() and paths[0]["chain"].count(" > ") == 149 and paths[0]["lost"] == "n1 > n2 > n3"


def test_metric_forecast_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(n, T0 + timedelta(minutes=i), rng.gauss(50, 4) + i * k) for n, k in (("a", 0.3), ("b", -0.1)) for i in range(120)] + [("c", T0, 7.0)]
    got = {(r.name, r["at"].replace(tzinfo=timezone.utc)): r.value for r in sequential.metric_forecast(spark.createDataFrame(rows, "name string, at timestamp, value double").repartition(5)).select("name", F.col("at").cast("timestamp_ntz").alias("at"), "value").collect()}
    for name in "abc":
        ys = [y for n, _, y in rows if n == name]
        level, trend = ys[0], 0.0
        for y in ys[1:]:
            before = level
            level = 0.3 * y + 0.7 * (level + trend)
            trend = 0.1 * (level - before) + 0.9 * trend
        for h in (5, 15, 30, 60):
            assert math.isclose(got[name, T0 + timedelta(minutes=len(ys) - 1 + h)], level + h * trend, rel_tol=1e-9)


def test_outliers_beside_an_open_series_are_not_alone(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    out = spark.createDataFrame([("h", at(10), 1), ("h", at(300), 2), ("g", at(10), 3), ("h", at(61), 4)], "host string, timestamp timestamp, seq long")
    episodes = spark.createDataFrame([("h", at(5), at(70)), ("g", at(11), at(400))], "host string, opened timestamp, last_seen timestamp")
    assert sorted(r.seq for r in incidents.alone(out, episodes).collect()) == [2, 3]


def test_answers_come_from_the_model_only_while_it_is_ready_and_sure(spark):
    scored = spark.createDataFrame([(1, "all fine", "warn", 0.9), (2, "disk error", "info", 0.5), (3, "disk failed", None, None)], "seq long, message string, predicted string, confidence double")
    for ready, want in ((True, {1: ("warn", "model"), 2: ("error", "rule"), 3: ("error", "rule")}), (False, {1: ("info", "rule"), 2: ("error", "rule"), 3: ("error", "rule")}), (None, {1: ("info", "rule"), 2: ("error", "rule"), 3: ("error", "rule")})):
        one = spark.createDataFrame([(ready,)], "ready boolean")
        assert {r.seq: (r.severity_answer, r.answered_by) for r in severity.classify(scored, one).collect()} == want


def test_paging_scores_wait_for_readiness_and_use_shared_weights(spark):
    graded = spark.createDataFrame([("s", "disk", 1, 1, 1, 0.0, 1.0, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0), ("s", "disk", 2, 2, 2, 1.0, 1.0, 0.0, 0.0, 0.25, 0.5, 0.0, 0.0)], "source string, template string, resolved long, opened long, seq long, w_bias double, w_errors double, w_ratio double, w_critical double, s_bias double, s_errors double, s_ratio double, s_critical double")
    weights = bursts.paging_fit(graded, "source", "template", scope=("source",))
    b = spark.createDataFrame([("s", "disk", 1.0, 0.5, 0.1, 1.0), ("s", "new", 1.0, 0.5, 0.1, 1.0), ("t", "disk", 1.0, 0.5, 0.1, 1.0)], "source string, template string, f_bias double, f_errors double, f_ratio double, f_critical double")
    score = lambda ready: {(r.source, r.template): r.paging_score for r in bursts.paging_score(b, weights, spark.createDataFrame([("s", ready)], "source string, ready boolean"), "source", "template", scope=("source",)).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    got = score(True)
    assert math.isclose(got["s", "disk"], sigmoid(1.0 + 0.5)) and math.isclose(got["s", "new"], sigmoid(0.25 + 0.25)) and got["t", "disk"] is None
    assert set(score(False).values()) == {None}


def test_rolling_accuracy_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [("s", i, i, rng.random() < 0.7, rng.random() < 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, resolved long, opened long, hit boolean, rule_hit boolean")
    for r in bursts.rolling_accuracy(df, "source", last=7).collect():
        frame = rows[max(0, r.opened - 6) : r.opened + 1]
        assert r.seen == len(frame) and math.isclose(r.accuracy, sum(x[3] for x in frame) / len(frame)) and math.isclose(r.rule_accuracy, sum(x[4] for x in frame) / len(frame))


def test_culprits_by_memory_and_cold_processes(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    p = [(1, "cpu", 50.0, 2.0, 10), (1, "memory", 9e8, 4.0, 20), (2, "cpu", 90.0, 3.0, 30), (3, "cpu", 95.0, 1.0, 30), (4, "cpu", 40.0, None, 30), (5, "cpu", 10.0, None, 30), (6, "memory", 5e8, 1.6, 5), (6, "memory", 5e8, 1.4, 40), (7, "cpu", 99.0, 9.0, -700)]
    df = spark.createDataFrame([("h", pid, at(s), i, m, v, z) for i, (pid, m, v, z, s) in enumerate(p)], "host string, pid long, timestamp timestamp, seq long, metric string, value double, sigma double")
    a = spark.createDataFrame([("h", at(100))], "host string, timestamp timestamp")
    got = [(r.pid, r.metric, r.value, r.sigma) for r in sorted(incidents.culprits(a, df).collect(), key=lambda r: r["rank"])]
    assert got == [(1, "memory", 9e8, 4.0), (2, "cpu", 90.0, 3.0), (4, "cpu", 40.0, None)]  # 3 and 6 are at their normal, 5 is cold and idle, 7 long gone
    rows = incidents.culprit_rows(incidents.culprits(a, df)).collect()
    assert {r.metric for r in rows} == {"process.cpu", "process.memory"} and {r.title for r in rows} == {"pid 1: memory, sigma 4.0", "pid 2: cpu, sigma 3.0", "pid 4: cpu 40%"}


def test_critical_marks_are_of_every_kind_but_bursts(spark):
    kind = "id string, kind string, severity string, source string, time timestamp, related array<string>"
    rows = [("a", "anomaly", "critical", "x", T0, ["r"]), ("a", "anomaly", "critical", "x", T0, ["r"]), ("a", "anomaly", "critical", "x", T0 + timedelta(1), None), ("b", "log_burst", "critical", "x", T0, None), ("c", "slow_span", "critical", "y", T0, None), ("d", "host_outlier", "warning", "z", T0, None)]
    got = [(r.id, r.source) for r in incidents.critical_marks(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got) == [("a", "x"), ("a", "x"), ("c", "y")]


def test_cards_and_all_findings(spark):
    from vane import catalog

    sf = "/root/testdata/sf0.001"
    cards = {r.name: r for r in catalog.QUERIES["model_cards"](spark, sf).collect()}
    ready = catalog.QUERIES["severity_readiness"](spark, sf).first()
    assert len(cards) == 7 and (cards["log severity"].trained, cards["log severity"].accuracy, cards["log severity"].ready) == (ready.trained, ready.accuracy, ready.ready)
    assert cards["span latency"].trained == catalog.tables.spans(spark, sf).count() and cards["culprits"].accuracy == -1
    found = catalog.QUERIES["all_insights"](spark, sf).toPandas()
    counts = found.groupby("kind").size().to_dict()
    assert counts["anomaly"] == catalog.QUERIES["metric_anomalies"](spark, sf).count() and counts["changepoint"] == catalog.QUERIES["changepoints"](spark, sf).count()
    assert counts["culprit"] == catalog.QUERIES["culprits"](spark, sf).count() and found.id.is_unique


def test_daily_thresholds_keep_their_rates(spark):
    rng = np.random.default_rng(7)
    days, n = 10, 8_000
    z = np.abs(np.concatenate([rng.normal(size=days * n), rng.standard_t(3, size=days * n)]))
    rows = spark.range(2 * days * n).select(F.when(F.col("id") < days * n, "good").otherwise("heavy").alias("name"), F.timestamp_micros(F.lit(int(T0.timestamp() * 1e6)) + (F.col("id") % (days * n)) * (86_400_000_000 // n)).alias("timestamp"), F.col("id").alias("seq"))
    import pandas as pd

    values = spark.createDataFrame(pd.DataFrame({"seq": np.arange(len(z)), "z": z}))
    graded = sequential.daily_thresholds(rows.join(values, "seq"), "name")
    late = graded.where(F.col("timestamp") >= F.lit(T0 + timedelta(days=4)))
    rates = {r.name: r for r in sequential.threshold_rates(late, "name").collect()}
    assert 0.0005 < rates["good"].warn_rate < 0.0016 and rates["good"].page_rate < 0.0005 and 3.1 < rates["good"].warn < 3.5
    assert rates["heavy"].warn_rate < 0.006 and rates["heavy"].warn > 9  # the ceiling holds it
    first = graded.where(F.col("timestamp") < F.lit(T0 + timedelta(days=1))).select("warn", "critical").distinct().collect()
    assert [(r.warn, r.critical) for r in first] == [(3.0, 5.0)]


def test_exported_texts_come_back_as_they_are(spark, tmp_path):
    from vane.operators import report

    texts = ["plain", " lead", "cut behind a blank ", "\ttab\t", "a\rb", "x\r", "a\r\nb", "l1\nl2", '"', '""', 'a"b', "a\\", '\\"', "a,b", "#c", "\0z", "z\0", " ", "ends, "]
    for at, columns in enumerate((("i", "m"), ("m", "i"))):  # a blank at a line's end, and before a comma
        report.export_csv(spark.createDataFrame(list(enumerate(texts)), "i int, m string").select(*columns), str(tmp_path / f"x{at}"))
        back = report.read_csv(spark, str(tmp_path / f"x{at}"), ", ".join({"i": "i int", "m": "m string"}[c] for c in columns))
        assert [r.m for r in back.orderBy("i").collect()] == texts
    long = spark.createDataFrame([("x" * 4095 + " y",)], "message string").select(scan.cut_bytes(F.col("message")).alias("message"))
    report.export_csv(long, str(tmp_path / "long"))
    assert report.read_csv(spark, str(tmp_path / "long"), "message string").first().message == "x" * 4095 + " "


def test_culprits_equal_a_loop_and_join_nothing(spark):
    rng = random.Random(11)
    at = lambda s: T0 + timedelta(seconds=s)
    points = [(rng.choice("gh"), rng.randrange(12), rng.randrange(0, 4_000, 5), i, rng.choice(["cpu", "memory"]), float(rng.randrange(60)), rng.choice([None, 1.0, 1.5, 2.0, rng.uniform(0, 4)])) for i in range(1_500)]
    asked = sorted({(rng.choice("ghi"), rng.randrange(0, 6_000, 5)) for _ in range(400)})
    want = []
    for host, t in asked:
        last = {}
        for p in sorted(points, key=lambda p: (p[2], p[3])):
            if p[0] == host and t - 600 < p[2] <= t:
                last[p[1], p[4]] = p[5:]
        states = []
        for pid in {k[0] for k in last}:
            (cpu, zc), (mem, zm) = last.get((pid, "cpu"), (None, None)), last.get((pid, "memory"), (None, None))
            metric, value, z = ("memory", mem, zm) if zm is not None and (zc is None or zm > zc) else ("cpu", cpu, zc)
            if z is not None and z >= 1.5 or z is None and value is not None and value >= 20:
                states.append((z is None, -(value if z is None else z), pid, metric, value, z))
        want += [(host, at(t).replace(tzinfo=None), rank, *s[2:]) for rank, s in enumerate(sorted(states)[:3], 1)]
    a = spark.createDataFrame([(h, at(t)) for h, t in [*asked, *asked[:50]]], "host string, timestamp timestamp")
    df = spark.createDataFrame([(h, pid, at(s), i, m, v, z) for h, pid, s, i, m, v, z in points], "host string, pid long, timestamp timestamp, seq long, metric string, value double, sigma double").repartition(5)
    found = incidents.culprits(a, df)
    got = found.withColumn("opened", F.col("opened").cast("timestamp_ntz")).collect()
    assert len(want) > 300 and sorted(map(tuple, got), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # every anomaly met every point of its host's day


def test_standing_processes_that_ended_leave():
    s = incidents.Standing(2)
    for t in range(20_000):
        s.enter(t, t + 10, (False, -float(t % 7), True, t), (t,))
    live = [(-(t % 7), t) for t in range(19_990, 20_000)]
    assert [x[0] for x in s.best(19_999)] == [t for _, t in sorted(live)[:2]] and len(s.heap) <= 1_025
