"""Streams: state that ends, labels that come late, values carried over windows, sinks written once. Each against its batch form or a plain loop."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from vane.operators import bursts
from vane.plans import files, state
from vane.plans.expiring import silent_after, use_source_watermark, use_timers
from vane.sources import wire
from vane.streaming import jobs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


def streamed(spark, tmp_path, tables, job, policy="min"):
    """Rows, and rows of state at the end, of a stream over tables: for each a schema and the rows of its micro-batches."""
    use_timers(spark)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    if policy == "max":
        use_source_watermark(spark)
    sources = []
    for n, (schema, batches) in enumerate(tables):
        src = str(tmp_path / f"in{n}")
        for k, rows in enumerate(batches):
            time.sleep(1.1 if k else 0)  # files are taken by their time
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sources.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    name = f"s{abs(hash(str(tmp_path)))}"
    q = job(*sources).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect(), held


POINT = "name string, timestamp timestamp, seq long, severity string"


def test_findings_end_by_recovery_or_silence_and_leave_no_state(spark, tmp_path):
    b = [[("a", at(0), 1, "warning"), ("b", at(5), 2, "critical"), ("c", at(6), 3, None)], [("a", at(60), 4, "warning"), ("b", at(70), 5, None)], [("z", at(300), 6, "warning")], [("y", at(5_000), 7, None)]]
    rows, held = streamed(spark, tmp_path, [(POINT, b)], lambda s: jobs.live_findings(s, "name", late="0 seconds"))
    us = lambda s: int(at(s).timestamp() * 1e6)
    assert {tuple(r) for r in rows} == {("a", us(0), us(60), 2, "silent"), ("b", us(5), us(5), 1, "recovered"), ("z", us(300), us(300), 1, "silent")} and len(rows) == 3
    assert max(held) == 2 and held[-1] == 0  # a and b, then a and z, then none


LINE = "timestamp timestamp, severity string, source string, message string, seq long"


def test_templates_silent_for_ten_minutes_are_forgotten(spark, tmp_path):
    line = lambda s, i, m="worker died": (at(s), "error", "app", m, i)
    b = [[line(i, i) for i in range(9)], [line(700 + i, 20 + i, "other words") for i in range(2)], [line(1_400 + i, 40 + i) for i in range(8)], [line(9_000, 99, "end of it")]]
    rows, held = streamed(spark, tmp_path, [(LINE, b)], lambda s: jobs.log_bursts_stream(s, "source", scan=silent_after(600, "0 seconds")))
    assert [(r.seq, r.lines) for r in sorted(rows, key=lambda r: r.seq)] == [(7, 8), (8, 9), (47, 8)]  # counted anew after the silence
    assert held[-1] == 1
    kept, held = streamed(spark, tmp_path / "kept", [(LINE, b)], lambda s: jobs.log_bursts_stream(s, "source"))
    assert [(r.seq, r.lines) for r in sorted(kept, key=lambda r: r.seq)][-1] == (47, 17) and held[-1] == 3


def test_sliding_window_of_a_busy_minute_is_linear_and_takes_late_lines():
    rng = random.Random(2)
    t, w, times = jobs.Template(), 60_000_000, []
    for i in range(3_000):
        us = i * 100_000 - (rng.randrange(90_000_000) if rng.random() < 0.2 else 0)
        times.append(us)
        t.add(us, w)
        if i % 97 == 0:
            latest = max(times)
            assert len(t.recent) == sum(latest - w <= x for x in times) and len(t.previous) == sum(latest - 2 * w <= x < latest - w for x in times)
    took = []
    for n in (50_000, 200_000):
        t, began = jobs.Template(), time.perf_counter()
        for i in range(n):
            t.add(i * (240_000_000 // n), w)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] and len(t.recent) == 50_001


BURST = "source string, template string, timestamp timestamp, seq long, f_bias double, f_errors double, f_ratio double, f_critical double, burst_severity string"


def test_one_example_a_burst_by_the_first_critical_or_the_timer(spark, tmp_path):
    burst = lambda s, t, i, source="x", x=0.5, sev="warning": (source, t, at(s), i, 1.0, x, x, 0.0, sev)
    b = [[burst(0, "disk", 1), burst(50, "disk", 2, x=0.75, sev="critical"), burst(10, "net", 3), burst(0, "disk", 4, "y")], [burst(400, "disk", 5), burst(420, "net", 6)], [burst(5_000, "end", 7, "q")]]
    c = [[("x", at(10)), ("x", at(100)), ("x", at(120))], [("x", at(130)), ("y", at(301))], [("x", at(720))]]  # three after the first burst; y's comes too late, net's last in time
    rows, held = streamed(spark, tmp_path, [(BURST, b), ("source string, timestamp timestamp", c)], lambda bs, cs: jobs.delayed_labels(bs, cs, "source", "template", scope="source", late="0 seconds"))
    flat = lambda x: [r for batch in x for r in batch]
    batch = bursts.next_critical(spark.createDataFrame(flat(b), BURST), spark.createDataFrame(flat(c), "source string, timestamp timestamp"), "source", within_seconds=300)
    want = [tuple(r) for r in bursts.paging_examples(batch, "source", "template").where("source <> 'q'").collect()]
    assert sorted(tuple(r) for r in rows) == sorted(want)
    us = lambda s: int(at(s).timestamp() * 1e6)
    labels = {(r.source, r.template, r.opened): (r.followed, r.resolved, r.f_errors, r.rule) for r in rows}
    assert labels["x", "disk", us(0)] == (True, us(10), 0.5, False)
    assert labels["y", "disk", us(0)] == (False, us(300), 0.5, False) and labels["x", "net", us(420)][0] is True and labels["x", "net", us(10)] == (True, us(100), 0.5, False)
    assert held[-1] == 1  # the last burst's scope


STATSD = "value string, timestamp timestamp, seq long"


def statsd_lines():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        s = 3 * i + (900 if i >= 200 else 0)  # a long silence in the middle
        rows.append((rng.choice(["g:+2|g", "g:-1.5|g", "g:7|g", "h:+1|g|#z", "c:3|c|@0.5", "t:4|ms|#a,b:1", "t:8.5|ms|#a,b:1", "t:2|d|#a,b:1", "bad", "s:1|s"]), at(s), i))
    return rows


def test_flushed_stream_equals_batch(spark, tmp_path):
    rows = statsd_lines()
    batches = [rows[k : k + 100] for k in range(0, 400, 100)] + [[("end:1|c", at(90_000), 999), ("end:1|g", at(90_000), 1000)]]
    got, held = streamed(spark, tmp_path, [(STATSD, batches)], lambda s: jobs.statsd_flush_stream(s, 10, "0 seconds"), "max")
    batch = wire.statsd_rollup(spark.createDataFrame(rows, STATSD), "10 seconds").collect()
    key = lambda r: (r.name, r.tags, r.quantile, r.flush)
    assert {key(r): round(r.value, 9) for r in got} == {key(r): round(r.value, 9) for r in batch} and len(got) == len(batch) > 300
    assert held[-1] <= 3  # what came last


def test_flush_windows_of_counters_gauges_and_timers(spark, tmp_path):
    lines = [("c:3|c|@0.5", 1), ("t:4|ms", 2), ("t:8|ms", 3), ("g:7|g", 4), ("c:1|c", 15)]
    rows, _ = streamed(spark, tmp_path, [(STATSD, [[(v, at(s), s) for v, s in lines], [("c:1|c", at(99), 99)], [("c:1|c", at(200), 200)]])], jobs.statsd_flush_stream, "max")
    got = {(r.name, r.quantile, r.flush.second): r.value for r in rows}
    assert got["c", None, 10] == 6.0 and got["t_sum", None, 10] == 12.0 and got["t_count", None, 10] == 2.0 and got["t", "0.5", 10] == 4.0 and got["g", None, 10] == 7.0 and got["c", None, 20] == 1.0


def test_relative_gauges_equal_a_loop(spark):
    rng = random.Random(6)
    rows, want, value, seen = [], {}, 0.0, None
    s = 0
    for i in range(600):
        s += rng.choice([1, 60, 599, 600, 601, 40_000])
        text = rng.choice(["+2", "-3", "+1", "10"] if i % 5 else ["+4"])
        if text == "10":
            value = 10.0
        else:
            value = (value if seen is not None and s - seen <= 600 else 0.0) + float(text)
        seen = s
        want[i] = value
        rows.append((f"g:{text}|g", at(s), i))
    points = wire.statsd_points(spark.createDataFrame(rows, STATSD))
    got = {r.seq: r.running for r in wire.gauge_values(points).collect()}
    assert got == want


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    df = spark.createDataFrame([("m", at(i), float(i % 7), i) for i in range(60)], "name string, timestamp timestamp, value double, seq long")
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df.coalesce(1).write.parquet(src)
    jobs.score_on_write(spark.readStream.schema(df.schema).parquet(src), out, cp).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert spark.read.parquet(out).count() == 60
    (tmp_path / "cp" / "commits" / "0").unlink()  # as if the driver had died after the write: the batch is tried again
    for crc in (tmp_path / "cp" / "commits").glob(".0*"):
        crc.unlink()
    jobs.score_on_write(spark.readStream.schema(df.schema).parquet(src), out, cp).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    again = spark.read.parquet(out)
    assert again.count() == 60 and again.select("seq").distinct().count() == 60 and files.children(spark, out) == ["batch=0"]


def test_folders_beyond_retention_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(5)], "seq long")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(src)
    q = jobs.write_retained(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / "cp"), retention_seconds=86_400)
    q.processAllAvailable()
    q.stop()
    now = datetime.now(timezone.utc)
    assert jobs.read_retained(spark, out, "seq long", now, 3_600).count() == 5
    stamped = df.withColumn("ingest_ts", F.current_timestamp())
    for b, days in ((7, (40,)), (8, (0, 40))):
        parts = [stamped.withColumn("ingest_date", F.date_sub(F.current_date(), d)) for d in days]
        (parts[0] if len(parts) == 1 else parts[0].union(parts[1])).write.partitionBy("ingest_date").parquet(f"{out}/batch={b}")
    gone = jobs.expire_retained(spark, out, now, 86_400 * 7)
    assert len(gone) == 2 and gone[0] == "batch=7" and gone[1].startswith("batch=8/ingest_date=") and files.children(spark, out) == ["batch=0", "batch=8"]
    assert jobs.expire_retained(spark, out, now, 86_400 * 7) == [] and jobs.read_retained(spark, out, "seq long", now, 86_400 * 365).count() == 10


def test_saved_models_survive_corruption_and_failed_saves(spark, tmp_path):
    path, rows = str(tmp_path), spark.range(50)
    for i in range(3):
        state.save_state({"a": rows.withColumn("x", F.lit(i)), "b": rows}, path, {"a": 1, "b": 1})
    found = state.load_state(spark, path, {"a": 1, "b": 1, "c": 1})
    assert set(found) == {"a", "b"} and {r.x for r in found["a"].collect()} == {2} and len(files.children(spark, f"{path}/a")) == 3
    with pytest.raises(Exception, match="no such value"):
        state.save_state({"a": rows.withColumn("x", F.raise_error(F.lit("no such value")))}, path, {"a": 1})
    assert {r.x for r in state.load_state(spark, path, {"a": 1})["a"].collect()} == {2}  # the failed save changed nothing
    for part in (tmp_path / "b" / files.read_text(spark, f"{path}/b/current")).glob("*"):
        if part.name.startswith("part-"):
            data = part.read_bytes()
            part.write_bytes(data[:4] + b"\xff" * 40 + data[44:])
        elif part.name.startswith("."):
            part.unlink()
    assert set(state.load_state(spark, path, {"a": 1, "b": 1})) == {"a"}
    (tmp_path / "b" / "current").write_text("gone")
    assert set(state.load_state(spark, path, {"a": 1, "b": 1})) == {"a"} and state.load_state(spark, path, {"a": 2}) == {}
