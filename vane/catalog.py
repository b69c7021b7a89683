"""Registered queries of the library and their SQL.

Each query runs an operator over whole driver tables; doubles are rounded on both sides, because sums in another order differ
in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.functions import text as T
from vane.operators import baseline, bursts, incidents, report, rollup, scan, sequential, severity, traces
from vane.plans.shared import new_path
from vane.sources import tables, wire

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ntz(c: str = "timestamp"):
    return F.col(c).cast("timestamp_ntz").alias(c)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


LOGS = """logs AS (SELECT ts AS timestamp, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, 'user' || (user_id % 20) AS source,
 event_type || ' user=' || user_id || ' value=' || printf('%.2f', value) || ' ' || props AS message, event_type AS kind, event_id AS seq, value FROM events)"""
TEMPLATE = r"""trim(regexp_replace(regexp_replace(regexp_replace(message, '\b\d{1,3}(?:\.\d{1,3}){3}\b', '<*>', 'g'), '\b\d+(?:\.\d+)?\b', '<*>', 'g'), '\s+', ' ', 'g'))"""
ZSCORE = """w AS (SELECT event_type AS name, event_id AS seq, ts AS timestamp, value, count(*) OVER h AS n, avg(value) OVER p AS mp, stddev_samp(value) OVER p AS sp, avg(value) OVER h AS mh, stddev_samp(value) OVER h AS sh
 FROM events WINDOW p AS (PARTITION BY event_type{by} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY event_type{by} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 z AS (SELECT name, seq, timestamp, value, n, CASE WHEN n >= 12 THEN CASE WHEN n >= 3 AND coalesce(sp, 0) > 0 THEN (value - mp) / sp WHEN sh > 0 THEN (value - mh) / sh END END AS z FROM w)"""


@query(f"WITH {ZSCORE.format(by='')} SELECT name, seq, n, round(z, 4) AS z FROM z")
def metric_zscore(spark, d):
    return rounded(baseline.metric_zscore(tables.metrics(spark, d), "name"), "z").select("name", "seq", "n", "z")


@query(f"WITH {ZSCORE.format(by='')} SELECT name, seq, value, round(z, 4) AS z, CASE WHEN abs(z) >= 5 THEN 'critical' ELSE 'warning' END AS severity FROM z WHERE abs(z) >= 3")
def metric_anomalies(spark, d):
    return rounded(baseline.metric_anomalies(tables.metrics(spark, d), "name"), "z").select("name", "seq", "value", "z", "severity")


@query(f"WITH {ZSCORE.format(by=', hour(ts)')} SELECT name, hour(timestamp)::INTEGER AS hour, seq, round(z, 4) AS z FROM z WHERE abs(z) >= 3")
def seasonal_anomalies(spark, d):
    m = tables.metrics(spark, d).withColumn("hour", F.hour("timestamp"))
    return rounded(baseline.metric_anomalies(m, "name", "hour"), "z").select("name", "hour", "seq", "z")


SERIES_SQL = """v AS (SELECT CASE WHEN event_type = 'error' THEN 'process.errors' ELSE event_type END AS name, user_id, event_id AS seq, ts, value FROM events),
 k AS (SELECT name || ',user=' || user_id AS series, CASE WHEN NOT starts_with(name, 'process.') THEN hour(ts)::INTEGER END AS hour, * FROM v),
 w AS (SELECT *, count(*) OVER h AS n, avg(value) OVER p AS mp, stddev_samp(value) OVER p AS sp, avg(value) OVER h AS mh, stddev_samp(value) OVER h AS sh FROM k
  WINDOW p AS (PARTITION BY series, hour ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY series, hour ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 z AS (SELECT *, CASE WHEN n >= 12 THEN CASE WHEN coalesce(sp, 0) > 0 THEN (value - mp) / sp WHEN sh > 0 THEN (value - mh) / sh END END AS z FROM w)"""


@query(f"WITH {SERIES_SQL} SELECT series, hour, seq, round(z, 4) AS z, CASE WHEN abs(z) >= 5 THEN 'critical' ELSE 'warning' END AS severity FROM z WHERE abs(z) >= 3")
def series_anomalies(spark, d):
    """Series as they are watched: by name and labels, and by hour of day but for processes. Errors stand for a process's measure."""
    m = tables.metrics(spark, d).withColumn("name", F.when(F.col("name") == "error", "process.errors").otherwise(F.col("name")))
    m = m.withColumns({"series": T.series_key(F.col("name"), F.col("labels")), "hour": T.seasonal_hour(F.col("name"), F.col("timestamp"))})
    return rounded(baseline.metric_anomalies(m, "series", "hour"), "z").select("series", "hour", "seq", "z", "severity")


@query(f"WITH {ZSCORE.format(by='')} SELECT 'anomaly:' || name || ':' || seq AS id, CASE WHEN abs(z) >= 5 THEN 'critical' ELSE 'warning' END AS severity, printf('%s is %.1f deviations off', name, z) AS title, timestamp AS time FROM z WHERE abs(z) >= 3")
def insights_ordered(spark, d):
    a = baseline.metric_anomalies(tables.metrics(spark, d), "name")
    rows = a.select(F.concat_ws(":", F.lit("anomaly"), "name", "seq").alias("id"), "severity", F.format_string("%s is %.1f deviations off", "name", "z").alias("title"), F.col("timestamp").cast("timestamp_ntz").alias("time"))
    return incidents.ordered_insights(rows)


@query(f"""WITH RECURSIVE {ZSCORE.format(by='')}, k AS (SELECT name, seq, z, row_number() OVER (PARTITION BY name ORDER BY timestamp, seq) AS k FROM z),
 r AS (SELECT name, 0::BIGINT AS k, 0::DOUBLE AS hi, 0::DOUBLE AS lo, NULL::BIGINT AS seq, NULL::DOUBLE AS arm, NULL::VARCHAR AS direction FROM k WHERE k = 1 UNION ALL
  SELECT name, k, CASE WHEN greatest(h, l) >= 5 THEN 0 ELSE h END, CASE WHEN greatest(h, l) >= 5 THEN 0 ELSE l END, seq, CASE WHEN greatest(h, l) >= 5 THEN greatest(h, l) END, CASE WHEN greatest(h, l) >= 5 THEN CASE WHEN h >= l THEN 'up' ELSE 'down' END END
  FROM (SELECT k.name, k.k, k.seq, CASE WHEN z IS NULL THEN 0 ELSE greatest(0, hi + z - 0.5) END AS h, CASE WHEN z IS NULL THEN 0 ELSE greatest(0, lo - z - 0.5) END AS l FROM r JOIN k ON k.name = r.name AND k.k = r.k + 1))
 SELECT name, seq, round(arm, 4) AS arm, direction FROM r WHERE arm IS NOT NULL""")
def changepoints(spark, d):
    return baseline.changepoints(baseline.metric_zscore(tables.metrics(spark, d), "name"), "name").select("name", "seq", F.round("arm", 4).alias("arm"), "direction")


@query(f"""WITH {ZSCORE.format(by='')}, s AS (SELECT name, seq, timestamp, sum(z - 0.5) OVER (PARTITION BY name ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS p FROM z WHERE z IS NOT NULL),
 a AS (SELECT *, p - least(min(p) OVER (PARTITION BY name ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING), 0) AS arm FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY timestamp, seq) AS k FROM a WHERE arm >= 5)
 SELECT name, seq, round(arm, 4) AS arm FROM f WHERE k = 1""")
def first_crossing(spark, d):
    return rounded(baseline.first_crossing(baseline.metric_zscore(tables.metrics(spark, d), "name"), "name"), "arm").select("name", "seq", "arm")


@query("""WITH t AS (SELECT event_type AS name, event_id AS seq, ts, value - lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS d FROM events)
 SELECT name, seq, round(CASE WHEN d >= 0 THEN d END, 4) AS delta FROM t""")
def counter_delta(spark, d):
    m = tables.metrics(spark, d).withColumn("user", F.col("labels")["user"])
    return rounded(baseline.counter_delta(m, "value", "name", "user"), "delta").select("name", "seq", "delta")


@query("""WITH t AS (SELECT user_id % 20 AS container, event_id AS seq, ts, sum(value) OVER w AS cpu_total, sum(value * 10 + 1) OVER w AS system_total, (user_id % 4) AS cpus FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 u AS (SELECT *, cpu_total - lag(cpu_total) OVER w AS c, system_total - lag(system_total) OVER w AS s FROM t WINDOW w AS (PARTITION BY container ORDER BY ts, seq))
 SELECT container, seq, round(CASE WHEN c IS NULL THEN NULL WHEN s <= 0 OR c < 0 THEN 0 ELSE c / s * (CASE WHEN cpus = 0 THEN 1 ELSE cpus END) * 100 END, 3) AS cpu_percent FROM u""")
def container_cpu(spark, d):
    from pyspark.sql import Window

    e = tables.table(spark, d, "events").withColumn("timestamp", F.col("ts").cast("timestamp")).withColumn("seq", F.col("event_id")).withColumn("container", F.col("user_id") % 20)
    w = Window.partitionBy("container").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    c = e.select("container", "timestamp", "seq", F.sum("value").over(w).alias("cpu_total"), F.sum(F.col("value") * 10 + 1).over(w).alias("system_total"), (F.col("user_id") % 4).alias("cpus"))
    return rounded(baseline.container_cpu(c), "cpu_percent", digits=3).select("container", "seq", "cpu_percent")


VECTOR_NAMES = ["view", "click", "signup", "purchase", "error"]


def outlier_vectors(spark, d):
    """Hosts are users mod 10, a tick six hours, measures the kinds of events. A vector needs all five; signups give their first value of the tick, the others their last."""
    e = tables.metrics(spark, d).withColumn("host", F.col("labels")["user"].cast("long") % 10)
    tick = F.floor(F.unix_seconds("timestamp") / 21_600)
    return baseline.host_outliers(baseline.batch_vectors(e, VECTOR_NAMES, "host", tick, first=("signup",)).dropna(), VECTOR_NAMES, [0.25, 0.25, 0.25, 1e4, 1e4], min_vectors=30)


@query("""WITH e AS (SELECT user_id % 10 AS host, floor(epoch(ts) / 21600)::BIGINT AS tick, event_type AS k, value, ts, event_id FROM events)
 SELECT host, tick, arg_max(value, (ts, event_id)) FILTER (WHERE k = 'view') AS view, arg_max(value, (ts, event_id)) FILTER (WHERE k = 'click') AS click, arg_min(value, (ts, event_id)) FILTER (WHERE k = 'signup') AS signup,
 arg_max(value, (ts, event_id)) FILTER (WHERE k = 'purchase') AS purchase, arg_max(value, (ts, event_id)) FILTER (WHERE k = 'error') AS error FROM e GROUP BY ALL HAVING count(DISTINCT k) FILTER (WHERE k IN ('view', 'click', 'signup', 'purchase', 'error')) = 5""")
def batch_vectors(spark, d):
    e = tables.metrics(spark, d).withColumn("host", F.col("labels")["user"].cast("long") % 10)
    v = baseline.batch_vectors(e, VECTOR_NAMES, "host", F.floor(F.unix_seconds("timestamp") / 21_600), first=("signup",))
    return v.select("host", "tick", *VECTOR_NAMES)


@query()
def host_outliers(spark, d):
    out = outlier_vectors(spark, d)
    return rounded(out.where("severity IS NOT NULL"), "d2").select("host", "tick", "d2", "top_feature", "severity")


@query()
def lone_outliers(spark, d):
    """Host outliers while no single measure of the host was anomalous."""
    m = tables.metrics(spark, d).withColumn("host", F.col("labels")["user"].cast("long") % 10)
    episodes = baseline.episodes(baseline.metric_anomalies(m, "host"), "host", gap_seconds=21_600)
    out = incidents.alone(outlier_vectors(spark, d).where("severity IS NOT NULL"), episodes)
    return rounded(out, "d2").select("host", "tick", "d2", "top_feature")


@query(f"""WITH {ZSCORE.format(by='')}, a AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY name ORDER BY timestamp, seq) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM z WHERE abs(z) >= 3),
 e AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM a) SELECT name, episode, min(timestamp) AS opened, max(timestamp) AS last_seen, count(*) AS findings FROM e GROUP BY ALL""")
def insight_episodes(spark, d):
    e = baseline.episodes(baseline.metric_anomalies(tables.metrics(spark, d), "name"), "name", gap_seconds=21_600)
    return e.select("name", "episode", ntz("opened"), ntz("last_seen"), "findings")


@query("SELECT event_type AS name, event_id AS seq, value, ts AS timestamp FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 500")
def query_metrics(spark, d):
    from datetime import datetime, timezone

    at = lambda day: datetime(2024, 1, day, tzinfo=timezone.utc)
    m = scan.query_metrics(tables.metrics(spark, d), "error", {"user": "7"}, at(5), at(20), limit=500)
    return m.select("name", "seq", "value", ntz())


@query("WITH r AS (SELECT event_type AS name, event_id AS seq, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT name, seq FROM r WHERE k <= 20 ORDER BY ts DESC, seq DESC LIMIT 60")
def newest_per_name(spark, d):
    return scan.query_metrics(tables.metrics(spark, d), per_name=20, limit=60).select("name", "seq")


@query(f"WITH {LOGS} SELECT seq, source, message FROM logs WHERE severity = 'error' AND source = 'user7' ORDER BY timestamp DESC, seq DESC LIMIT 100")
def query_logs(spark, d):
    return scan.query_logs(tables.logs(spark, d), "error", "user7", limit=100).select("seq", "source", "message")


@query("SELECT l_orderkey AS trace_id, l_linenumber AS span_id, o_orderpriority AS service FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01'")
def query_spans(spark, d):
    from datetime import datetime, timezone

    at = lambda m: datetime(1998, m, 1, tzinfo=timezone.utc)
    return scan.query_spans(tables.spans(spark, d), "1-URGENT", since=at(1), before=at(2)).select("trace_id", "span_id", "service")


@query("SELECT event_id AS seq FROM events WHERE ts > TIMESTAMP '2024-01-25'")
def retained(spark, d):
    from datetime import datetime, timezone

    return scan.retained(tables.metrics(spark, d), datetime(2024, 1, 31, tzinfo=timezone.utc), 6 * 86_400).select("seq")


PHRASES = ["errors from user1", "error from user1", "show critical lines", "warn", "debug from 'user3'", "info please", "fatal and severe from user12,"]


PHRASE_LIST = ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES)


@query(rf"""WITH {LOGS}, p AS (SELECT unnest([{PHRASE_LIST}]) AS phrase), w AS (SELECT phrase, string_split_regex(lower(phrase), '[^a-z0-9]+') AS ws, trim(regexp_extract(phrase, 'from \s*(\S+)', 1), '"''.,') AS src FROM p),
 f AS (SELECT phrase, CASE WHEN list_has_any(ws, ['error','fail','fatal','critical','severe']) THEN 'error' WHEN list_has_any(ws, ['warn','warning']) THEN 'warn' WHEN list_has_any(ws, ['debug']) THEN 'debug' END AS status, nullif(src, '') AS f_source FROM w)
 SELECT phrase, status, f_source, count(l.seq)::BIGINT AS lines FROM f LEFT JOIN logs l ON (status IS NULL OR l.severity = status) AND (f_source IS NULL OR contains(lower(l.source), lower(f_source))) GROUP BY ALL""")
def saved_search(spark, d):
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    return scan.search_counts(phrases, tables.logs(spark, d))


@query(f"WITH {LOGS} SELECT source, {TEMPLATE} AS template, count(*) AS lines, count(*) FILTER (WHERE severity IN ('error', 'fatal')) AS errors, max(timestamp) AS last_seen, arg_max(message, seq) AS sample FROM logs GROUP BY ALL")
def log_templates(spark, d):
    return rollup.log_templates(tables.logs(spark, d), "source").select("source", "template", "lines", "errors", ntz("last_seen"), "sample")


@query(f"WITH {LOGS} SELECT {TEMPLATE} AS template, count(*) AS lines FROM logs GROUP BY ALL")
def template_counts(spark, d):
    return tables.logs(spark, d).groupBy(T.log_template(F.col("message")).alias("template")).agg(F.count(F.lit(1)).alias("lines"))


@query(f"""WITH {LOGS}, b AS (SELECT source, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) AS total FROM logs GROUP BY 1), c AS (SELECT *, least(100, errors / total / 0.25 * 100) AS consumed FROM b)
 SELECT source, errors, total, round(consumed, 4) AS consumed, CASE WHEN consumed >= 90 THEN 'critical' WHEN consumed >= 70 THEN 'at-risk' ELSE 'healthy' END AS status FROM c""")
def error_budget(spark, d):
    return rounded(rollup.error_budget(tables.logs(spark, d), "source", slo=0.25), "consumed")


@query("""WITH m AS (SELECT event_type AS name, date_trunc('minute', ts) AS "at", round(avg(value), 4) AS value FROM events GROUP BY ALL) SELECT * FROM m""")
def minute_means(spark, d):
    return rounded(rollup.minute_means(tables.metrics(spark, d)), "value").select("name", ntz("at"), "value")


@query("SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_values(spark, d):
    return rollup.latest_values(tables.metrics(spark, d), "name")


@query("SELECT user_id::VARCHAR AS pid, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS cpu, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS rss FROM events GROUP BY ALL ORDER BY coalesce(cpu, 0) DESC, pid LIMIT 15")
def process_table(spark, d):
    t = rollup.pivot_latest(tables.metrics(spark, d), F.col("labels")["user"], "pid", {"view": "cpu", "click": "rss"})
    return t.orderBy(F.desc(F.coalesce("cpu", F.lit(0.0))), "pid").limit(15)


PROBE = """p AS (SELECT user_id % 10 AS target, ts, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS up FROM events),
 c AS (SELECT target, least(59, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(TIMESTAMP '2024-01-01')) / 60)))::INTEGER AS bucket, count(*) AS checks, sum(up) AS up FROM p WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY ALL),
 g AS (SELECT target, bucket FROM (SELECT DISTINCT target FROM p), (SELECT unnest(range(60))::INTEGER AS bucket)),
 s AS (SELECT g.target, g.bucket, coalesce(checks, 0) AS checks, CASE WHEN checks IS NULL THEN 'unknown' WHEN up = checks THEN 'operational' WHEN up = 0 THEN 'outage' ELSE 'degraded' END AS status FROM g LEFT JOIN c ON g.target = c.target AND g.bucket = c.bucket)"""


@query(f"WITH {PROBE} SELECT target, bucket, checks, status FROM s")
def probe_uptime(spark, d):
    return rollup.probe_uptime(tables.probes(spark, d), "2024-01-01", "2024-01-31").drop("detail")


@query(f"WITH {PROBE} SELECT target, CASE WHEN count(*) FILTER (WHERE status <> 'unknown') = 0 THEN 0 ELSE round(count(*) FILTER (WHERE status = 'operational') / count(*) FILTER (WHERE status <> 'unknown') * 100, 4) END AS uptime, count(*) FILTER (WHERE status IN ('degraded', 'outage')) AS incidents FROM s GROUP BY target")
def uptime_percent(spark, d):
    return rollup.uptime_percent(rollup.probe_uptime(tables.probes(spark, d), "2024-01-01", "2024-01-31"))


@query(f"WITH {LOGS} SELECT source, " + ", ".join(f"nullif(count(*) FILTER (WHERE hour(timestamp) = {h}), 0) AS h{h:02d}" for h in range(24)) + " FROM logs WHERE severity = 'error' GROUP BY source")
def error_heatmap(spark, d):
    return rollup.error_heatmap(tables.logs(spark, d))


@query("WITH g AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT g.day::VARCHAR AS day, (g.day - dayofweek(g.day)::INTEGER)::DATE::VARCHAR AS week, dayofweek(g.day)::INTEGER AS weekday, c.n AS rows FROM g LEFT JOIN c ON g.day = c.day")
def calendar_heatmap(spark, d):
    c = rollup.calendar_heatmap(tables.metrics(spark, d))
    return c.withColumns({k: F.col(k).cast("string") for k in ("day", "week")})


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.0), 4) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 1.0), 4) AS max FROM lineitem GROUP BY 1")
def five_number(spark, d):
    return rounded(rollup.five_number(tables.table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), "min", "q1", "median", "q3", "max")


@query("""WITH e AS (SELECT (max(l_extendedprice) - min(l_extendedprice)) / 10 AS raw FROM lineitem), p AS (SELECT raw, pow(10.0, floor(log10(raw))) AS pw FROM e),
 s AS (SELECT CASE WHEN raw <= pw THEN pw WHEN raw <= 2 * pw THEN 2 * pw WHEN raw <= 5 * pw THEN 5 * pw ELSE 10 * pw END AS step FROM p) SELECT floor(l_extendedprice / step) * step AS bucket, count(*) AS rows FROM lineitem, s GROUP BY 1""")
def histogram_buckets(spark, d):
    return rollup.histogram_buckets(tables.table(spark, d, "lineitem"), "l_extendedprice")


@query("WITH t AS (SELECT c_mktsegment, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT c_mktsegment, round(total, 2) AS total, round(total / sum(total) OVER () * 100, 4) AS share FROM t")
def share_of_total(spark, d):
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders")
    s = rollup.share_of_total(c.join(o, c.c_custkey == o.o_custkey), "c_mktsegment", "o_totalprice")
    return s.select("c_mktsegment", F.round("total", 2).alias("total"), F.round("share", 4).alias("share"))


@query("WITH c AS (SELECT user_id::VARCHAR AS label, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS k FROM c) SELECT CASE WHEN k <= 8 THEN label ELSE 'Other' END AS label, sum(n)::BIGINT AS rows FROM r GROUP BY 1")
def top_n_with_other(spark, d):
    return rollup.top_n_with_other(tables.table(spark, d, "events"), "user_id")


@query("""WITH c AS (SELECT list_position(['view', 'click', 'signup', 'purchase'], event_type)::INTEGER AS position, event_type AS stage, count(*) AS rows FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY ALL)
 SELECT position, stage, rows, round(least(100, rows / first_value(rows) OVER w * 100), 4) AS of_first, CASE WHEN lag(rows) OVER w > 0 THEN round(least(100, rows / lag(rows) OVER w * 100), 4) END AS of_previous FROM c WINDOW w AS (ORDER BY position)""")
def funnel(spark, d):
    return rounded(rollup.funnel(tables.table(spark, d, "events"), "event_type", ["view", "click", "signup", "purchase"]), "of_first", "of_previous")


@query("SELECT event_type AS name, count(value) AS samples, min(value) AS low, max(value) AS high, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1")
def trend_summary(spark, d):
    return rollup.trend_summary(tables.metrics(spark, d), "name")


@query("""WITH t AS (SELECT event_type AS name, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, n - lag(n) OVER (PARTITION BY name ORDER BY day) AS change FROM t),
 x AS (SELECT *, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'flat' END AS direction FROM c) SELECT name, day::VARCHAR AS day, n, change, direction, CASE WHEN direction IS NULL OR direction = 'flat' THEN 'neutral' WHEN direction = 'up' THEN 'good' ELSE 'bad' END AS tone FROM x""")
def period_delta(spark, d):
    t = tables.metrics(spark, d).groupBy("name", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rollup.period_delta(t, "day", "n", "name").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {ZSCORE.format(by='')} SELECT name, CASE WHEN bool_or(abs(z) >= 5) THEN 'outage' ELSE 'degraded' END AS status FROM z WHERE abs(z) >= 3 GROUP BY name")
def service_status(spark, d):
    return rollup.service_status(baseline.metric_anomalies(tables.metrics(spark, d), "name"), "name")


@query(f"WITH {LOGS} SELECT source, count(*) AS lines, count(*) FILTER (WHERE severity = 'debug') AS debug, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'error') AS error FROM logs GROUP BY source")
def log_counters(spark, d):
    return rollup.log_counters(tables.logs(spark, d), "source")


@query(f"WITH {LOGS} SELECT DISTINCT 'source' AS key, source AS value FROM logs UNION ALL SELECT 'status', unnest(['debug', 'info', 'warn', 'error'])")
def facet_options(spark, d):
    return rollup.facet_options(tables.logs(spark, d))


@query("SELECT event_type AS name, count(DISTINCT event_type || ',user=' || user_id) AS series FROM events GROUP BY 1")
def series_cardinality(spark, d):
    return rollup.series_cardinality(tables.metrics(spark, d), T.series_key(F.col("name"), F.col("labels")))


@query(f"""WITH {LOGS}, t AS (SELECT *, {TEMPLATE} AS template FROM logs),
 c AS (SELECT source, template, seq, severity, count(*) OVER r AS recent, count(*) OVER b AS previous, sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source, template ORDER BY epoch_us(timestamp) RANGE UNBOUNDED PRECEDING)::BIGINT AS errors FROM t
  WINDOW r AS (PARTITION BY source, template ORDER BY epoch_us(timestamp) RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW), b AS (PARTITION BY source, template ORDER BY epoch_us(timestamp) RANGE BETWEEN 28800000000 PRECEDING AND 14400000001 PRECEDING))
 SELECT source, template, seq, recent, previous, errors, CASE WHEN errors > 0 OR recent >= 6 THEN 'critical' ELSE 'warning' END AS burst_severity FROM c WHERE recent >= 3 AND (previous = 0 OR recent >= 3 * previous)""")
def log_bursts(spark, d):
    b = bursts.log_bursts(tables.logs(spark, d), "source", seconds=14_400, at_least=3)
    return b.select("source", "template", "seq", "recent", "previous", "errors", "burst_severity")


@query(f"""WITH {ZSCORE.format(by='')}, k AS (SELECT name, timestamp FROM z WHERE abs(z) >= 5), e AS (SELECT event_type AS name, event_id AS seq, ts FROM events)
 SELECT e.name, e.seq, EXISTS (SELECT 1 FROM k WHERE k.name = e.name AND k.timestamp > e.ts AND k.timestamp <= e.ts + INTERVAL 6 HOUR) AS followed, EXISTS (SELECT 1 FROM k WHERE k.name = e.name AND k.timestamp > e.ts - INTERVAL 1 MINUTE AND k.timestamp <= e.ts) AS co_occurring FROM e""")
def followed_by_critical(spark, d):
    m = tables.metrics(spark, d)
    critical = baseline.metric_anomalies(m, "name").where("severity = 'critical'")
    return bursts.followed_by_critical(m.select("name", "seq", "timestamp"), critical.select("name", "timestamp"), "name", within_seconds=21_600).select("name", "seq", "followed", "co_occurring")


def critical_findings(spark, d):
    """Critical metric anomalies and host outliers as marks of the log sources that they concern: a user's source, and both sources of a host."""
    user = F.col("labels")["user"].cast("long")
    a = baseline.metric_anomalies(tables.metrics(spark, d), "name").withColumn("host", user)
    rows = incidents.anomaly_rows(a.withColumn("name", F.concat_ws("|", "name", F.concat(F.lit("user"), (user % 20).cast("string")))))
    hosts = incidents.host_outlier_rows(outlier_vectors(spark, d).where("severity IS NOT NULL"))
    of_anomaly = F.array(F.element_at(F.split("id", "[|:]"), 3))
    host = F.element_at(F.split("id", ":"), 2).cast("long")
    of_host = F.transform(F.array(host, host + 10), lambda h: F.concat(F.lit("user"), h.cast("string")))
    marks = incidents.critical_marks(rows, hosts)
    return marks.select(F.explode(F.when(F.startswith("id", F.lit("host:")), of_host).otherwise(of_anomaly)).alias("source"), F.col("time").alias("timestamp"))


def paging_bursts(spark, d):
    """Bursts a source and template with features and the next critical finding of any other kind."""
    b = bursts.log_bursts(tables.logs(spark, d), "source", seconds=14_400, at_least=3)
    critical = critical_findings(spark, d).distinct()
    x = bursts.paging_features(bursts.followed_by_critical(b, critical, "source", within_seconds=21_600))
    return bursts.next_critical(x, critical, "source", within_seconds=21_600)


def paging_model(spark, d):
    e = bursts.paging_examples(paging_bursts(spark, d), "source", "template", within_seconds=21_600)
    return bursts.paging_graded(e, "source", "template", scope=["source"])


@query()
def paging_answers(spark, d):
    """Bursts with the model's answer, where their source's model may give one."""
    g = paging_model(spark, d)
    ready = bursts.paging_readiness(g, "source", least=5, lead=0.0)
    x = bursts.paging_score(paging_bursts(spark, d), bursts.paging_fit(g, "source", "template", scope=("source",)), ready, "source", "template", scope=("source",))
    return rounded(x, "paging_score").select("source", "template", "seq", "burst_severity", "paging_score")


@query()
def rolling_accuracy(spark, d):
    """The paging model's and the rule's accuracy over the last 20 examples at every example."""
    return rounded(bursts.rolling_accuracy(paging_model(spark, d), "source", last=20), "accuracy", "rule_accuracy").select("source", "template", "opened", "seen", "accuracy", "rule_accuracy")


@query()
def paging_examples(spark, d):
    """One example an episode of a template, labelled by a critical that followed."""
    e = bursts.paging_examples(paging_bursts(spark, d), "source", "template", within_seconds=21_600)
    return rounded(e, *bursts.FEATURES)


@query()
def paging_scores(spark, d):
    """Every example judged before it was learned from, by its template's weights."""
    g = bursts.paging_graded(bursts.paging_examples(paging_bursts(spark, d), "source", "template", within_seconds=21_600), "source", "template", scope=["source"])
    return rounded(g, "predicted").select("source", "template", "opened", "followed", "predicted", "hit", "rule_hit")


@query()
def paging_readiness(spark, d):
    g = bursts.paging_graded(bursts.paging_examples(paging_bursts(spark, d), "source", "template", within_seconds=21_600), "source", "template", scope=["source"])
    return rounded(bursts.paging_readiness(g, "source"), "accuracy", "rule_accuracy")


@query("""WITH s AS (SELECT l_orderkey AS trace_id, l_linenumber AS span_id, epoch_ms(l_shipdate)::DOUBLE AS st, l_extendedprice AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 t AS (SELECT *, min(st) OVER w AS f, greatest(1, max(st + d) OVER w - min(st) OVER w) AS total FROM s WINDOW w AS (PARTITION BY trace_id))
 SELECT trace_id, span_id, round(st - f, 3) AS offset_ms, round(total, 3) AS total_ms, round(least(greatest((st - f) / total * 100, 0), 100), 4) AS offset_pct, round(least(greatest(d / total * 100, 0), 100), 4) AS width_pct FROM t""")
def trace_waterfall(spark, d):
    w = traces.waterfall(tables.spans(spark, d))
    return w.select("trace_id", "span_id", F.round("offset_ms", 3).alias("offset_ms"), F.round("total_ms", 3).alias("total_ms"), F.round("offset_pct", 4).alias("offset_pct"), F.round("width_pct", 4).alias("width_pct"))


@query("SELECT conv_id AS trace_id, turn AS span_id, turn::INTEGER AS depth FROM conversations")
def span_depth(spark, d):
    return traces.span_depth(tables.span_trees(spark, d))


@query("SELECT conv_id AS trace_id, string_agg(role, ' > ' ORDER BY turn) AS path FROM conversations GROUP BY conv_id")
def critical_path(spark, d):
    return traces.critical_path(tables.span_trees(spark, d))


TREES = """s AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn > 0 THEN (turn - 1) // 2 WHEN conv_id % 7 = 3 THEN 1000000 END AS parent_id, role || turn AS name, length(text) AS ms, CASE WHEN (turn + conv_id) % 5 = 3 THEN 'error' ELSE 'ok' END AS status FROM conversations)"""


def branching(spark, d):
    """Conversations as binary trees of spans; some roots name a parent that is not there."""
    c = tables.table(spark, d, "conversations")
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).when(F.col("conv_id") % 7 == 3, 1_000_000)
    return c.select(F.col("conv_id").alias("trace_id"), F.col("turn").cast("long").alias("span_id"), parent.cast("long").alias("parent_id"), F.concat("role", F.col("turn").cast("string")).alias("name"), F.length("text").cast("double").alias("duration_ms"), F.when((F.col("turn") + F.col("conv_id")) % 5 == 3, "error").otherwise("ok").alias("status"))


@query(f"""WITH RECURSIVE {TREES}, d AS (SELECT trace_id, span_id, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS depth FROM s WHERE parent_id IS NULL OR parent_id = 1000000 UNION ALL SELECT s.trace_id, s.span_id, depth + 1 FROM s JOIN d ON s.trace_id = d.trace_id AND s.parent_id = d.span_id)
 SELECT trace_id, span_id::BIGINT AS span_id, depth::INTEGER AS depth FROM d""")
def branch_depth(spark, d):
    return traces.span_depth(branching(spark, d))


@query(f"""WITH RECURSIVE {TREES}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY status <> 'error', EXISTS (SELECT 1 FROM s c WHERE c.trace_id = s.trace_id AND c.parent_id = s.span_id), -ms, span_id) AS k FROM s),
 p AS (SELECT trace_id, parent_id, name AS path FROM r WHERE k = 1 UNION ALL SELECT s.trace_id, s.parent_id, s.name || ' > ' || path FROM p JOIN s ON s.trace_id = p.trace_id AND s.span_id = p.parent_id)
 SELECT trace_id, path FROM p WHERE parent_id IS NULL OR parent_id = 1000000""")
def branch_path(spark, d):
    return traces.critical_path(branching(spark, d))


@query("SELECT l_orderkey AS trace_id, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::INTEGER AS has_error, round(sum(l_extendedprice), 2) AS total_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY has_error DESC, total_ms DESC, trace_id LIMIT 1")
def pick_trace(spark, d):
    return rounded(traces.pick_trace(tables.spans(spark, d)), "total_ms", digits=2)


@query("SELECT o_orderpriority AS service, l_returnflag AS name, count(*) AS spans, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def span_latency(spark, d):
    return rounded(traces.span_latency(tables.spans(spark, d), "service", "name"), "p50", "p99")


@query()
def slow_spans(spark, d):
    """Spans of the middle of each month take ten times as long here, so that runs of slow ones occur."""
    slow = F.when(F.dayofmonth("start") == 15, 10).otherwise(1)
    spans = tables.spans(spark, d).withColumn("duration_ms", F.col("duration_ms") * slow)
    return rounded(traces.slow_spans(spans, "service", "name"), "p99", "median").select("service", "name", "trace_id", "span_id", "duration_ms", "run", "p99", "median", "severity")


@query()
def p2_quantiles(spark, d):
    return rounded(sequential.p2_quantiles(tables.metrics(spark, d), "value", "name"), "quantile")


@query()
def learned_thresholds(spark, d):
    return rounded(sequential.learned_thresholds(baseline.metric_zscore(tables.metrics(spark, d), "name"), "name"), "warn", "critical")


@query(f"""WITH {ZSCORE.format(by='')}, r AS (SELECT name, seq, z, timestamp::DATE AS day, floor(least(abs(z), 12) * 100)::INTEGER AS bin FROM z WHERE z IS NOT NULL), c AS (SELECT name, day, bin, count(*) AS c FROM r GROUP BY ALL),
 g AS (SELECT d.name, d.day, b.bin, (SELECT coalesce(sum(c), 0) FROM c WHERE c.name = d.name AND c.bin = b.bin AND c.day < d.day) AS h FROM (SELECT DISTINCT name, day FROM c) d JOIN (SELECT DISTINCT name, bin FROM c) b ON b.name = d.name),
 u AS (SELECT *, sum(h) OVER (PARTITION BY name, day ORDER BY bin) AS cum, sum(h) OVER (PARTITION BY name, day) AS n FROM g),
 l AS (SELECT name, day, max(n) AS n, min(CASE WHEN cum >= 0.999 * n THEN (bin + 1) / 100.0 END) AS w, min(CASE WHEN cum >= 0.9999 * n THEN (bin + 1) / 100.0 END) AS p FROM u GROUP BY ALL),
 m AS (SELECT name, day, CASE WHEN n >= 200 THEN least(greatest(w, 2), 12) ELSE 3.0 END AS warn, CASE WHEN n >= 1000 THEN least(greatest(p, 2), 12) ELSE 5.0 END AS page FROM l)
 SELECT name, seq, round(z, 4) AS z, round(warn, 4)::DOUBLE AS warn, round(greatest(warn, page), 4)::DOUBLE AS critical, CASE WHEN abs(z) >= greatest(warn, page) THEN 'critical' WHEN abs(z) >= warn THEN 'warning' END AS severity FROM r JOIN m USING (name, day)""")
def daily_thresholds(spark, d):
    t = sequential.daily_thresholds(baseline.metric_zscore(tables.metrics(spark, d), "name"), "name", warn_from=200, page_from=1_000)
    return rounded(t, "z", "warn", "critical").select("name", "seq", "z", "warn", "critical", "severity")


def burn_readings(spark, d):
    """The spent share of each source's errors by day, as readings."""
    from pyspark.sql import Window

    day = tables.logs(spark, d).groupBy("source", F.to_date("timestamp").alias("day")).agg(F.count_if(F.col("severity") == "error").alias("errors"))
    w = Window.partitionBy("source")
    run = F.sum("errors").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(F.sum("errors").over(w), F.lit(1)) * 90
    r = day.select("source", F.unix_seconds(F.col("day").cast("timestamp")).alias("seconds"), run.alias("consumed"))
    return sequential.burn_forecast(r, "source", horizon_hours=24 * 365)


@query()
def burn_forecast(spark, d):
    f = burn_readings(spark, d)
    return rounded(f, "level", "trend", "soonest", "latest", "skill").withColumn("phrase", T.projection_phrase(F.col("soonest"), F.col("latest")))


@query()
def metric_forecast(spark, d):
    f = sequential.metric_forecast(rollup.minute_means(tables.metrics(spark, d), grain="hour"))
    return rounded(f, "value").select("name", ntz("at"), "value")


def findings(spark, d):
    """Findings of every kind as rows of one shape."""
    m = tables.metrics(spark, d)
    scored = baseline.metric_zscore(m, "name")
    anomalies = scored.withColumn("severity", baseline.severity_of(F.col("z"))).where("severity IS NOT NULL")
    spans = tables.spans(spark, d).withColumn("duration_ms", F.col("duration_ms") * F.when(F.dayofmonth("start") == 15, 10).otherwise(1))
    slow = traces.slow_spans(spans, "service", "name")
    named = spans.join(slow.select("trace_id").distinct(), "trace_id", "left_semi")
    paths = traces.critical_path(named.withColumn("parent_id", F.when(F.col("span_id") > 1, F.floor(F.col("span_id") / 2))))
    return incidents.all_insights(
        incidents.anomaly_rows(anomalies),
        incidents.changepoint_rows(baseline.changepoints(scored, "name")),
        incidents.burst_rows(bursts.log_bursts(tables.logs(spark, d), "source", seconds=14_400, at_least=3)),
        incidents.slow_span_rows(slow, paths),
        incidents.culprit_rows(culprits_of(spark, d)),
        incidents.host_outlier_rows(outlier_vectors(spark, d).where("severity IS NOT NULL")),
    )


@query()
def all_insights(spark, d):
    f = findings(spark, d)
    return rounded(f, "value").withColumns({"time": F.col("time").cast("timestamp_ntz"), "related": F.array_join("related", ",")})


@query()
def timeline(spark, d):
    """Events of all findings, near ones of equal source or related values folded into incidents."""
    return incidents.timeline(findings(spark, d)).withColumn("time", F.col("time").cast("timestamp_ntz"))


INCIDENTS = f"""WITH RECURSIVE {ZSCORE.format(by='')}, i AS (SELECT name || ':' || lpad(seq::VARCHAR, 12, '0') AS id, seq, name, CASE WHEN abs(z) >= 5 THEN 'critical' ELSE 'warning' END AS severity, timestamp AS time FROM z WHERE abs(z) >= 3),
 k AS (SELECT id, time, 'user' || user_id AS key FROM i JOIN events ON event_id = seq UNION ALL SELECT id, time, name FROM i),
 l AS (SELECT id AS a, lag(id) OVER w AS b, time - lag(time) OVER w AS gap FROM k WINDOW w AS (PARTITION BY key ORDER BY time, id)),
 e AS (SELECT a, b FROM l WHERE gap <= INTERVAL 720 MINUTE UNION SELECT b, a FROM l WHERE gap <= INTERVAL 720 MINUTE),
 r(root, node) AS (SELECT id, id FROM i UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node),
 c AS (SELECT node AS id, min(root) AS incident FROM r GROUP BY node)
 SELECT incident, count(*) AS members, CASE WHEN bool_or(severity = 'critical') THEN 'critical' ELSE 'warning' END AS severity, min(time) AS started, max(time) AS ended, arg_min(name, (time, i.id)) AS first_title, string_agg(name, ' · ' ORDER BY time, i.id) AS story FROM c JOIN i USING (id) GROUP BY incident"""


@query(INCIDENTS)
def incident_groups(spark, d):
    a = baseline.metric_anomalies(tables.metrics(spark, d), "name")
    rows = a.select(F.concat_ws(":", "name", F.lpad(F.col("seq").cast("string"), 12, "0")).alias("id"), F.lit("detector").alias("source"), F.array(F.concat(F.lit("user"), F.col("labels")["user"]), F.col("name")).alias("related"), "severity", F.col("timestamp").alias("time"), F.col("name").alias("title"))
    g = incidents.incidents(rows, minutes=720)
    return g.select("incident", "members", "severity", ntz("started"), ntz("ended"), "first_title", "story")


def culprits_of(spark, d):
    """Hosts are users mod 10, processes users; clicks stand for memory, all else for cpu. A process's sigma is its running z-score, itself included."""
    metric = F.when(F.col("name") == "click", "memory").otherwise("cpu")
    m = tables.metrics(spark, d).withColumn("pid", F.col("labels")["user"].cast("long")).withColumn("host", F.col("labels")["user"].cast("long") % 10).withColumn("metric", metric)
    p = baseline.metric_zscore(m, "pid", "metric", inclusive=True).select("host", "pid", "timestamp", "seq", "metric", "value", F.col("z").alias("sigma"))
    a = baseline.metric_anomalies(m, "host").where("severity = 'critical'").select("host", "timestamp").distinct()
    return incidents.culprits(a, p, max_age_seconds=86_400)


@query("""WITH m AS (SELECT event_id AS seq, ts, value, user_id AS pid, user_id % 10 AS host, CASE WHEN event_type = 'click' THEN 'memory' ELSE 'cpu' END AS metric FROM events),
 s AS (SELECT *, count(*) OVER p AS n, (value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0) AS z FROM m WINDOW p AS (PARTITION BY pid, metric ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 q AS (SELECT host, pid, ts, seq, metric, value, CASE WHEN n >= 12 THEN z END AS sigma FROM s),
 w AS (SELECT *, count(*) OVER h AS n, avg(value) OVER p AS mp, stddev_samp(value) OVER p AS sp FROM m WINDOW p AS (PARTITION BY host ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY host ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT DISTINCT host, ts AS opened FROM w WHERE n >= 12 AND sp > 0 AND abs((value - mp) / sp) >= 5),
 l AS (SELECT a.opened, q.* FROM a JOIN q ON a.host = q.host AND q.ts <= a.opened AND q.ts > a.opened - INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY a.host, a.opened, q.pid, q.metric ORDER BY q.ts DESC, q.seq DESC) = 1),
 b AS (SELECT host, opened, pid, max(value) FILTER (WHERE metric = 'cpu') AS cpu, max(sigma) FILTER (WHERE metric = 'cpu') AS zc, max(value) FILTER (WHERE metric = 'memory') AS mem, max(sigma) FILTER (WHERE metric = 'memory') AS zm FROM l GROUP BY ALL),
 x AS (SELECT host, opened, pid, CASE WHEN zm IS NOT NULL AND (zc IS NULL OR zm > zc) THEN 'memory' ELSE 'cpu' END AS metric, zc, zm, cpu, mem FROM b),
 y AS (SELECT host, opened, pid, metric, CASE metric WHEN 'memory' THEN mem ELSE cpu END AS value, CASE metric WHEN 'memory' THEN zm ELSE zc END AS sigma FROM x),
 r AS (SELECT *, row_number() OVER (PARTITION BY host, opened ORDER BY CASE WHEN sigma >= 1.5 THEN 0 ELSE 1 END, CASE WHEN sigma >= 1.5 THEN sigma ELSE value END DESC, pid)::INTEGER AS rank FROM y WHERE sigma >= 1.5 OR (sigma IS NULL AND value >= 20))
 SELECT host, opened, rank, pid, metric, value, round(sigma, 4) AS sigma FROM r WHERE rank <= 3""")
def culprits(spark, d):
    return culprits_of(spark, d).select("host", ntz("opened"), "rank", "pid", "metric", "value", F.round("sigma", 4).alias("sigma"))


SEVERITY_SQL = r"""WITH d AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS m FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
 l AS (SELECT d.*, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warn' WHEN quality = 1 THEN 'info' END AS severity, list_filter(regexp_extract_all(m, '[A-Za-z0-9]{2,}'), lambda t: NOT regexp_full_match(t, '[0-9]+')) AS ts FROM d LEFT JOIN labels USING (doc_id)),
 v AS (SELECT tok, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(tok, ''), lambda c: ascii(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) % 4096 AS bucket FROM (SELECT DISTINCT lower(unnest(ts)) AS tok FROM l)),
 t AS (SELECT doc_id, line, severity, m, bucket FROM (SELECT doc_id, line, severity, m, lower(unnest(ts)) AS tok FROM l) JOIN v USING (tok)),
 h AS (SELECT severity, bucket, count(*) AS hits FROM t WHERE severity IS NOT NULL AND trim(m) <> '' GROUP BY ALL),
 c AS (SELECT severity, count(*) AS lines, (SELECT coalesce(sum(hits), 0) FROM h WHERE h.severity = l.severity) AS tokens FROM l WHERE severity IS NOT NULL AND trim(m) <> '' GROUP BY 1),
 s AS (SELECT t.doc_id, t.line, c.severity AS level, any_value(ln(c.lines / (SELECT sum(lines) FROM c))) + sum(ln((coalesce(h.hits, 0) + 0.5) / (c.tokens + 0.5 * 4096))) AS score FROM t CROSS JOIN c LEFT JOIN h ON h.severity = c.severity AND h.bucket = t.bucket GROUP BY ALL),
 b AS (SELECT doc_id, line, arg_max(level, (score, -ascii(level))) AS predicted, 1 / sum(exp(score - top)) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, line) AS top FROM s) GROUP BY ALL)
 SELECT l.doc_id, l.line::INTEGER AS line, l.severity, predicted, round(confidence, 3) AS confidence, CASE WHEN confidence >= 0.6 THEN predicted WHEN regexp_matches(lower(m), 'fatal|error|fail') THEN 'error' WHEN contains(lower(m), 'warn') THEN 'warn' WHEN contains(lower(m), 'debug') THEN 'debug' ELSE 'info' END AS answer FROM l LEFT JOIN b USING (doc_id, line)"""


@query(SEVERITY_SQL)
def severity_scores(spark, d):
    """Whole messages: no limit on bytes or tokens."""
    lines = tables.text_logs(spark, d)
    hits, classes = severity.severity_fit(lines)
    s = severity.severity_score(lines, hits, classes)
    return s.select("doc_id", "line", "severity", "predicted", F.round("confidence", 3).alias("confidence"), "answer")


LEVEL_NAMES = ("debug", "error", "info", "warn")
PREQUENTIAL_SQL = SEVERITY_SQL[: SEVERITY_SQL.index(" h AS (")] + f""" k AS (SELECT doc_id, line, severity, bucket, count(*) AS k FROM t WHERE severity IS NOT NULL AND trim(m) <> '' GROUP BY ALL),
 c AS (SELECT doc_id, line, k, {", ".join(f"coalesce(sum(CASE WHEN severity = '{n}' THEN k END) OVER w, 0) AS c_{n}" for n in LEVEL_NAMES)} FROM k WINDOW w AS (PARTITION BY bucket ORDER BY doc_id, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT doc_id, line, sum(k) AS n, {", ".join(f"sum(k * ln(c_{n} + 0.5)) AS g_{n}" for n in LEVEL_NAMES)} FROM c GROUP BY ALL),
 b AS (SELECT l.doc_id, l.line, severity, m, n, {", ".join(f"g_{n}, coalesce(sum(CASE WHEN severity = '{n}' THEN 1 END) OVER w, 0) AS l_{n}, coalesce(sum(CASE WHEN severity = '{n}' THEN n END) OVER w, 0) AS t_{n}" for n in LEVEL_NAMES)}
  FROM l LEFT JOIN g USING (doc_id, line) WHERE severity IS NOT NULL AND trim(m) <> '' WINDOW w AS (ORDER BY l.doc_id, l.line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT doc_id, line, severity, m, n, {", ".join(f"CASE WHEN l_{n} > 0 AND n > 0 THEN ln(l_{n} / ({' + '.join(f'l_{x}' for x in LEVEL_NAMES)})) + g_{n} - n * ln(t_{n} + 2048) END AS s_{n}" for n in LEVEL_NAMES)} FROM b),
 p AS (SELECT *, greatest({", ".join(f"s_{n}" for n in LEVEL_NAMES)}) AS top FROM s),
 q AS (SELECT *, CASE {" ".join(f"WHEN s_{n} = top THEN '{n}'" for n in LEVEL_NAMES)} END AS predicted, 1 / ({" + ".join(f"coalesce(exp(s_{n} - top), 0)" for n in LEVEL_NAMES)}) AS confidence FROM p),
 r AS (SELECT doc_id, line, severity, predicted, CASE WHEN top IS NOT NULL THEN confidence END AS confidence, predicted = severity AS hit,
  severity = CASE WHEN regexp_matches(lower(m), 'fatal|error|fail') THEN 'error' WHEN contains(lower(m), 'warn') THEN 'warn' WHEN contains(lower(m), 'debug') THEN 'debug' ELSE 'info' END AS rule_hit FROM q)"""


@query(PREQUENTIAL_SQL + " SELECT doc_id, line::INTEGER AS line, severity, predicted, round(confidence, 3) AS confidence, hit, rule_hit FROM r")
def severity_prequential(spark, d):
    g = severity.severity_prequential(tables.text_logs(spark, d), "doc_id", "line")
    return g.withColumn("confidence", F.round("confidence", 3))


READY_SQL = """, n AS (SELECT count(*) AS graded, avg(hit::INT) AS accuracy, avg(rule_hit::INT) AS rule_accuracy FROM (SELECT * FROM r WHERE predicted IS NOT NULL ORDER BY doc_id DESC, line DESC LIMIT 500)),
 z AS (SELECT sum(n)::BIGINT AS trained, count(*) FILTER (WHERE n >= 20) AS large FROM (SELECT severity, count(*) AS n FROM r GROUP BY 1)),
 y AS (SELECT *, coalesce(trained >= 200 AND large >= 2 AND accuracy >= rule_accuracy + 0.01, false) AS ready FROM n, z)"""


def severity_ready(spark, d):
    lines = tables.text_logs(spark, d)
    return severity.readiness(severity.severity_prequential(lines, "doc_id", "line"), severity.severity_fit(lines)[1], "doc_id", "line")


@query(PREQUENTIAL_SQL + READY_SQL + " SELECT graded, round(accuracy, 4) AS accuracy, round(rule_accuracy, 4) AS rule_accuracy, trained, ready FROM y")
def severity_readiness(spark, d):
    return rounded(severity_ready(spark, d), "accuracy", "rule_accuracy")


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS m FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
 SELECT doc_id, line::INTEGER AS line, CASE WHEN regexp_matches(lower(m), 'fatal|error|fail') THEN 'error' WHEN contains(lower(m), 'warn') THEN 'warn' WHEN contains(lower(m), 'debug') THEN 'debug' ELSE 'info' END AS severity FROM l""")
def fallback_severity(spark, d):
    return tables.text_logs(spark, d).select("doc_id", "line", T.fallback_severity(F.col("message")).alias("severity"))


STATSD_SQL = """WITH e AS (SELECT event_type AS name, 'u:' || (user_id % 3) || ',z' AS tags, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS flush, round(value, 2) AS v, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1 END AS rate, ts, event_id FROM events),
 t AS (SELECT name, tags, flush, list_sort(list(v)) AS vs, sum(v) AS s, count(*) AS n FROM e WHERE name = 'view' GROUP BY ALL)
 SELECT name, tags, NULL AS quantile, flush, round(sum(v / rate), 4) AS value FROM e WHERE name NOT IN ('view', 'click') GROUP BY ALL UNION ALL SELECT name, tags, NULL, flush, arg_max(v, (ts, event_id)) FROM e WHERE name = 'click' GROUP BY ALL
 UNION ALL SELECT 'view_count', tags, NULL, flush, n FROM t UNION ALL SELECT 'view_sum', tags, NULL, flush, round(s, 4) FROM t UNION ALL SELECT 'view', tags, '0.5', flush, vs[floor(0.5 * (n - 1))::INTEGER + 1] FROM t
 UNION ALL SELECT 'view', tags, '0.9', flush, vs[floor(0.9 * (n - 1))::INTEGER + 1] FROM t UNION ALL SELECT 'view', tags, '0.99', flush, vs[floor(0.99 * (n - 1))::INTEGER + 1] FROM t"""


def statsd_lines(spark, d):
    """Events as lines; every second one has a rate, before or behind its tags."""
    kind = F.when(F.col("event_type") == "view", "d").when(F.col("event_type") == "click", "g").otherwise("c")
    tags = F.format_string("|#z,u:%d", F.col("user_id") % 3)
    rate = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("|@0.5"), tags)).when(F.col("event_id") % 2 == 0, F.concat(tags, F.lit("|@0.5"))).otherwise(tags)
    line = F.concat(F.format_string("%s:%.2f|%s", "event_type", "value", kind), rate)
    return tables.table(spark, d, "events").select(line.alias("value"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("seq"))


@query(STATSD_SQL)
def statsd_rollup(spark, d):
    r = wire.statsd_rollup(statsd_lines(spark, d), "1 hour")
    return r.select("name", "tags", "quantile", ntz("flush"), F.round("value", 4).alias("value"))


@query("""WITH e AS (SELECT 'u:' || (user_id % 3) || ',z' AS tags, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS flush, round(value, 2) AS v, ts, event_id FROM events WHERE event_type = 'click'),
 g AS (SELECT tags, flush, arg_max(v, (ts, event_id)) AS value FROM e GROUP BY ALL), n AS (SELECT *, lead(flush) OVER (PARTITION BY tags ORDER BY flush) AS nxt FROM g)
 SELECT tags, unnest(generate_series(flush, least(coalesce(nxt, flush + INTERVAL 10 HOUR), flush + INTERVAL 10 HOUR) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS flush, value FROM n""")
def gauge_carry(spark, d):
    """Gauges repeated each hour until the next value or ten hours of silence."""
    r = wire.statsd_rollup(statsd_lines(spark, d), "1 hour").where("name = 'click'").select("name", "tags", "flush", "value")
    return wire.gauge_carry(r, 3_600, 36_000).select("tags", ntz("flush"), "value")


@query("""WITH e AS (SELECT 'u:' || (user_id % 3) AS tags, ts, event_id AS seq, CASE event_id % 3 WHEN 2 THEN -round(value, 2) ELSE round(value, 2) END AS v, event_id % 3 = 0 AS plain FROM events WHERE event_type <> 'view'),
 r AS (SELECT *, plain OR coalesce(ts - lag(ts) OVER w > INTERVAL 10 MINUTE, true) AS anew FROM e WINDOW w AS (PARTITION BY tags ORDER BY ts, seq)),
 g AS (SELECT *, sum(anew::INT) OVER (PARTITION BY tags ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS part FROM r), s AS (SELECT *, sum(v) OVER (PARTITION BY tags, part ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS running FROM g)
 SELECT tags, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS flush, round(arg_max(running, (ts, seq)), 3) AS value FROM s GROUP BY ALL""")
def relative_gauges(spark, d):
    """Events as gauge lines, two of three relative, one of them with a minus; the views, which are no lines here, come as sets that are ignored."""
    v = F.format_string("%.2f", "value")
    text = F.when(F.col("event_id") % 3 == 0, v).when(F.col("event_id") % 3 == 1, F.concat(F.lit("+"), v)).otherwise(F.concat(F.lit("-"), v))
    kind = F.when(F.col("event_type") == "view", "|s|#u:").otherwise("|g|#u:")
    lines = tables.table(spark, d, "events").select(F.concat(F.lit("load:"), text, kind, (F.col("user_id") % 3).cast("string")).alias("value"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("seq"))
    return wire.statsd_rollup(lines, "1 hour").select("tags", ntz("flush"), F.round("value", 3).alias("value"))


@query("SELECT event_type || '_total' AS name, user_id::VARCHAR AS user, max(value) AS value FROM events GROUP BY ALL")
def exposition_rollup(spark, d):
    """Events as scrapes in exposition text, one scrape a user and hour, then read back and reduced."""
    e = tables.table(spark, d, "events")
    line = F.concat("event_type", F.lit('_total{user="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("value").cast("string"))
    scrapes = e.groupBy(F.concat_ws("@", "user_id", F.date_trunc("hour", "ts")).alias("scrape")).agg(F.concat_ws("\n", F.lit("# TYPE x counter"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    s = wire.exposition_samples(scrapes)
    return s.groupBy("name", F.col("labels")["user"].alias("user")).agg(F.max("value").alias("value"))


@query("SELECT event_type AS name, user_id::VARCHAR AS user, ts AS timestamp, round(value, 6) AS value FROM events")
def otlp_metrics(spark, d):
    """Events as export requests, one a user and day, then flattened."""
    e = tables.table(spark, d, "events")
    point = F.struct((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    m = e.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.collect_list(point).alias("dataPoints"))
    m = m.groupBy("user_id", "day").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), F.struct("dataPoints").alias("gauge"))).alias("metrics"))
    attrs = F.array(F.struct(F.lit("user").alias("key"), F.struct(F.col("user_id").cast("string").alias("intValue")).alias("value")))
    doc = F.struct(F.array(F.struct(F.struct(attrs.alias("attributes")).alias("resource"), F.array(F.struct("metrics")).alias("scopeMetrics"))).alias("resourceMetrics"))
    flat = wire.otlp_metrics(m.select(F.to_json(doc).alias("value")))
    return flat.select("name", F.col("labels")["user"].alias("user"), ntz(), F.round("value", 6).alias("value"))


@query("""WITH m AS (SELECT event_type AS name, date_trunc('hour', ts) AS "at", avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT name, "at" + INTERVAL 1 HOUR AS "at", v FROM m)
 SELECT coalesce(m.name, f.name) AS name, coalesce(m."at", f."at") AS "at", round(m.v, 4) AS observed, round(f.v, 4) AS forecast FROM m FULL JOIN f ON m.name = f.name AND m."at" = f."at" """)
def forecast_against_actual(spark, d):
    """Persistence one hour ahead against what came: every hour of either side."""
    m = rollup.minute_means(tables.metrics(spark, d), grain="hour")
    f = m.select("name", F.timestamp_add("HOUR", F.lit(1), "at").alias("at"), "value")
    return rounded(rollup.outer_minutes(m, f), "observed", "forecast").select("name", ntz("at"), "observed", "forecast")


@query("""SELECT user_id::VARCHAR AS id, 'user' || user_id AS name, '' AS image, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS cpu, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS memory FROM events GROUP BY user_id""")
def container_table(spark, d):
    user = F.col("labels")["user"]
    m = tables.metrics(spark, d).withColumn("labels", F.create_map(F.lit("container_id"), user, F.lit("container_name"), F.concat(F.lit("user"), user)))
    return report.container_table(m, "view", "click")


@query(f"WITH {LOGS}, c AS (SELECT {TEMPLATE} AS template, count(*) AS lines, count(*) FILTER (WHERE severity = 'error') AS errors FROM logs GROUP BY ALL) SELECT template, round(errors / lines, 4) AS value FROM c ORDER BY errors / lines DESC, lines DESC, template LIMIT 8")
def top_templates(spark, d):
    c = rollup.log_templates(tables.logs(spark, d)).withColumn("score", F.col("errors") / F.col("lines"))
    return rounded(report.top_templates(c), "value")


@query("""WITH s AS (SELECT user_id::VARCHAR AS user, date_diff('microsecond', min(ts), max(ts)) AS span FROM events GROUP BY 1), r(range, below) AS (VALUES ('15m', 0), ('1h', 900), ('6h', 3600), ('24h', 21600), ('7d', 86400))
 SELECT s.user, r.range FROM s JOIN r ON r.below = 0 OR r.below * 1000000::BIGINT < s.span""")
def offered_ranges(spark, d):
    return report.offered_ranges(tables.metrics(spark, d).withColumn("user", F.col("labels")["user"]), "user")


@query("""WITH f AS (SELECT user_id, bool_or(event_type = 'view' AND value > 100) AS exported, bool_or(event_type = 'click' AND value > 100) AS dataset_known, bool_or(value > 200) AS model_known, bool_or(event_type = 'error' AND value > 50) AS has_champion, bool_or(event_type = 'view' AND value > 50) AS active_job FROM events GROUP BY 1)
 SELECT user_id, CASE WHEN model_known AND has_champion THEN 'ready' WHEN model_known AND active_job THEN 'training' WHEN model_known THEN 'no-champion' WHEN dataset_known OR exported THEN 'missing' ELSE 'waiting-for-data' END AS state FROM f""")
def dataset_status(spark, d):
    """A user's events stand in for a model's registry entry."""
    kind, v = F.col("event_type"), F.col("value")
    flags = {"exported": (kind == "view") & (v > 100), "dataset_known": (kind == "click") & (v > 100), "model_known": v > 200, "has_champion": (kind == "error") & (v > 50), "active_job": (kind == "view") & (v > 50)}
    r = tables.table(spark, d, "events").groupBy("user_id").agg(*[F.bool_or(f).alias(k) for k, f in flags.items()])
    return report.dataset_status(r).select("user_id", "state")


@query(f"""WITH {LOGS}, c AS (SELECT source, {TEMPLATE} AS template, count(*) AS lines, count(*) FILTER (WHERE severity = 'error') AS errors FROM logs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lines DESC, template) AS k FROM c QUALIFY k <= 10)
 SELECT source, to_json(list({{'rank': k, 'count': lines, 'errorCount': errors, 'template': CASE WHEN length(template) > 20 THEN substr(template, 1, 20) || '…' ELSE template END}} ORDER BY k))::VARCHAR AS payload FROM r GROUP BY source""")
def summary_payload(spark, d):
    return report.summary_payload(rollup.log_templates(tables.logs(spark, d), "source"), "source", most=20)


@query(f"""WITH {LOGS}, {ZSCORE.format(by='')}, c AS (SELECT source, {TEMPLATE} AS template, count(*) AS lines, count(*) FILTER (WHERE severity = 'error') AS errors FROM logs GROUP BY ALL),
 i AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN abs(z) >= 5 THEN 0 ELSE 1 END, timestamp DESC, 'anomaly:' || name || ':' || lpad(seq::VARCHAR, 12, '0')) AS k FROM z WHERE abs(z) >= 3 QUALIFY k <= 20),
 j AS (SELECT *, row_number() OVER (ORDER BY lines DESC, template, source) AS k FROM c QUALIFY k <= 20)
 SELECT to_json({{'insights': (SELECT list({{'rank': k, 'kind': 'anomaly', 'severity': CASE WHEN abs(z) >= 5 THEN 'critical' ELSE 'warning' END, 'title': printf('%s: z %.1f', name, z), 'metric': name, 'value': value, 'description': printf('value %.2f', value)}} ORDER BY k) FROM i),
  'clusters': (SELECT list({{'rank': k, 'count': lines, 'errorCount': errors, 'source': source, 'template': CASE WHEN length(template) > 24 THEN substr(template, 1, 24) || '…' ELSE template END}} ORDER BY k) FROM j)}})::VARCHAR AS payload""")
def summary_document(spark, d):
    """Anomalies and templates as one document."""
    a = incidents.anomaly_rows(baseline.metric_anomalies(tables.metrics(spark, d), "name")).withColumn("description", F.format_string("value %.2f", "value"))
    return report.summary_document(a, rollup.log_templates(tables.logs(spark, d), "source"), most=24)


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), m AS (SELECT trim(unnest(ls), chr(32)) AS whole, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warn' WHEN quality = 1 THEN 'info' END AS severity FROM l JOIN labels USING (doc_id)),
 c AS (SELECT CASE WHEN strlen(whole) <= 4096 THEN whole ELSE substr(whole, 1, list_max([k FOR k IN range(1024, 4097) IF strlen(substr(whole, 1, k::INTEGER)) <= 4096])::INTEGER) END AS message, severity FROM m)
 SELECT sha256(message) AS message_sha256, severity, count(*) AS lines FROM c WHERE message <> '' AND severity IS NOT NULL GROUP BY ALL""")
def export_severity(spark, d):
    """Declared lines, cut at 4,096 bytes, as CSV files, read back."""
    lines = scan.declared_levels(tables.text_logs(spark, d)).select(scan.cut_bytes(F.col("message")).alias("message"), "severity")
    path = new_path(spark, "severity-csv")
    report.export_csv(lines.where(F.col("message") != ""), path)
    back = report.read_csv(spark, path, "message string, severity string")
    return back.groupBy(F.sha2("message", 256).alias("message_sha256"), "severity").agg(F.count(F.lit(1)).alias("lines"))


@query("""SELECT event_type AS name, date_trunc('hour', ts) AS "at", round(avg(value), 4) AS value FROM events GROUP BY ALL""")
def export_forecast(spark, d):
    """Hourly means as CSV files (the rows a forecast is trained on), read back."""
    path = new_path(spark, "forecast-csv")
    report.export_csv(rounded(rollup.minute_means(tables.metrics(spark, d), grain="hour"), "value").select("name", "at", "value"), path)
    return report.read_csv(spark, path, "name string, at timestamp, value double").select("name", ntz("at"), "value")


@query("SELECT event_type AS name, count(*) AS points, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def written_metrics(spark, d):
    """Metrics appended to date folders and read back through a window."""
    path = new_path(spark, "metrics")
    tables.write_records(tables.metrics(spark, d), path)
    m = tables.read_records(spark, path, tables.METRIC).where("date >= '2024-01-05' AND date < '2024-01-20'")
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH p AS (SELECT user_id % 10 AS target, ts, event_id, (value / 5)::INTEGER AS days, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS valid FROM events),
 l AS (SELECT target, arg_max(days, (ts, event_id)) AS days_remaining, arg_max(valid, (ts, event_id)) AS valid FROM p WHERE ts <= TIMESTAMP '2024-01-31' AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1), t AS (SELECT DISTINCT target FROM p)
 SELECT t.target, days_remaining, valid, CASE WHEN valid = 0 THEN 'danger' WHEN days_remaining <= 0 THEN 'danger' WHEN days_remaining < 14 THEN 'warning' WHEN days_remaining IS NOT NULL THEN 'success' END AS tone FROM t LEFT JOIN l USING (target)""")
def certificates(spark, d):
    e = tables.table(spark, d, "events")
    p = e.select((F.col("user_id") % 10).alias("target"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("seq"), F.round(F.col("value") / 5).cast("int").alias("days_remaining"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("valid"))
    return rollup.certificates(p, "2024-01-01", "2024-01-31")


@query("SELECT user_id % 10 AS host, ts::DATE::VARCHAR AS day, event_type AS state, count(*) AS connections FROM events GROUP BY ALL")
def connection_states(spark, d):
    e = tables.table(spark, d, "events").select((F.col("user_id") % 10).alias("host"), F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("state"))
    return rollup.connection_states(e, "host", "day")


@query("""WITH t AS (SELECT ts::DATE AS day, user_id AS pid, sum(value) FILTER (WHERE event_type = 'view') AS cpu, count(*) AS rss FROM events GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY cpu DESC NULLS LAST, rss DESC, pid) AS k FROM t) SELECT day::VARCHAR AS day, pid, round(cpu, 4) AS cpu, rss FROM r WHERE k <= 40 OR pid = 3""")
def process_rows(spark, d):
    """The 40 busiest processes of every day and one that is always kept."""
    e = tables.table(spark, d, "events")
    t = e.groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("pid")).agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("cpu"), F.count(F.lit(1)).alias("rss"))
    return rounded(scan.ordered_processes(t, "day", pinned=3), "cpu").withColumn("day", F.col("day").cast("string"))


@query("""WITH t AS (SELECT DISTINCT user_id AS pid, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS tick FROM events), l AS (SELECT *, lag(tick) OVER (PARTITION BY pid ORDER BY tick) AS b FROM t) SELECT pid, tick FROM l WHERE b = tick - 1""")
def seen_before(spark, d):
    t = tables.table(spark, d, "events").select(F.col("user_id").alias("pid"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("tick")).distinct()
    return baseline.seen_before(t, "pid")


@query("""WITH s AS (SELECT event_type AS name, user_id, max(ts) AS last_seen, bool_or(value > 200) AS hot FROM events GROUP BY ALL)
 SELECT name || ':' || user_id AS service, CASE WHEN last_seen < TIMESTAMP '2024-01-25' THEN 'stale' WHEN hot THEN 'outage' ELSE 'operational' END AS status FROM s""")
def service_states(spark, d):
    """Each user's events of a kind stand in for a service; a large value is a critical finding."""
    service = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    e = tables.table(spark, d, "events").withColumn("service", service)
    seen = e.groupBy("service").agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen"))
    found = e.where("value > 200").select("service", F.lit("critical").alias("severity"))
    return rollup.service_status(found, "service", seen, F.to_timestamp(F.lit("2024-01-25 00:00:30")), interval_seconds=10)


@query("""WITH a AS (SELECT event_type AS name, date_trunc('hour', ts) AS "at", avg(value) AS actual FROM events GROUP BY ALL), f AS (SELECT name, "at" + INTERVAL 1 HOUR AS "at", actual AS forecast FROM a)
 SELECT name, "at", round(forecast, 4) AS forecast, round(actual, 4) AS actual, round(forecast - actual, 4) AS error, round((forecast - actual) ** 2, 3) AS squared FROM f JOIN a USING (name, "at")""")
def settled_forecasts(spark, d):
    """Persistence one hour ahead, held against what came."""
    m = rollup.minute_means(tables.metrics(spark, d), grain="hour")
    f = m.select("name", F.timestamp_add("HOUR", F.lit(1), "at").alias("at"), "value")
    s = rollup.settled_forecasts(f, m, "name")
    return rounded(s, "forecast", "actual", "error").select("name", ntz("at"), "forecast", "actual", "error", F.round("squared", 3).alias("squared"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS m FROM documents), x AS (SELECT CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warn' WHEN quality = 1 THEN 'info' END AS declared,
 CASE WHEN regexp_matches(lower(m), 'fatal|error|fail') THEN 'error' WHEN contains(lower(m), 'warn') THEN 'warn' WHEN contains(lower(m), 'debug') THEN 'debug' ELSE 'info' END AS answer FROM l JOIN labels USING (doc_id))
 SELECT declared, count(*) AS graded, count(*) FILTER (WHERE declared <> answer) AS differ FROM x WHERE declared IS NOT NULL GROUP BY 1""")
def disagreement(spark, d):
    """The word rule's answers against the declared levels."""
    lines = tables.text_logs(spark, d)
    answers = lines.select("doc_id", "line", T.fallback_severity(F.col("message")).alias("answer"))
    return rollup.disagreement(rollup.predictions_against_declared(lines, answers, "doc_id", "line", classes=T.LEVELS), "declared")


@query("SELECT 'forecast' AS dataset, count(*) AS rows, NULL::BIGINT AS labels, count(*) >= 30 AS enough FROM (SELECT DISTINCT event_type, date_trunc('minute', ts) FROM events) UNION ALL SELECT 'severity', count(*), count(DISTINCT event_type), count(*) >= 50 AND count(DISTINCT event_type) >= 2 FROM events")
def training_gates(spark, d):
    m = tables.metrics(spark, d)
    forecast = rollup.enough(rollup.minute_means(m)).withColumn("dataset", F.lit("forecast"))
    return forecast.unionByName(rollup.enough(m, "name", rows=50).withColumn("dataset", F.lit("severity"))).select("dataset", "rows", "labels", "enough")


@query("SELECT event_type || '=' || v AS id, unnest(['kept', 'new']) AS side FROM (SELECT event_type, min(value)::INTEGER AS v FROM events GROUP BY 1) WHERE false UNION ALL SELECT DISTINCT event_type, 'new' FROM events WHERE value > 200 UNION ALL SELECT DISTINCT event_type, 'kept' FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 200)")
def merged_facets(spark, d):
    """Kinds of events as facets; those with a large value replace the kept ones."""
    e = tables.table(spark, d, "events")
    kept = e.select(F.col("event_type").alias("id"), F.lit("kept").alias("side")).distinct()
    return scan.merged_facets(kept, e.where("value > 200").select(F.col("event_type").alias("id"), F.lit("new").alias("side")).distinct(), "id")


@query(f"WITH {LOGS}, g AS (SELECT source, hour(timestamp) AS h, count(*) AS n FROM logs WHERE severity = 'error' GROUP BY ALL) SELECT DISTINCT source, (SELECT max(n) FROM g) AS ceiling FROM g")
def heatmap_scale(spark, d):
    g = rollup.error_heatmap(tables.logs(spark, d))
    return rollup.heatmap_scale(g, *[f"h{h:02d}" for h in range(24)]).select("source", "ceiling")


@query()
def model_cards(spark, d):
    """What each model has learned, how it fares against its rule, and whether it may answer."""
    sev = severity_ready(spark, d)
    graded = paging_model(spark, d)  # a vector a source
    paging = bursts.recent_accuracy(graded, order=("resolved", "opened"), last=256).join(F.broadcast(graded.agg(F.count(F.lit(1)).alias("trained"))))
    paging = paging.withColumn("ready", (F.col("graded") >= 20) & (F.col("accuracy") >= F.col("rule_accuracy") + 0.01))
    scored = baseline.metric_zscore(tables.metrics(spark, d), "name")
    rates = sequential.threshold_rates(sequential.learned_thresholds(scored, "name"), "name").agg(F.sum("points").alias("trained"), F.avg("warn_rate").alias("_w"), (F.min("points") >= 20_000).alias("ready"))
    vectors = outlier_vectors(spark, d).agg(F.count(F.lit(1)).alias("trained"), F.count_if(F.col("severity").isNotNull()).alias("_s")).withColumn("ready", F.col("trained") >= 50)
    burn = burn_readings(spark, d).agg(F.sum("readings").alias("trained"), F.avg("skill").alias("accuracy"), (F.min("readings") >= 20).alias("ready"))
    spans = tables.spans(spark, d).groupBy("service", "name").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("trained"), F.max("n").alias("_n")).withColumn("ready", F.col("_n") >= 200)
    named = culprits_of(spark, d).agg(F.count(F.lit(1)).alias("trained"), F.count_if(F.col("sigma").isNotNull()).alias("_r"), F.count_if(F.col("sigma").isNull()).alias("_f")).withColumn("ready", F.col("_r") > 0)
    cards = report.model_cards(
        report.model_card(sev, "log severity"), report.model_card(paging, "paging"), report.model_card(rates, "alert thresholds", F.format_string("warnings %.4f of points", "_w")), report.model_card(vectors, "host outliers", F.format_string("%d findings", "_s")),
        report.model_card(burn, "budget forecast"), report.model_card(spans, "span latency", F.format_string("%d spans of the busiest operation", "_n")), report.model_card(named, "culprits", F.format_string("%d by baseline, %d by cpu", "_r", "_f")),
    )
    return rounded(cards, "accuracy", "fallback_accuracy")


@query("""SELECT 't' || conv_id AS trace_id, 's' || turn AS span_id, CASE WHEN turn > 0 THEN 's' || (turn - 1) END AS parent_id, role AS name, CASE WHEN conv_id % 2 = 0 THEN 'svc' || (conv_id % 5) ELSE 'unknown_service' END AS service,
 make_timestamp(conv_id * 60000000::BIGINT) AS start, CASE WHEN turn % 4 = 3 THEN 0 ELSE length(text) * 1000000::BIGINT END AS duration_ns, CASE turn % 3 WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status, turn::VARCHAR AS turn FROM conversations""")
def otlp_spans(spark, d):
    """Conversations as span export requests, one each, then flattened; every fourth span ends before it starts."""
    c = tables.table(spark, d, "conversations")
    start = F.col("conv_id") * 60_000_000_000
    took = F.when(F.col("turn") % 4 == 3, -5).otherwise(F.length("text") * 1_000_000)
    attribute = lambda k, v: F.array(F.struct(F.lit(k).alias("key"), v.alias("value")))
    span = F.struct(
        F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("traceId"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("spanId"), F.when(F.col("turn") > 0, F.concat(F.lit("S"), (F.col("turn") - 1).cast("string"))).alias("parentSpanId"), F.col("role").alias("name"),
        start.cast("string").alias("startTimeUnixNano"), (start + took).cast("string").alias("endTimeUnixNano"), attribute("turn", F.struct(F.col("turn").cast("string").alias("intValue"))).alias("attributes"), F.struct((F.col("turn") % 3).cast("int").alias("code")).alias("status"),
    )
    r = c.groupBy("conv_id").agg(F.collect_list(span).alias("spans"))
    service = F.when(F.col("conv_id") % 2 == 0, attribute("service.name", F.struct(F.concat(F.lit("svc"), (F.col("conv_id") % 5).cast("string")).alias("stringValue"))))
    doc = F.struct(F.array(F.struct(F.struct(service.alias("attributes")).alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))
    flat = wire.otlp_spans(r.select(F.to_json(doc).alias("value")))
    return flat.select("trace_id", "span_id", "parent_id", "name", "service", ntz("start"), "duration_ns", "status", F.col("attributes")["turn"].alias("turn"))


@query("""WITH e AS (SELECT *, event_id % 24 AS n FROM events) SELECT ts AS timestamp, CASE WHEN n >= 17 THEN 'error' WHEN n >= 13 THEN 'warn' WHEN n >= 9 THEN 'info' WHEN n >= 1 THEN 'debug' WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity,
 'scope' || (user_id % 7) AS source, event_type || ' ' || event_id AS message, count(*) AS lines FROM e GROUP BY ALL""")
def otlp_logs(spark, d):
    """Events as log export requests, one a user and day; half of them carry the observed time only."""
    e = tables.table(spark, d, "events")
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    log = F.struct(F.when(F.col("event_id") % 2 == 0, nanos).otherwise("0").alias("timeUnixNano"), nanos.alias("observedTimeUnixNano"), (F.col("event_id") % 24).cast("int").alias("severityNumber"), F.upper("event_type").alias("severityText"), F.struct(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("stringValue")).alias("body"))
    r = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(log).alias("logRecords"))
    scope = F.struct(F.concat(F.lit("scope"), (F.col("user_id") % 7).cast("string")).alias("name"))
    doc = F.struct(F.array(F.struct(F.array(F.struct(scope.alias("scope"), "logRecords")).alias("scopeLogs"))).alias("resourceLogs"))
    flat = wire.otlp_logs(r.select(F.to_json(doc).alias("value")))
    return flat.groupBy(ntz(), "severity", "source", "message").agg(F.count(F.lit(1)).alias("lines"))


@query("""WITH b AS (SELECT user_id, event_type AS name, ts::DATE AS day, count(*) FILTER (WHERE value <= 10) AS a, count(*) FILTER (WHERE value > 10 AND value <= 100) AS b, count(*) FILTER (WHERE value > 100) AS c, count(*) AS n, sum(value) AS s, max(value) AS hi FROM events GROUP BY ALL)
 SELECT name || '_bucket' AS name, user_id::VARCHAR AS user, day::TIMESTAMP AS timestamp, '10.0' AS le, a::DOUBLE AS value FROM b UNION ALL SELECT name || '_bucket', user_id::VARCHAR, day::TIMESTAMP, '100.0', a + b FROM b
 UNION ALL SELECT name || '_count', user_id::VARCHAR, day::TIMESTAMP, NULL, n FROM b UNION ALL SELECT name || '_sum', user_id::VARCHAR, day::TIMESTAMP, NULL, round(s, 4) FROM b UNION ALL SELECT name || '_max', user_id::VARCHAR, day::TIMESTAMP, NULL, round(hi, 4) FROM b""")
def otlp_histograms(spark, d):
    """A day's events of a user as one histogram a kind, then flattened into cumulative buckets, counts, sums and maxima."""
    e = tables.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    v = F.col("value")
    h = e.groupBy("user_id", "day", "event_type").agg(F.count_if(v <= 10).alias("a"), F.count_if((v > 10) & (v <= 100)).alias("b"), F.count_if(v > 100).alias("c"), F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.max(v).alias("hi"))
    text = lambda c: F.col(c).cast("string")
    point = F.struct((F.unix_micros(F.col("day").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"), text("n").alias("count"), F.col("s").alias("sum"), F.col("hi").alias("max"), F.array(text("a"), text("b"), text("c")).alias("bucketCounts"), F.array(F.lit(10.0), F.lit(100.0)).alias("explicitBounds"))
    m = h.groupBy("user_id", "day").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("histogram"))).alias("metrics"))
    attrs = F.array(F.struct(F.lit("user").alias("key"), F.struct(text("user_id").alias("intValue")).alias("value")))
    doc = F.struct(F.array(F.struct(F.struct(attrs.alias("attributes")).alias("resource"), F.array(F.struct("metrics")).alias("scopeMetrics"))).alias("resourceMetrics"))
    flat = wire.otlp_metrics(m.select(F.to_json(doc).alias("value")))
    return flat.select("name", F.col("labels")["user"].alias("user"), ntz(), F.col("labels")["le"].alias("le"), F.round("value", 4).alias("value"))


@query(f"""WITH {LOGS}, p AS (SELECT CASE WHEN regexp_matches(lower(message), 'fatal|error|fail') THEN 'error' WHEN contains(lower(message), 'warn') THEN 'warn' WHEN contains(lower(message), 'debug') THEN 'debug' ELSE 'info' END AS severity FROM logs) SELECT severity, count(*) AS lines, true AS severity_inferred FROM p GROUP BY 1""")
def log_files(spark, d):
    """Messages as text files, read as a tailed folder is; blank lines between them are skipped."""
    path = new_path(spark, "log-files")
    tables.logs(spark, d).select(F.concat("message", F.lit("\n")).alias("value")).write.text(path)
    return wire.ingest_log_files(spark, path).groupBy("severity").agg(F.count(F.lit(1)).alias("lines"), F.bool_and("severity_inferred").alias("severity_inferred"))


@query("SELECT event_id AS at, event_type AS model FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING max(value) > 200) ORDER BY event_id DESC LIMIT 20")
def recent_jobs(spark, d):
    """The newest 20 events of kinds with a large value, which stand in for runs of managed models."""
    e = tables.table(spark, d, "events")
    managed = e.groupBy(F.col("event_type").alias("model")).agg(F.max("value").alias("top")).where("top > 200")
    return scan.recent(e.select(F.col("event_id").alias("at"), F.col("event_type").alias("model")), 20, "at", managed=managed)


@query("SELECT user_id, event_id AS seq, round(CASE WHEN c = 0 THEN 0 ELSE value / c * 100 END, 4) AS percent FROM (SELECT *, (event_id % 5) * 100.0 AS c FROM events)")
def memory_percent(spark, d):
    e = tables.table(spark, d, "events").withColumn("top", (F.col("event_id") % 5) * 100.0)
    return e.select("user_id", F.col("event_id").alias("seq"), F.round(baseline.memory_percent(F.col("value"), F.col("top")), 4).alias("percent"))


@query(f"WITH {LOGS} SELECT seq, source FROM logs WHERE severity = 'error' AND contains(lower(source), 'user1')")
def facet_filter(spark, d):
    return scan.facet_filter(tables.logs(spark, d), {"status": "error", "source": "USER1", "other": "x"}).select("seq", "source")


@query()
def classified_lines(spark, d):
    """Undeclared lines with the model's answer where it is ready and sure, else the rule's."""
    lines = tables.text_logs(spark, d)
    hits, classes = severity.severity_fit(lines)
    scored = severity.severity_score(lines.where("severity IS NULL"), hits, classes)
    return severity.classify(scored, severity_ready(spark, d)).select("doc_id", "line", "severity_answer", "answered_by")


@query()
def alert_calibration(spark, d):
    """Each name's learned limits, and the shares of points that they made warnings and pages."""
    g = sequential.learned_thresholds(baseline.metric_zscore(tables.metrics(spark, d), "name"), "name")
    return rounded(sequential.threshold_rates(g, "name"), "warn_rate", "page_rate", "warn", "critical")
