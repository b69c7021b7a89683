"""Landed wire formats as jobs: OTLP/JSON, StatsD lines, exposition text, log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vane.functions.text import fallback_severity, otlp_severity
from vane.operators.severity import severity_score

VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
ATTRS = f"array<struct<key:string,value:{VALUE}>>"
NUMBER = f"struct<timeUnixNano:string,asDouble:double,asInt:string,attributes:{ATTRS}>"
HISTOGRAM = f"struct<timeUnixNano:string,count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>,attributes:{ATTRS}>"
SUMMARY = f"struct<timeUnixNano:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>,attributes:{ATTRS}>"
METRIC = f"struct<name:string,gauge:struct<dataPoints:array<{NUMBER}>>,sum:struct<dataPoints:array<{NUMBER}>>,histogram:struct<dataPoints:array<{HISTOGRAM}>>,exponentialHistogram:struct<dataPoints:array<{HISTOGRAM}>>,summary:struct<dataPoints:array<{SUMMARY}>>>"
METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{ATTRS}>,scopeMetrics:array<struct<metrics:array<{METRIC}>>>>>>"
SPANS = f"struct<resourceSpans:array<struct<resource:struct<attributes:{ATTRS}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRS},status:struct<code:int>>>>>>>>"
LOGS = f"struct<resourceLogs:array<struct<resource:struct<attributes:{ATTRS}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{VALUE},attributes:{ATTRS}>>>>>>>"


def labels_of(*attributes: Column) -> Column:
    """Scalar attributes as text; of equal keys the last argument's value wins, nested ones have no scalar and go."""
    text = lambda v: F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"))
    maps = [F.map_from_entries(F.filter(F.transform(F.coalesce(a, F.array().cast(ATTRS)), lambda x: F.struct(x["key"], text(x["value"]))), lambda e: e["col2"].isNotNull())) for a in attributes]
    out = maps[0]
    for m in maps[1:]:
        out = overlaid(out, m)
    return out


def overlaid(below: Column, above: Column) -> Column:
    """Both maps; of equal keys the value of above."""
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def at(nanos: Column, now: Column | None = None) -> Column:
    """Nanoseconds as time; over five minutes ahead of the ingest clock becomes that clock's."""
    ts = F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / 1000).cast("long"))
    return ts if now is None else F.when(ts > now + F.expr("INTERVAL 5 MINUTES"), now).otherwise(ts)


VALUES = "array<struct<suffix:string,value:double,label:string,text:string>>"


def values_of(**named: Column) -> Column:
    """Suffixed values of a point."""
    return F.array(*[F.struct(F.lit(f"_{k}").alias("suffix"), v.cast("double").alias("value"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("text")) for k, v in named.items()])


def plain_values(p: Column) -> Column:
    return F.array(F.struct(F.lit("").alias("suffix"), F.coalesce(p["asDouble"], p["asInt"].cast("double")).alias("value"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("text")))


def bucket_values(p: Column, most: int | None) -> Column:
    """Counts by bucket made cumulative; the last bucket, without a bound, is left out."""
    bounds = p["explicitBounds"] if most is None else F.slice(p["explicitBounds"], 1, most)
    zipped = F.arrays_zip(bounds.alias("bound"), F.slice(p["bucketCounts"], F.lit(1), F.size(bounds)).alias("n"))
    empty = F.struct(F.lit(0.0).alias("total"), F.array().cast(VALUES).alias("out"))

    def more(acc: Column, x: Column) -> Column:
        total = acc["total"] + F.coalesce(x["n"].cast("double"), F.lit(0.0))
        row = F.struct(F.lit("_bucket").alias("suffix"), total.alias("value"), F.lit("le").alias("label"), x["bound"].cast("string").alias("text"))
        return F.struct(total.alias("total"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.when(bounds.isNotNull(), F.aggregate(zipped, empty, more, lambda acc: acc["out"])).otherwise(F.array().cast(VALUES))


def quantile_values(p: Column, most: int | None) -> Column:
    quantiles = p["quantileValues"] if most is None else F.slice(p["quantileValues"], 1, most)
    return F.coalesce(F.transform(quantiles, lambda q: F.struct(F.lit("").alias("suffix"), q["value"].alias("value"), F.lit("quantile").alias("label"), q["quantile"].cast("string").alias("text"))), F.array().cast(VALUES))


def otlp_metrics(payloads: DataFrame, now: Column | None = None, max_buckets: int | None = None, max_quantiles: int | None = None) -> DataFrame:
    """name, value, timestamp, labels from export requests (column value: one JSON document a row). Each document is parsed once."""
    r = payloads.select(F.explode(F.from_json("value", METRICS)["resourceMetrics"]).alias("r"))
    m = r.select(F.col("r.resource.attributes").alias("res"), F.explode("r.scopeMetrics").alias("s")).select("res", F.explode("s.metrics").alias("m"))

    def points(kind: str, values) -> Column:
        row = lambda p: F.struct(p["timeUnixNano"].alias("t"), p["attributes"].alias("a"), values(p).cast(VALUES).alias("v"))
        return F.coalesce(F.transform(F.col(f"m.{kind}.dataPoints"), row), F.array().cast(f"array<struct<t:string,a:{ATTRS},v:{VALUES}>>"))

    four = lambda p: values_of(count=p["count"], sum=p["sum"], min=p["min"], max=p["max"])
    every = F.concat(
        points("gauge", plain_values),
        points("sum", plain_values),
        points("histogram", lambda p: F.concat(four(p), bucket_values(p, max_buckets))),
        points("exponentialHistogram", four),
        points("summary", lambda p: F.concat(values_of(count=p["count"], sum=p["sum"]), quantile_values(p, max_quantiles))),
    )
    flat = m.select("res", F.col("m.name").alias("name"), F.explode(every).alias("p")).select("name", at(F.col("p.t"), now).alias("timestamp"), labels_of(F.col("res"), F.col("p.a")).alias("labels"), F.explode("p.v").alias("v"))
    labels = F.when(F.col("v.label").isNull(), F.col("labels")).otherwise(overlaid(F.col("labels"), F.create_map(F.coalesce("v.label", F.lit("")), F.coalesce("v.text", F.lit("")))))
    out = flat.select(F.concat("name", "v.suffix").alias("name"), F.col("v.value").alias("value"), "timestamp", labels.alias("labels"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))))


def otlp_spans(payloads: DataFrame) -> DataFrame:
    r = payloads.select(F.explode(F.from_json("value", SPANS)["resourceSpans"]).alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("res"), F.explode("r.scopeSpans").alias("s")).select("res", F.explode("s.spans").alias("p"))
    start, end = F.col("p.startTimeUnixNano").cast("long"), F.col("p.endTimeUnixNano").cast("long")
    status = F.when(F.col("p.status.code") == 1, "ok").when(F.col("p.status.code") == 2, "error").otherwise("unset")
    service = F.coalesce(labels_of(F.col("res"))["service.name"], F.lit("unknown_service"))
    return s.select(F.lower("p.traceId").alias("trace_id"), F.lower("p.spanId").alias("span_id"), F.lower("p.parentSpanId").alias("parent_id"), F.col("p.name").alias("name"), service.alias("service"), at(F.col("p.startTimeUnixNano")).alias("start"), F.greatest(F.lit(0).cast("long"), end - start).alias("duration_ns"), status.alias("status"), labels_of(F.col("p.attributes")).alias("attributes"))


def otlp_logs(payloads: DataFrame) -> DataFrame:
    r = payloads.select(F.explode(F.from_json("value", LOGS)["resourceLogs"]).alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("res"), F.explode("r.scopeLogs").alias("s")).select("res", "s.scope", F.explode("s.logRecords").alias("p"))
    time = F.coalesce(F.nullif(F.col("p.timeUnixNano"), F.lit("0")), F.col("p.observedTimeUnixNano"))
    body = F.coalesce("p.body.stringValue", F.col("p.body.boolValue").cast("string"), "p.body.intValue", F.col("p.body.doubleValue").cast("string"))
    source = F.coalesce(labels_of(F.col("res"))["service.name"], F.col("scope.name"))
    return s.select(at(time).alias("timestamp"), otlp_severity(F.col("p.severityNumber"), F.col("p.severityText")).alias("severity"), source.alias("source"), body.alias("message"), labels_of(F.col("res"), F.col("p.attributes")).alias("labels"), F.lit(False).alias("severity_inferred"))


def statsd_points(lines: DataFrame) -> DataFrame:
    """Parsed StatsD lines (value, timestamp, seq): name:value|type and then @rate and #tags in any order; malformed ones and sets are left out."""
    colon = F.locate(":", F.col("value"))
    fields = F.split(F.substr("value", colon + 1), r"\|")
    options = F.slice(fields, F.lit(3), F.greatest(F.size(fields), F.lit(2)))
    last = lambda sign: F.substr(F.get(F.reverse(F.filter(options, lambda f: F.startswith(f, F.lit(sign)))), F.lit(0)), F.lit(2))
    rates = F.filter(F.transform(F.filter(options, lambda f: F.startswith(f, F.lit("@"))), lambda f: F.substr(f, F.lit(2)).try_cast("double")), lambda r: r > 0)
    tags = F.array_sort(F.filter(F.split(F.coalesce(last("#"), F.lit("")), ","), lambda t: t != ""))
    text, kind = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
    p = lines.where((colon > 1) & (F.size(fields) >= 2)).select(F.substr("value", F.lit(1), colon - 1).alias("name"), text.alias("text"), text.try_cast("double").alias("number"), kind.alias("type"), F.coalesce(F.get(F.reverse(rates), F.lit(0)), F.lit(1.0)).alias("rate"), F.array_join(tags, ",").alias("tags"), "timestamp", "seq")
    return p.where(F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") != float("inf")) & F.col("type").isin("c", "g", "ms", "h", "d"))


def tag_labels(tags: Column) -> Column:
    """k:v tags as a map; a bare tag gets the empty value."""
    pairs = F.transform(F.filter(F.split(tags, ","), lambda t: t != ""), lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.when(t.contains(":"), F.regexp_replace(t, "^[^:]*:", "")).otherwise(F.lit("")).alias("v")))
    last = F.filter(pairs, lambda p, i: F.get(F.transform(pairs, lambda q: q["k"]), i + 1).isNull() | (F.get(F.transform(pairs, lambda q: q["k"]), i + 1) != p["k"]))  # tags are sorted: equal keys stand together
    return F.map_from_entries(last)


def floor_percentile(values: Column, p: float) -> Column:
    """The element at floor(p * (n - 1)) of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.lit(p) * (F.size(values) - 1)).cast("int"))


QUANTILES = (0.5, 0.9, 0.99)


def timer_values(timers: DataFrame, *keys: str) -> DataFrame:
    """keys, suffix, quantile, value of timer samples (keys, number): count and sum of the samples as they came, and the sample at floor(p * (n - 1)).

    Equal samples are counted before they are dealt, and ranks are running sums over those counts: no group's samples stand in one row.
    """
    counted = timers.groupBy(*keys, "number").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*keys)
    ranked = counted.withColumns({"_upto": F.sum("_c").over(by.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(by)})
    at = [F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_n") - 1)), F.col("number"))).alias(f"_q{i}") for i, p in enumerate(QUANTILES)]
    t = ranked.groupBy(*keys).agg(F.sum("_c").alias("_count"), F.sum(F.col("_c") * F.col("number")).alias("_sum"), *at)
    row = lambda suffix, quantile, value: F.struct(F.lit(suffix).alias("suffix"), F.lit(quantile).cast("string").alias("quantile"), value.cast("double").alias("value"))
    rows = [row("_count", None, F.col("_count")), row("_sum", None, F.col("_sum")), *[row("", str(p), F.col(f"_q{i}")) for i, p in enumerate(QUANTILES)]]
    return t.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.suffix", "r.quantile", "r.value")


#: Fixed value: seconds after which a silent gauge is forgotten.
GAUGE_TTL = 600


def gauge_values(points: DataFrame, ttl_seconds: int = GAUGE_TTL) -> DataFrame:
    """Gauge points plus running: plain values set it, +/- ones change it; after a silence longer than the ttl a change starts from 0.

    Dealt by gauge and day: a day's sums begin with what the days before it left, which is one row a day.
    """
    same, order = ["name", "tags"], ["timestamp", "seq"]
    us, ttl = F.unix_micros("timestamp"), ttl_seconds * 1_000_000
    day = Window.partitionBy(*same, "_day").orderBy(*order)
    p = points.withColumn("_day", F.to_date("timestamp"))
    anew = ~F.col("text").rlike(r"^[+-]") | F.coalesce(us - F.lag(us).over(day) > ttl, F.lit(False))
    p = p.withColumn("_anew", anew.cast("int")).withColumn("_set", F.sum("_anew").over(day))
    p = p.withColumn("_sum", F.sum("number").over(Window.partitionBy(*same, "_day", "_set").orderBy(*order)))
    last = F.struct("timestamp", "seq")
    days = p.groupBy(*[F.col(c).alias(f"_{c}") for c in same], F.col("_day").alias("_d")).agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.max("_set").alias("_sets"), F.max_by("_sum", last).alias("_tail"))
    by_day = Window.partitionBy("_name", "_tags").orderBy("_d")
    days = days.withColumn("_cut", F.coalesce(F.col("_first") - F.lag("_last").over(by_day) > ttl, F.lit(True)))
    days = days.withColumn("_part", F.sum(F.when(F.col("_cut") | (F.col("_sets") > 0), 1).otherwise(0)).over(by_day))
    days = days.withColumn("_end", F.sum("_tail").over(Window.partitionBy("_name", "_tags", "_part").orderBy("_d")))
    days = days.withColumn("_carry", F.when(~F.col("_cut"), F.lag("_end").over(by_day)).otherwise(F.lit(0.0))).select("_name", "_tags", "_d", "_carry")
    here = [F.col("name") == F.col("_name"), F.col("tags") == F.col("_tags"), F.col("_day") == F.col("_d")]
    return p.join(days, here).select(*points.columns, (F.col("_sum") + F.when(F.col("_set") == 0, F.col("_carry")).otherwise(0.0)).alias("running"))


def statsd_rollup(lines: DataFrame, flush: str = "10 seconds", carry_seconds: int | None = None) -> DataFrame:
    """name, tags, quantile, flush, value by flush window: counters by rate, gauges with relative changes, timers count, sum and quantiles.

    carry_seconds: the flush interval, if gauges shall repeat at each flush until they have been silent for ten minutes.
    """
    p = statsd_points(lines)
    window = F.window("timestamp", flush)["end"].alias("flush")
    none = F.lit(None).cast("string").alias("quantile")
    columns = ["name", "tags", "quantile", "flush", "value"]
    counters = p.where("type = 'c'").groupBy("name", "tags", window).agg(F.sum(F.col("number") / F.col("rate")).alias("value")).withColumn("quantile", none)
    gauges = gauge_values(p.where("type = 'g'")).groupBy("name", "tags", window).agg(F.max_by("running", F.struct("timestamp", "seq")).alias("value"))
    gauges = (gauges if carry_seconds is None else gauge_carry(gauges, carry_seconds)).withColumn("quantile", none)
    t = timer_values(p.where("type IN ('ms', 'h', 'd')").select("name", "tags", window, "number"), "name", "tags", "flush")
    timers = t.withColumn("name", F.concat("name", "suffix"))
    return counters.select(*columns).unionByName(gauges.select(*columns)).unionByName(timers.select(*columns))


def statsd_metrics(rolled: DataFrame) -> DataFrame:
    """Flushed values as metrics: tags and quantile become labels."""
    labels = tag_labels(F.col("tags"))
    both = F.when(F.col("quantile").isNull(), labels).otherwise(overlaid(labels, F.create_map(F.lit("quantile"), F.coalesce("quantile", F.lit("")))))
    return rolled.select("name", "value", F.col("flush").alias("timestamp"), both.alias("labels"))


def gauge_carry(gauges: DataFrame, seconds: int = 10, ttl_seconds: int = 600) -> DataFrame:
    """Each gauge at every flush until its next value, or until it has been silent for the ttl."""
    silent = F.timestamp_add("SECOND", F.lit(ttl_seconds), "flush")
    ends = gauges.withColumn("_end", F.least(F.coalesce(F.lead("flush").over(Window.partitionBy("name", "tags").orderBy("flush")), silent), silent))
    times = F.greatest(F.lit(1), F.ceil((F.unix_seconds("_end") - F.unix_seconds("flush")) / seconds).cast("int"))
    steps = F.transform(F.sequence(F.lit(0), times - 1), lambda i: F.timestamp_add("SECOND", i * seconds, F.col("flush")))
    return ends.select("name", "tags", F.explode(steps).alias("flush"), "value")


SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"


LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def unescaped(text: Column) -> Column:
    """Label values with their escaped backslashes, quotes and line breaks."""
    held = F.regexp_replace(text, r"\\\\", "\x00")
    return F.replace(F.replace(F.replace(held, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def exposition_samples(scrapes: DataFrame, target: Column | None = None, scraped: Column | None = None) -> DataFrame:
    """scrape, name, kind, labels, value, timestamp from scrapes (scrape, value: the whole text). A scrape with a bad line is dropped whole.

    Samples of histograms and summaries come as the text has them: cumulative buckets with +Inf, counts, sums, quantiles; kind is
    their family's. target: labels of the scraped target, which a sample's own outrank. scraped: time of samples without one.
    """
    extra = F.create_map().cast("map<string,string>") if target is None else target
    lines = scrapes.select("scrape", extra.alias("_target"), (F.lit(None).cast("timestamp") if scraped is None else scraped).alias("_at"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where("trim(line) <> ''")
    types = lines.where(F.col("line").rlike(r"^#\s*TYPE\s")).select("scrape", F.regexp_extract("line", r"^#\s*TYPE\s+(\S+)\s+(\S+)", 1).alias("_family"), F.regexp_extract("line", r"^#\s*TYPE\s+(\S+)\s+(\S+)", 2).alias("kind")).dropDuplicates(["scrape", "_family"])
    samples = lines.where("NOT startswith(trim(line), '#')")
    number = F.regexp_replace(F.regexp_extract("line", SAMPLE, 3), r"(?i)^([+-]?)inf$", "$1Infinity").try_cast("double")
    own = F.map_from_arrays(F.regexp_extract_all("line", F.lit(LABEL), 1), F.transform(F.regexp_extract_all("line", F.lit(LABEL), 2), unescaped))
    inside = F.regexp_extract("line", SAMPLE, 2)
    broken = F.regexp_replace(F.regexp_replace(inside, LABEL, ""), r"[\s,]", "") != ""
    ms = F.nullif(F.regexp_extract("line", SAMPLE, 4), F.lit("")).cast("long")
    name = F.nullif(F.regexp_extract("line", SAMPLE, 1), F.lit(""))
    parsed = samples.select("scrape", name.alias("name"), F.when(~broken, own).alias("_own"), "_target", number.alias("value"), F.coalesce(F.timestamp_millis(ms), "_at").alias("timestamp"))
    bad = parsed.where("name IS NULL OR value IS NULL OR _own IS NULL").select("scrape").distinct()
    good = parsed.join(bad, "scrape", "left_anti").where(~F.isnan("value"))
    family = F.regexp_replace("name", "_(bucket|count|sum)$", "")
    direct, part = types.withColumnRenamed("kind", "_direct").withColumnRenamed("_family", "name"), types.where("kind IN ('histogram', 'summary')")
    kinds = good.join(direct, ["scrape", "name"], "left").withColumn("_family", family).join(part, ["scrape", "_family"], "left")
    return kinds.select("scrape", "name", F.coalesce("_direct", "kind", F.lit("untyped")).alias("kind"), overlaid(F.col("_target"), F.col("_own")).alias("labels"), "value", "timestamp")


def ingest_log_files(spark: SparkSession, path: str, max_bytes: int | None = None, stream: bool = False, model: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Lines of text files as logs: blank (and, if asked, oversized) ones skipped, source the file's base name, severity inferred.

    model: the counts of a severity model that is ready; it answers where it is sure, the word rule elsewhere.
    """
    lines = (spark.readStream if stream else spark.read).text(path)
    source = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    kept = lines.where(F.trim("value") != "")
    kept = kept if max_bytes is None else kept.where(F.octet_length("value") <= max_bytes)
    rows = kept.select(F.current_timestamp().alias("timestamp"), source.alias("source"), F.col("value").alias("message"), F.lit(True).alias("severity_inferred"))
    if model is None:
        return rows.withColumn("severity", fallback_severity(F.col("message")))
    return severity_score(rows, *model).withColumnRenamed("answer", "severity").drop("predicted", "confidence")
