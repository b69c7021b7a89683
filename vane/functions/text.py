"""Column expressions on log text, numbers and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns, masked in this order.
MASKS = [
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b\d+(?:\.\d+)?\b",
]
FNV_OFFSET, FNV_PRIME, TOKEN_BUCKETS = 2166136261, 16777619, 4096


LEVELS = ("debug", "info", "warn", "error")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_template(message: Column) -> Column:
    """The message with identifiers, addresses and numbers masked and white space collapsed."""
    for pattern in MASKS:
        message = F.regexp_replace(message, pattern, "<*>")
    return F.trim(F.regexp_replace(message, r"(?U)\s+", " "))


def fallback_severity(message: Column) -> Column:
    low = F.lower(message)
    has = low.contains
    return F.when(has("fatal") | has("error") | has("fail"), "error").when(has("warn"), "warn").when(has("debug"), "debug").otherwise("info")


def otlp_severity(number: Column, text: Column) -> Column:
    """The number where it is set, else the level's name."""
    low = F.lower(F.trim(text))
    named = F.when(low.isin("trace", "debug"), "debug").when(low.isin("warn", "warning"), "warn").when(low.isin("error", "fatal", "critical", "panic"), "error").otherwise("info")
    return F.when(number >= 17, "error").when(number >= 13, "warn").when(number >= 9, "info").when(number >= 1, "debug").otherwise(named)


def known_severity(text: Column) -> Column:
    """One of the four levels, or null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*LEVELS), low)


#: How much of a message a bounded reader looks at.
TOKEN_LIMIT, BYTE_LIMIT = 64, 8192


def severity_tokens(message: Column, limit: int | None = None, max_bytes: int | None = None) -> Column:
    """Lower-case runs of ASCII letters and digits, without single characters and plain numbers; of the whole message unless limits are given."""
    if max_bytes is not None:
        message = F.when(F.octet_length(message) <= max_bytes, message).otherwise(F.decode(F.substring(F.encode(message, "UTF-8"), 1, max_bytes), "ISO-8859-1"))
    words = F.filter(F.split(message, "[^A-Za-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))
    lowered = F.transform(words, lambda t: F.lower(t))
    return lowered if limit is None else F.slice(lowered, 1, limit)


def token_bucket(token: Column) -> Column:
    """FNV-1a of an ASCII token, by bucket."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long"))
    mixed = F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return (mixed % TOKEN_BUCKETS).cast("int")


def series_key(name: Column, labels: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(",", name, pairs)


def label_equals(labels: Column, key: str, value: str) -> Column:
    """A missing label equals the empty text."""
    return F.coalesce(labels[key], F.lit("")) == value


def plain_number(v: Column, decimals: int | Column) -> Column:
    """At most so many decimals, without trailing zeros."""
    text = F.round(v, decimals) if isinstance(decimals, int) else v
    return F.regexp_replace(F.regexp_replace(F.format_string("%.12f", text), r"0+$", ""), r"\.$", "")


def compact_number(v: Column) -> Column:
    """1240 as 1.2k; two significant decimals below 1."""
    size = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")
    scaled = lambda d, unit: F.concat(sign, F.when(size / d >= 100, plain_number(size / d, 0)).otherwise(plain_number(size / d, 1)), F.lit(unit))
    power = F.pow(F.lit(10.0), 1 - F.floor(F.log10(size)))  # keeps two digits
    small = F.concat(sign, plain_number(F.round(size * power) / power, 12))
    large = F.when(size < 1e3, F.concat(sign, plain_number(size, 0))).when(size < 1e6, scaled(1e3, "k")).when(size < 1e9, scaled(1e6, "M")).otherwise(scaled(1e9, "B"))
    return F.when(v.isNull() | F.isnan(v) | (size == float("inf")), "–").when((size > 0) & (size < 1), small).otherwise(large)


def duration_text(ms: Column) -> Column:
    text = F.when(ms < 1, F.concat(plain_number(ms, 2), F.lit("ms"))).when(ms < 1000, F.concat(plain_number(ms, 0), F.lit("ms")))
    text = text.when(ms < 60_000, F.concat(plain_number(ms / 1000, 2), F.lit("s"))).otherwise(F.concat(plain_number(ms / 60_000, 1), F.lit("min")))
    return F.when(ms.isNull() | F.isnan(ms) | (F.abs(ms) == float("inf")), "–").otherwise(text)


def percent_text(v: Column, decimals: int = 1) -> Column:
    return F.concat(F.regexp_replace(F.format_string(f"%.{decimals}f", v), r"\.?0+$" if decimals else "$^", ""), F.lit("%"))


def bytes_text(v: Column) -> Column:
    return F.when(v < 1048576, F.format_string("%.0f KB", v / 1024)).otherwise(F.format_string("%.1f MB", v / 1048576))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def nice_step(span: Column, ticks: int = 10) -> Column:
    """The smallest of 1, 2, 5 times a power of ten that makes at most `ticks` steps."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power)


def projection_phrase(soonest: Column, latest: Column) -> Column:
    """Seconds until the budget is spent, as words; latest 0: no upper edge."""
    def rounded(s: Column) -> Column:
        grain = F.when(s < 3600, 300).otherwise(1800)
        return F.floor(s / grain + 0.5) * grain

    def human(s: Column) -> Column:
        m = F.greatest(F.floor(s / 60), F.lit(1))
        hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h"))
        return F.when(m < 60, F.concat(m.cast("string"), F.lit("m"))).when(m % 60 == 0, hours).otherwise(F.concat(hours, (m % 60).cast("string"), F.lit("m")))

    lo, hi = rounded(soonest), rounded(latest)
    about = F.concat(F.lit("in about "), human(lo))
    return (
        F.when((soonest <= 0) & (latest <= 0), "already spent")
        .when((soonest < 60) & (latest < 60), "in under a minute")
        .when(soonest < 60, F.concat(F.lit("within "), human(hi)))
        .when((latest == 0) | (hi <= lo), about)
        .otherwise(F.concat(F.lit("in "), human(lo), F.lit(" to "), human(hi)))
    )


def container_name(name: Column) -> Column:
    """Without the leading slash."""
    return F.regexp_replace(name, "^/", "")


def short_id(identifier: Column) -> Column:
    return F.left(identifier, F.lit(12))


def burst_ratio(recent: Column, previous: Column) -> Column:
    return F.when(previous == 0, recent.cast("double")).otherwise(recent / previous)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def tone_of(severity: Column) -> Column:
    return F.when(severity == "critical", "danger").when(severity == "warning", "warning").otherwise("accent")


def tls_tone(valid: Column, days: Column) -> Column:
    """Of a certificate: an invalid chain or no days left is danger, under two weeks a warning."""
    return F.when(valid == 0, "danger").when(days <= 0, "danger").when(days < 14, "warning").when(days.isNotNull(), "success")


def seasonal_hour(name: Column, timestamp: Column) -> Column:
    """The hour of a seasonal series; null for processes, whose load follows no clock."""
    return F.when(~F.startswith(name, F.lit("process.")), F.hour(timestamp))
