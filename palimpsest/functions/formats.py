"""Sizes, times and rates for people, with the present always as an argument. Ties round to even digits; null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import col

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def format_bytes(n: Column | str) -> Column:
    """B, KB (whole ones), MB or GB of a number of bytes."""
    n = col(n)
    # Spark rounds the shortest decimals of a double, which may be a tie where its value is none: the value is an integer
    # over 2**30, so its hundredths are counted in integers.
    whole = n.cast("double").cast("long")
    cents = whole.bitwiseAND(F.lit(GB - 1)) * 100
    rest, down = cents.bitwiseAND(F.lit(GB - 1)), F.shiftright(cents, 30)
    cents = down + F.when(rest > GB // 2, 1).when(rest == GB // 2, down % 2).otherwise(0)
    return (
        F.when(n >= GB, F.format_string("%d.%02d GB", F.shiftright(whole, 30) + F.when(cents == 100, 1).otherwise(0), cents % 100))
        .when(n >= MB, F.format_string("%.1f MB", F.bround(n / MB, 1)))
        .when(n >= KB, F.format_string("%d KB", F.floor(n / KB)))
        .when(n.isNotNull(), F.format_string("%d B", n))
    )


def format_ago(then_ms: Column | str, now_ms: Column | int) -> Column:
    """never, just now, minutes, hours or days ago; times to come count as now."""
    then, now = col(then_ms), now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    ago = F.floor(now / 1000) - F.floor(then / 1000)
    return (
        F.when(then == 0, "never")
        .when(ago < 60, "just now")
        .when(ago < 3600, F.format_string("%d min ago", F.floor(ago / 60)))
        .when(ago < 86400, F.format_string("%d hours ago", F.floor(ago / 3600)))
        .when(ago.isNotNull(), F.format_string("%d days ago", F.floor(ago / 86400)))
    )


def format_duration(seconds: Column | str) -> Column:
    s = F.floor(col(seconds))
    days, hours, mins = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(days > 0, F.format_string("%dd %dh", days, hours))
        .when(hours > 0, F.format_string("%dh %dm", hours, mins))
        .when(mins > 0, F.format_string("%dm %ds", mins, s % 60))
        .when(s.isNotNull(), F.format_string("%ds", s % 60))
    )


def is_recent(then_ms: Column | str, now_ms: int, within_ms: int) -> Column:
    return F.lit(now_ms) - col(then_ms) < within_ms


def rate(amount: Column | str, ms: Column | str) -> Column:
    """Per second; null for no time at all."""
    return F.when(col(ms) > 0, col(amount) * 1000.0 / col(ms))


def truncate_text(text: Column | str, most: int, mark: str = "…[truncated]") -> Column:
    text = col(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def lossy_text(data: Column | str) -> Column:
    """Bytes as text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(col(data).cast("string"))


def clock(ms: Column | str) -> Column:
    """The time of day of an epoch time, as HH:MM:SS.mmm, in UTC whatever the session's zone."""
    ms = F.pmod(col(ms), F.lit(86_400_000))
    part = lambda by, of: F.floor(ms / by) % of
    return F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, 24), part(60_000, 60), part(1000, 60), part(1, 1000))


def delta_json(deltas: DataFrame) -> DataFrame:
    """value: a delta row as the JSON object that devices read; what an action does not carry is left out."""
    has = lambda c, *actions: F.when(F.col("action").isin(*actions), F.col(c)).alias(c)
    fields = ["action", "path", has("old_path", "renamed"), has("hash", "added", "modified", "renamed"), has("size", "added", "modified"), has("mtime_ms", "added", "modified")]
    return deltas.select(F.to_json(F.struct(*fields)).alias("value"))


def history_json(history: DataFrame) -> DataFrame:
    """value: a version row as a JSON object; a version without a parent says so by null."""
    row = F.struct(F.col("root_hash").alias("root"), F.col("parent_hash").alias("parent"), "created_ms", "device_id", "total_files", "current")
    return history.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def capped_strings(json: Column | str, field: str, most: int) -> Column:
    """The first ``most`` strings of a JSON array field, without its other values; empty if there is no such array."""
    cells = F.try_variant_get(F.try_parse_json(col(json)), f"$.{field}", "array<variant>")
    strings = F.transform(F.filter(cells, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.slice(F.coalesce(strings, F.array().cast("array<string>")), 1, most)
