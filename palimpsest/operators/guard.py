"""The guard against mass reverts and deletions: what a new snapshot would do to the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import GUARD_FLOOR, GUARD_PCT, GUARD_REGRESSIONS, GUARD_SKEW_MS
from palimpsest.operators.diff import _both


def guard_scan(current: DataFrame, candidate: DataFrame, skew_ms: int = GUARD_SKEW_MS, prefixes: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """One row: deletions, content_changes, mtime_regressions, additions, current_total.

    A regression is a changed content whose mtime went back by more than ``skew_ms``. ``prefixes`` spares equal
    subtrees; then ``total``, the current number of files, must be given.
    """
    changed = F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("o.hash") != F.col("n.hash"))
    back = F.col("n.mtime_ms") + skew_ms < F.col("o.mtime_ms")
    counts = _both(current, candidate, prefixes).agg(
        F.count_if(F.col("n").isNull()).alias("deletions"),
        F.count_if(changed).alias("content_changes"),
        F.count_if(changed & back).alias("mtime_regressions"),
        F.count_if(F.col("o").isNull()).alias("additions"),
        F.count_if(F.col("o").isNotNull()).alias("current_total"),
    )
    return counts if total is None else counts.withColumn("current_total", F.lit(total).cast("long"))


def guard_reason(regressions: int = GUARD_REGRESSIONS, pct: int = GUARD_PCT, floor: int = GUARD_FLOOR) -> Column:
    """Over the columns of a scan: mtime_regression, blast_radius or null. Both limits are exceeded, not reached."""
    ceiling = F.greatest(F.lit(floor).cast("long"), F.expr(f"current_total * {int(pct)} div 100"))
    return F.when(F.col("mtime_regressions") > regressions, "mtime_regression").when(F.col("deletions") + F.col("content_changes") > ceiling, "blast_radius")


def guard_trigger(scan: DataFrame, **limits) -> DataFrame:
    return scan.withColumn("reason", guard_reason(**limits))


def reject_body(scan: DataFrame) -> DataFrame:
    """The scan with ``body``: JSON that tells a client why its push was refused; null where nothing tripped."""
    told = F.struct(F.lit("guard_rejected").alias("error"), "reason", "deletions", "content_changes", "mtime_regressions", "current_total")
    return scan.withColumn("body", F.when(F.col("reason").isNotNull(), F.to_json(told)))
