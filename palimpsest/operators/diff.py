"""Differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import top_prefix
from palimpsest.model import DELTA_COLS, ENTRY_COLS, ZERO_HASH


def changed_prefixes(old: DataFrame, new: DataFrame) -> DataFrame:
    """prefix and change (added, deleted, modified) of the prefixes whose hashes differ; from (prefix, prefix_hash)."""
    both = old.select("prefix", F.col("prefix_hash").alias("o")).join(new.select("prefix", F.col("prefix_hash").alias("n")), "prefix", "full_outer")
    return both.where("NOT (o <=> n)").select("prefix", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("modified").alias("change"))


def _within(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The entries of the given prefixes. A table partitioned by prefix is pruned by its folders."""
    has = "prefix" in entries.columns
    rows = entries if has else entries.withColumn("prefix", top_prefix("path"))
    return rows.join(prefixes.select("prefix"), "prefix", "left_semi").select(*ENTRY_COLS)


def _both(old: DataFrame, new: DataFrame, prefixes: DataFrame | None) -> DataFrame:
    old, new = (_within(x, prefixes) if prefixes is not None else x.select(*ENTRY_COLS) for x in (old, new))
    return old.select("path", F.struct("hash", "size_bytes", "mtime_ms").alias("o")).join(new.select("path", F.struct("hash", "size_bytes", "mtime_ms").alias("n")), "path", "full_outer")


def compute_deltas(old: DataFrame, new: DataFrame, prefixes: DataFrame | None = None, detect_renames: bool = False) -> DataFrame:
    """action, path, old_path, hash, size, mtime_ms of each path whose content differs; equal hashes give nothing.

    ``prefixes`` (of ``changed_prefixes``) spares the entries of equal subtrees. ``detect_renames`` is an extension:
    a deleted and an added path that are the only ones of their content become one renamed row.
    """
    both = _both(old, new, prefixes).where("NOT (o.hash <=> n.hash)")
    action = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("modified")
    deltas = both.select(action.alias("action"), "path", F.lit(None).cast("string").alias("old_path"), F.col("n.hash").alias("hash"), F.col("n.size_bytes").alias("size"), F.col("n.mtime_ms").alias("mtime_ms"), F.col("o.hash").alias("__was"))
    if detect_renames:
        single = lambda rows, h: rows.groupBy(F.col(h).alias("h")).agg(F.min("path").alias("p"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
        gone, come = single(deltas.where("action = 'deleted'"), "__was"), single(deltas.where("action = 'added'"), "hash")
        pairs = gone.select("h", F.col("p").alias("was")).join(come.select("h", F.col("p").alias("now")), "h").drop("h")
        rest = deltas.join(pairs.select(F.col("was").alias("path"), F.lit("deleted").alias("action")), ["path", "action"], "left_anti")
        rest = rest.join(pairs.select(F.col("now").alias("path"), "was"), "path", "left")
        renamed = F.col("was").isNotNull()
        return rest.withColumn("action", F.when(renamed, "renamed").otherwise(F.col("action"))).withColumn("old_path", F.col("was")).select(*DELTA_COLS)
    return deltas.select(*DELTA_COLS)


def diff_with_hashes(old: DataFrame, new: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """s (A, M, D), path, old and new hash, where the zero hash is an absent side."""
    both = _both(old, new, prefixes).where("NOT (o.hash <=> n.hash)")
    status = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M")
    return both.select(status.alias("s"), "path", F.coalesce("o.hash", F.lit(ZERO_HASH)).alias("old"), F.coalesce("n.hash", F.lit(ZERO_HASH)).alias("new"))
