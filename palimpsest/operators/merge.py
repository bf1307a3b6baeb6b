"""Three-way merge of snapshots: first by prefix, then by entry, then by line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import set_digest
from palimpsest.functions.paths import is_text_path, top_prefix
from palimpsest.functions.textops import text_merge3
from palimpsest.model import CHUNK_THRESHOLD, ENTRY_COLS, ZERO_HASH

SIDES = ("base", "a", "b")


@dataclass
class MergeResult:
    entries: DataFrame  # path, hash, mtime_ms, size_bytes
    conflicts: DataFrame  # path, base_hash, side_a_hash, side_b_hash
    metrics: DataFrame  # one row: auto_resolved, text_merged, conflicts
    merged_blobs: DataFrame | None  # hash, data of texts merged by line


def _actions(by: DataFrame) -> DataFrame:
    """prefix, act and auto from a digest of each side's state, null where the side lacks the prefix."""
    base, a, b = (F.col(s) for s in SIDES)
    no = lambda c: c.isNull()
    act = (
        F.when(no(base) & no(b), "a")
        .when(no(base) & no(a), "b")
        .when(no(base), "recurse")
        .when(no(a) & no(b), "drop")
        .when(no(a), F.when(b == base, "drop").otherwise("b"))
        .when(no(b), F.when(a == base, "drop").otherwise("a"))
        .when((a == base) & (b == base), "base")
        .when(b == base, "a")
        .when(a == base, "b")
        .otherwise("recurse")
    )
    return by.select("prefix", act.alias("act")).withColumn("auto", F.col("act").isin("a", "b"))


def prefix_actions(rows: DataFrame) -> DataFrame:
    """prefix, act (base, a, b, drop, recurse) and auto, from rows (side, prefix, entry columns).

    A prefix's state is its set of (path, hash, mtime, size), so a changed mtime is a changed prefix.
    """
    state = rows.groupBy("prefix", "side").agg(set_digest(F.col("path"), F.col("hash"), F.col("mtime_ms"), F.col("size_bytes")).alias("d"))
    return _actions(state.groupBy("prefix").agg(*[F.max(F.when(F.col("side") == s, F.col("d"))).alias(s) for s in SIDES]))


def hash_actions(base: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The same from the prefixes' hashes (prefix, prefix_hash) of the three sides; no entry is read."""
    rows = None
    for side, own in zip(SIDES, (base, a, b), strict=True):
        own = own.select(F.lit(side).alias("side"), "prefix", "prefix_hash")
        rows = own if rows is None else rows.unionByName(own)
    return _actions(rows.groupBy("prefix").agg(*[F.max(F.when(F.col("side") == s, F.col("prefix_hash"))).alias(s) for s in SIDES]))


def _outcome() -> tuple[Column, Column]:
    """Which side an entry comes from (null: dropped) and what is counted, when its prefix is merged by entry."""
    base, a, b = (F.col(f"{s}.hash") for s in SIDES)
    has = {s: F.col(s).isNotNull() for s in SIDES}
    both = has["a"] & has["b"]
    take = (
        F.when(has["base"] & both, F.when((a == base) & (b == base), "base").when(a == base, "b").otherwise("a"))
        .when(has["base"] & has["b"], F.when(b != base, "b"))
        .when(has["base"] & has["a"], F.when(a != base, "a"))
        .when(has["base"], F.lit(None))
        .when(has["a"], "a")
        .otherwise("b")
    )
    counted = (
        F.when(has["base"] & both, F.when((a == base) & (b == base), "none").when((a == base) | (b == base) | (a == b), "auto").otherwise("text"))
        .when(has["base"] & has["b"], F.when(b != base, "auto").otherwise("none"))
        .when(has["base"] & has["a"], F.when(a != base, "auto").otherwise("none"))
        .when(has["base"], "none")
        .when(both, F.when(a == b, "none").otherwise("conflict"))
        .otherwise("auto")
    )
    return take, counted


def merge_rows(base: DataFrame, a: DataFrame, b: DataFrame, actions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A row for each path (path, base, a, b, act, take, counted), and the prefixes' actions.

    The three sides meet in one shuffle by path, not in two joins. ``actions`` are those that are known already.
    """
    rows = None
    for side, entries in zip(SIDES, (base, a, b), strict=True):
        own = entries.select(F.lit(side).alias("side"), *ENTRY_COLS)
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("prefix", top_prefix("path"))
    actions = prefix_actions(rows) if actions is None else actions
    entry = F.struct("hash", "mtime_ms", "size_bytes")
    by_path = rows.groupBy("prefix", "path").agg(*[F.min(F.when(F.col("side") == s, entry)).alias(s) for s in SIDES])
    take, counted = _outcome()
    met = by_path.join(actions, "prefix")
    whole = F.col("act").isin(*SIDES)
    # a side that a prefix is taken from may lack the path: then the path is dropped
    there = F.when(F.col("act") == "base", F.col("base").isNotNull()).when(F.col("act") == "a", F.col("a").isNotNull()).when(F.col("act") == "b", F.col("b").isNotNull())
    take = F.when(whole, F.when(there, F.col("act"))).when(F.col("act") == "recurse", take)
    counted = F.when(F.col("act") == "recurse", counted).otherwise("none")
    return met.withColumn("take", take).withColumn("counted", counted), actions


def line_merges(rows: DataFrame, blobs: DataFrame, compat: str = "lossless") -> DataFrame:
    """path, hash, size_bytes, mtime_ms and data of the entries that merge by line.

    Only candidates (text name, both sides below the chunking threshold) meet the blobs; all three texts must be there
    and be strict UTF-8, and the outcome must stay below the threshold.
    """
    small = (F.col("a.size_bytes") < CHUNK_THRESHOLD) & (F.col("b.size_bytes") < CHUNK_THRESHOLD)
    wanted = rows.where((F.col("counted") == "text") & is_text_path("path") & small)
    wanted = wanted.select("path", F.greatest("a.mtime_ms", "b.mtime_ms").alias("mtime_ms"), *[F.col(f"{s}.hash").alias(f"h_{s}") for s in SIDES])
    store = blobs.select("hash", F.col("data").cast("binary").alias("data")).dropDuplicates(["hash"])
    for s in SIDES:
        wanted = wanted.join(store.select(F.col("hash").alias(f"h_{s}"), F.col("data").alias(f"d_{s}")), f"h_{s}")
    for s in SIDES:
        wanted = wanted.where(F.is_valid_utf8(F.col(f"d_{s}").cast("string")))
    merged = wanted.withColumn("m", text_merge3(compat)(*[F.col(f"d_{s}").cast("string") for s in SIDES])).where("m.status = 'merged'")
    out = merged.select("path", "mtime_ms", F.col("m.content").cast("binary").alias("data"))
    out = out.withColumn("size_bytes", F.octet_length("data").cast("long")).where(F.col("size_bytes") < CHUNK_THRESHOLD)
    return out.withColumn("hash", F.sha2("data", 256))


def merge_trees(base: DataFrame, a: DataFrame, b: DataFrame, blobs: DataFrame | None = None, compat: str = "lossless", actions: DataFrame | None = None) -> MergeResult:
    """The merge of A and B over their base, all as entries; ``blobs`` (hash, data) allows merges by line.

    With ``actions`` (of ``hash_actions``) the sides may hold the entries of the prefixes to recurse into only; then the
    merged entries are those prefixes', and the counters are the whole merge's.
    """
    rows, actions = merge_rows(base, a, b, actions)
    lines = line_merges(rows, blobs, compat) if blobs is not None else None
    chosen = F.when(F.col("take") == "base", F.col("base")).when(F.col("take") == "a", F.col("a")).when(F.col("take") == "b", F.col("b"))
    kept = rows.where("take IS NOT NULL").withColumn("e", chosen)
    if lines is not None:
        kept = kept.join(lines.select("path", F.struct("hash", "mtime_ms", "size_bytes").alias("l")), "path", "left").withColumn("e", F.coalesce("l", "e"))
    entries = kept.select("path", "e.hash", "e.mtime_ms", "e.size_bytes")
    open_ = rows.where("counted IN ('text', 'conflict')")
    if lines is not None:
        open_ = open_.join(lines.select("path"), "path", "left_anti")
    conflicts = open_.select("path", F.coalesce("base.hash", F.lit(ZERO_HASH)).alias("base_hash"), F.col("a.hash").alias("side_a_hash"), F.col("b.hash").alias("side_b_hash"))
    # counters are of two grains: a prefix that is taken whole counts once
    by_entry = rows.agg(F.count_if(F.col("counted") == "auto").alias("e"), F.count_if(F.col("counted").isin("text", "conflict")).alias("o"))
    by_prefix = actions.agg(F.count_if("auto").alias("p"))
    by_line = lines.agg(F.count(F.lit(1)).alias("t")) if lines is not None else actions.agg(F.count_if(F.lit(False)).alias("t"))
    metrics = by_entry.crossJoin(by_prefix).crossJoin(by_line).select((F.col("e") + F.col("p")).alias("auto_resolved"), F.col("t").alias("text_merged"), (F.col("o") - F.col("t")).alias("conflicts"))
    return MergeResult(entries, conflicts, metrics, lines.select("hash", "data") if lines is not None else None)
