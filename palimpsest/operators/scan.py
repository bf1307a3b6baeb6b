"""Change detection between a folder's files, the last synced state and the server.

``stats`` is (path, mtime, size), ``sync_base`` (path, hash, mtime, size, tree_mtime), ``contents`` (path, data or hash).
Files are hashed only after the cheap filters, and contents are joined last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import content_hash
from palimpsest.functions.paths import is_hash
from palimpsest.functions.patterns import path_matches
from palimpsest.model import CHUNK_THRESHOLD, ENTRY_COLS


def excluded(path: str = "path", ignore: Sequence[str] = (), internal: Sequence[str] = ()) -> Column:
    """Paths of the system's own folders, and ignored ones."""
    out = path_matches(path, ignore)
    for folder in internal:
        out = out | F.startswith(F.col(path), F.lit(folder))
    return out


def _hashed(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """The rows with ``hash`` of their contents, null for files of the chunking threshold or more and vanished ones."""
    store = contents.select("path", "data") if "data" in contents.columns else contents.select("path", F.col("hash").alias("__hash"))
    met = rows.join(store, "path", "left")
    known = content_hash(F.col("data").cast("binary")) if "data" in contents.columns else F.col("__hash")
    small = F.coalesce(F.col("size") < CHUNK_THRESHOLD, F.lit(True)) if "size" in rows.columns else F.lit(True)
    return met.withColumn("hash", F.when(small, known)).drop("data", "__hash")


def _touched(stats: DataFrame, sync_base: DataFrame, ignore: Sequence[str], internal: Sequence[str]) -> DataFrame:
    base = sync_base.select("path", F.col("hash").alias("base_hash"), F.col("mtime").alias("base_mtime"), F.col("size").alias("base_size"))
    rows = stats.select("path", "mtime", "size").where(~excluded("path", ignore, internal)).join(base, "path", "left")
    return rows.where(F.col("base_hash").isNull() | (F.col("mtime") != F.col("base_mtime")) | (F.col("size") != F.col("base_size")))


def _changes(touched: DataFrame, contents: DataFrame) -> DataFrame:
    rows = _hashed(touched, contents).where(F.col("hash").isNull() | F.col("base_hash").isNull() | (F.col("hash") != F.col("base_hash")))
    return rows.select(F.when(F.col("base_hash").isNull(), "created").otherwise("modified").alias("action"), "path", "hash", "mtime", "size")


def full_scan(stats: DataFrame, sync_base: DataFrame, contents: DataFrame, ignore: Sequence[str] = (), internal: Sequence[str] = ()) -> DataFrame:
    """action, path, hash, mtime, size: created and modified files, and deleted ones (without the rest).

    Large files count as changed by their time and size alone and have no hash yet.
    """
    up = _changes(_touched(stats, sync_base, ignore, internal), contents)
    gone = sync_base.select("path").where(~excluded("path", ignore, internal)).join(stats.select("path"), "path", "left_anti")
    nothing = [F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("size")]
    return up.unionByName(gone.select(F.lit("deleted").alias("action"), "path", *nothing))


def partial_scan(stats: DataFrame, sync_base: DataFrame, contents: DataFrame, last_sync: int, ignore: Sequence[str] = (), internal: Sequence[str] = ()) -> DataFrame:
    """As a full scan, of files touched after ``last_sync`` and without deletions; nothing before the first sync."""
    recent = stats.where((F.col("mtime") > last_sync) & F.lit(last_sync != 0))
    return _changes(_touched(recent, sync_base, ignore, internal), contents)


def journal_replay(journal: DataFrame, contents: DataFrame) -> DataFrame:
    """action, path, hash of unsynced journal rows: files that vanished are skipped, renames count as modified."""
    rows = journal.where(~F.coalesce(F.col("synced"), F.lit(False))).select("ts", "path", "action")
    gone = rows.where("action = 'deleted'").select("ts", "action", "path", F.lit(None).cast("string").alias("hash"))
    kept = _hashed(rows.where("action <> 'deleted'"), contents).where("hash IS NOT NULL")
    return gone.unionByName(kept.select("ts", F.when(F.col("action") == "created", "created").otherwise("modified").alias("action"), "path", "hash"))


def unsynced_paths(pending: DataFrame, journal: DataFrame) -> DataFrame:
    return pending.select("path").unionByName(journal.where(~F.coalesce(F.col("synced"), F.lit(False))).select("path")).distinct()


def pull_tiers(deltas: DataFrame, stats: DataFrame, sync_base: DataFrame, contents: DataFrame) -> DataFrame:
    """The deltas that bring content, with ``tier``: cache (known and untouched), local (the file has that content
    already) or download, and skipped and downloaded bytes."""
    rows = deltas.where("hash IS NOT NULL").select("path", "hash", F.col("size").alias("delta_size"))
    disk = stats.select("path", F.col("mtime").alias("disk_mtime"), F.col("size").alias("disk_size"))
    base = sync_base.select("path", F.col("hash").alias("base_hash"), F.col("mtime").alias("base_mtime"), F.col("size").alias("base_size"))
    have = contents.select("path", (content_hash(F.col("data").cast("binary")) if "data" in contents.columns else F.col("hash")).alias("disk_hash"))
    met = rows.join(disk, "path", "left").join(base, "path", "left").join(have, "path", "left")
    there = F.col("disk_mtime").isNotNull()
    cache = there & (F.col("base_hash") == F.col("hash")) & (F.col("base_mtime") == F.col("disk_mtime")) & (F.col("base_size") == F.col("disk_size"))
    tier = F.when(cache, "cache").when(there & (F.col("disk_hash") == F.col("hash")), "local").otherwise("download")
    size = F.coalesce(F.when(F.col("delta_size") != 0, F.col("delta_size")), F.when(tier != "download", F.col("disk_size")), F.lit(0))
    return met.select("path", "hash", tier.alias("tier"), size.alias("bytes"))


def pull_stats(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def split_ignored(deltas: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """The deltas with ``bucket``: kept, ignored_delete (untrack, keep the file) or ignored_upsert (never fetched)."""
    hit = path_matches("path", ignore)
    return deltas.withColumn("bucket", F.when(~hit, "kept").when(F.col("action") == "deleted", "ignored_delete").otherwise("ignored_upsert"))


def exclude_deltas(deltas: DataFrame, failed: DataFrame) -> DataFrame:
    return deltas.join(failed.select("path", "action").distinct(), ["path", "action"], "left_anti")


def defer_edited(deltas: DataFrame, edited: DataFrame) -> DataFrame:
    """Deltas whose path and old path have no local edit that waits."""
    own = edited.select("path").distinct()
    rest = deltas.join(own, "path", "left_anti")
    return rest.join(own.select(F.col("path").alias("old_path")), "old_path", "left_anti")


def delta_paths(deltas: DataFrame) -> DataFrame:
    return deltas.select("path").unionByName(deltas.where("old_path IS NOT NULL").select(F.col("old_path").alias("path")))


def missing(requested: DataFrame, store: DataFrame) -> DataFrame:
    """Requested rows (hash, ord) that the store lacks; malformed hashes drop out, repeated ones stay."""
    asked = requested.where(is_hash("hash"))
    return asked.join(store.select(F.col("hash").alias("__h")).distinct(), F.lower("hash") == F.col("__h"), "left_anti")


def reconcile(files: DataFrame, store: DataFrame) -> DataFrame:
    """hash, path of contents that the server lacks; of several files of one content the first by ``ord`` sends it."""
    return files.groupBy("hash").agg(F.min_by("path", "ord").alias("path")).join(store.select("hash").distinct(), "hash", "left_anti")


def rebase_entries(sync_base: DataFrame) -> DataFrame:
    """The tree's entries from the last synced state; the tree's own mtime goes before the file's."""
    return sync_base.select("path", "hash", F.coalesce("tree_mtime", "mtime").alias("mtime_ms"), F.col("size").alias("size_bytes"))


def rebase_tree(entries: DataFrame, deltas: DataFrame, sync_base: DataFrame, now_ms: int) -> DataFrame:
    """The entries after a pull's deltas; what a delta lacks comes from the last synced state."""
    gone = deltas.where("action = 'deleted'").select("path").unionByName(deltas.where("action = 'renamed' AND old_path IS NOT NULL").select(F.col("old_path").alias("path"))).distinct()
    base = sync_base.select("path", F.col("tree_mtime").alias("__tree"), F.col("size").alias("__size"))
    up = deltas.where("action <> 'deleted' AND hash IS NOT NULL").join(base, "path", "left")
    up = up.select("path", "hash", F.coalesce("mtime_ms", "__tree", F.lit(now_ms)).alias("mtime_ms"), F.coalesce("size", "__size", F.lit(0)).alias("size_bytes"))
    kept = entries.select(*ENTRY_COLS).join(gone.unionByName(up.select("path")).distinct(), "path", "left_anti")
    return kept.unionByName(up)


def parity(local: Column, server: Column) -> Column:
    """Whether two roots are equal; null if either is unknown."""
    return local == server


def publish_guard(tree_files: Column, base_files: Column, blocked: Column, base_root: Column, server_root: Column) -> Column:
    """Why a push waits: blocked, no_base or diverged; null if it may go."""
    epsilon = F.greatest(F.lit(8), F.ceil(base_files * 0.005))
    return (
        F.when(blocked, "blocked")
        .when(base_root.isNull() & server_root.isNotNull() & (base_files > 0), "no_base")
        .when((tree_files >= 0) & (F.abs(tree_files - base_files) > epsilon), "diverged")
    )


def upload_order(changes: DataFrame, priority: str, seed: int = 0) -> DataFrame:
    """The changes by priority: sequential, oldest, newest, smallest, biggest, alphabetic or random; ties by ``ord``."""
    of = {"oldest": F.coalesce("mtime", F.lit(0)), "newest": -F.coalesce("mtime", F.lit(0)), "smallest": F.coalesce("size", F.lit(0)), "biggest": -F.coalesce("size", F.lit(0)), "alphabetic": F.col("path"), "random": F.xxhash64("path", F.lit(seed))}
    return changes.orderBy(*([of[priority]] if priority != "sequential" else []), "ord")
