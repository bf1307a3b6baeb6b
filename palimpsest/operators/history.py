"""Versions: lists, sizes of changes, lineage, and the aggregates of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import HISTORY_LIMIT, ONLINE_MS, PEER_MS, PRESENCE_MS, REVOKED_MS, STATS_LIMIT


def history(roots: DataFrame, current: str, limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """Versions, newest first, ties by hash: root_hash, parent_hash, created_ms, device_id, total_files, current."""
    rows = roots.select("root_hash", "parent_hash", "created_ms", "device_id", "total_files", (F.col("root_hash") == current).alias("current"))
    rows = rows.orderBy(F.desc("created_ms"), "root_hash")
    return rows if limit is None else rows.limit(limit)


def _newest(roots: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` versions that name a parent, if it is in the history."""
    newest = roots.where("parent_hash IS NOT NULL").orderBy(F.desc("created_ms"), "root_hash").limit(limit).select("root_hash", "parent_hash")
    return newest.join(roots.select(F.col("root_hash").alias("parent_hash")), "parent_hash", "left_semi")


def _stats(newest: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """From both sides' entries (root_hash, path, hash, size_bytes), the parent's under the version's root_hash."""
    n, o = new.select("root_hash", "path", F.struct("hash", "size_bytes").alias("n")), old.select("root_hash", "path", F.col("hash").alias("o"))
    both = n.join(o, ["root_hash", "path"], "full_outer").where("NOT (n.hash <=> o)")
    sums = both.groupBy("root_hash").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n.size_bytes"), F.lit(0)).alias("bytes"))
    return newest.select("root_hash").join(sums, "root_hash", "left").select("root_hash", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def version_stats(roots: DataFrame, entries: DataFrame, limit: int = STATS_LIMIT) -> DataFrame:
    """root_hash, files (paths that differ from the parent's) and bytes (sizes of added and modified ones).

    Only versions whose parent is in the history, the newest ``limit`` that name one. ``entries`` has root_hash.
    """
    newest = _newest(roots, limit)
    new = newest.join(entries, "root_hash")
    old = newest.join(entries.withColumnRenamed("root_hash", "parent_hash"), "parent_hash")
    return _stats(newest, new, old)


def stored_version_stats(roots: DataFrame, prefixes: DataFrame, entries: DataFrame, limit: int = STATS_LIMIT) -> DataFrame:
    """The same from stored folders: ``prefixes`` (root_hash, prefix, prefix_hash, batch) and their ``entries``
    (prefix_hash, batch, shard and the entry). Only folders whose hashes differ from the parent's are read."""
    newest, own = _newest(roots, limit), prefixes.dropDuplicates(["root_hash", "prefix"])
    side = lambda key, name: newest.join(own.select(F.col("root_hash").alias(key), "prefix", F.struct("prefix_hash", "batch").alias(name)), key).select("root_hash", "prefix", name)
    both = side("root_hash", "n").join(side("parent_hash", "o"), ["root_hash", "prefix"], "full_outer").where("NOT (n.prefix_hash <=> o.prefix_hash)")

    def read(name: str) -> DataFrame:
        wanted = both.where(F.col(name).isNotNull()).select("root_hash", f"{name}.prefix_hash", f"{name}.batch", F.substring(f"{name}.prefix_hash", 1, 2).alias("shard"))
        return wanted.join(entries, ["batch", "shard", "prefix_hash"])

    return _stats(newest, read("n"), read("o"))


def lineage(roots: DataFrame, start: str) -> DataFrame:
    """depth and root_hash of a version and its ancestors; only parent links are followed."""
    return roots.sparkSession.sql(
        "WITH RECURSIVE up(root_hash, parent_hash, depth) AS ("
        " SELECT root_hash, parent_hash, 0 FROM {roots} WHERE root_hash = :start"
        " UNION ALL SELECT r.root_hash, r.parent_hash, up.depth + 1 FROM {roots} r JOIN up ON r.root_hash = up.parent_hash"
        ") SELECT CAST(depth AS BIGINT) AS depth, root_hash FROM up",
        args={"start": start},
        roots=roots.select("root_hash", "parent_hash"),
    )


def storage_breakdown(objects: DataFrame) -> DataFrame:
    """bucket, bytes, files, from (bucket, size): content is the rest of all content beside manifests and chunks."""
    sums = objects.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))
    nested = F.col("bucket").isin("manifests", "chunks")
    part = sums.agg(F.sum(F.when(nested, F.col("bytes"))).alias("b"), F.sum(F.when(nested, F.col("files"))).alias("f"))
    rest = lambda have, less: F.when(F.col("bucket") == "content", F.greatest(F.lit(0), F.col(have) - F.coalesce(less, F.lit(0)))).otherwise(F.col(have))
    return sums.crossJoin(part).select("bucket", rest("bytes", "b").cast("long").alias("bytes"), rest("files", "f").cast("long").alias("files"))


def device_status(now_ms: int) -> Column:
    """Over revoked_at and last_seen: Revoked before Online before Offline."""
    return F.when(F.col("revoked_at").isNotNull(), "Revoked").when(F.lit(now_ms) - F.col("last_seen") < ONLINE_MS, "Online").otherwise("Offline")


def fleet_counts(devices: DataFrame, now_ms: int) -> DataFrame:
    """One row: devices, online (revoked ones too), revoked."""
    recent = F.lit(now_ms) - F.col("last_seen") < ONLINE_MS
    return devices.agg(F.count(F.lit(1)).alias("devices"), F.count_if(recent).alias("online"), F.count_if(F.col("revoked_at").isNotNull()).alias("revoked"))


def expired(kind: str, now_ms: int | Column) -> Column:
    """Whether a row's time is over. Codes and tickets live through their last millisecond, a bypass doesn't; revoked
    devices and presence go by their age, and what a device holds of its peers lives longer than what it tells them."""
    now = (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)).cast("long")
    if kind in ("enrollment", "ticket"):
        return now > F.col("expires_at")
    if kind == "bypass":
        return now >= F.col("expires_at")
    if kind == "revoked":
        return F.col("revoked_at").isNotNull() & (F.col("revoked_at") != 0) & (now - F.col("revoked_at") >= REVOKED_MS)
    if kind == "presence":
        return now - F.col("updated_ms") >= PRESENCE_MS
    if kind == "peer":
        return now - F.col("updated_ms") > PEER_MS
    raise ValueError(f"unknown kind: {kind}")


def sweep_revoked(devices: DataFrame, now_ms: int) -> DataFrame:
    """The devices that stay: long revoked ones go, and revocations without a time (0) start their clock now."""
    stay = devices.where(~F.coalesce(expired("revoked", now_ms), F.lit(False)))
    return stay.withColumn("revoked_at", F.when(F.col("revoked_at") == 0, F.lit(now_ms).cast("long")).otherwise(F.col("revoked_at")))
