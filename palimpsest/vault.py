"""A versioned collection in a folder: push, pull, merge, history, rollback, purge and export.

Tables are append-only Parquet below ``path``. A version is its rows of ``prefixes``, which name each top folder's
entries by their hash; a folder's entries are written once, whatever number of versions hold them, so a push writes the
folders that it changes. ``entries`` lies in folders by ``batch`` (the push that wrote it) and ``shard`` (two digits of
the hash), sorted by hash, so the entries of a few folders are read from a few files. ``roots`` has the versions and
``blobs`` the contents; ``staging`` holds what a push computes once and reads several times, and ``tidy`` empties it.

Pushes may run side by side: a push that another overtakes fails when it moves the pointer, which is a numbered file
that only one writer can create, and leaves nothing that a reader sees.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.patterns import path_matches
from palimpsest.functions.paths import is_hash
from palimpsest.model import BYPASS_MS, ENTRY_COLS, HISTORY_LIMIT, LEAF_SIZE, STATS_LIMIT, ZERO_HASH
from palimpsest.operators import diff as diffs
from palimpsest.operators import guard, merge, scan, tree
from palimpsest.operators import history as versions
from palimpsest.sources import claims, tables
from palimpsest.sources.files import clear_folder

TABLES = {
    "roots": "root_hash string, parent_hash string, created_ms long, version int, device_id string, total_files long",
    "prefixes": "root_hash string, prefix string, prefix_hash string, leaves long, files long, batch string",
    "entries": "prefix_hash string, prefix string, path string, hash string, mtime_ms long, size_bytes long, batch string, shard string",
    "blobs": "hash string, data binary",
    "manifests": "file_hash string, total_size long, chunks array<struct<hash: string, offset: long, size: long>>",
    "chunks": "hash string, data binary",
    "approvals": "device string, id string, expires_at long",
}
PREFIX = ["prefix", "prefix_hash", "leaves", "files", "batch"]
#: Folders whose entries are picked by literals; of more, by a join, which prunes when it runs.
FEW = 256


class GuardRejected(Exception):
    """A push that looks like a mass revert or deletion; ``scan`` has its counts and ``reason``."""

    def __init__(self, scan) -> None:
        super().__init__(f"guard_rejected: {scan.reason}")
        self.scan = scan


@dataclass
class PushResult:
    accepted: bool
    merged: bool
    root_hash: str
    auto_resolved: int = 0
    text_merged: int = 0
    conflicts: DataFrame | None = None
    guard_reason: str | None = None


class Vault:
    """``guard_mode`` is off, warn or enforce."""

    def __init__(self, spark: SparkSession, path: str, leaf_size: int = LEAF_SIZE, guard_mode: str = "warn", guard_limits: dict | None = None) -> None:
        self.spark, self.path, self.leaf_size = spark, path.rstrip("/"), leaf_size
        self.guard_mode, self.guard_limits = guard_mode, guard_limits or {}

    # --- tables -------------------------------------------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TABLES[name])

    def _append(self, rows: list[tuple], name: str) -> None:
        self.spark.createDataFrame(rows, TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def roots(self) -> DataFrame:
        return self._table("roots").groupBy("root_hash").agg(F.max_by(F.struct("parent_hash", "created_ms", "version", "device_id", "total_files"), "created_ms").alias("r")).select("root_hash", "r.*")

    def blobs(self) -> DataFrame:
        return self._table("blobs")

    def _stage(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Removes what pushes have staged; only when none is running and no conflicts of a result are still to be read."""
        clear_folder(self.spark, f"{self.path}/staging")

    def exists(self) -> bool:
        return not self._table("roots").isEmpty()

    def current(self) -> str | None:
        return claims.latest(self.spark, f"{self.path}/current")[1]

    def _move(self, to: str, was: str | None) -> None:
        """Compare and swap: the pointer's next number is taken only while ``was`` is current, by one writer."""
        seq, now = claims.latest(self.spark, f"{self.path}/current")
        if now != was or not claims.claim(self.spark, f"{self.path}/current", seq + 1, to):
            raise RuntimeError("the current version moved meanwhile")

    def _known(self, root: str | None) -> bool:
        return not self._table("roots").where(F.col("root_hash") == root).isEmpty()

    def prefixes(self, root: str | None) -> DataFrame:
        """prefix, prefix_hash, leaves, files, batch of a version; of the zero root none. An unknown root is an error."""
        if root not in (None, ZERO_HASH) and not self._known(root):
            raise KeyError(f"unknown version {root}")
        return self._table("prefixes").where(F.col("root_hash") == F.lit(root or ZERO_HASH)).drop("root_hash").dropDuplicates(["prefix"])

    def _entries_of(self, prefixes: DataFrame) -> DataFrame:
        """The entries, with their prefix, of some folders (prefix_hash, batch)."""
        table, wanted = self._table("entries"), prefixes.select("prefix_hash", "batch").distinct()
        few = wanted.limit(FEW + 1).collect()
        if len(few) <= FEW:
            hashes, batches = sorted({r.prefix_hash for r in few}), sorted({r.batch for r in few})
            own = table.where(F.col("batch").isin(batches) & F.col("shard").isin(sorted({h[:2] for h in hashes})) & F.col("prefix_hash").isin(hashes))
            pair = F.concat("batch", "prefix_hash")
            own = own.where(pair.isin([r.batch + r.prefix_hash for r in few])) if few else own.where("false")
        else:
            own = table.join(wanted.withColumn("shard", F.substring("prefix_hash", 1, 2)), ["batch", "shard", "prefix_hash"], "left_semi")
        return own.select("prefix", *ENTRY_COLS)

    def entries(self, root: str | None) -> DataFrame:
        """A version's entries with their prefix."""
        return self._entries_of(self.prefixes(root))

    def snapshot(self, root: str | None = None) -> DataFrame:
        """Entries by path."""
        return self.entries(root or self.current()).select(*ENTRY_COLS).orderBy("path")

    # --- contents -----------------------------------------------------------------------------------------------------

    def put_blobs(self, blobs: DataFrame) -> None:
        """Adds contents (hash, data) that are not there yet; others than their hash says are refused."""
        self._put("blobs", blobs)

    def put_chunks(self, manifests: DataFrame, chunks: DataFrame) -> None:
        """Adds large files as ``chunking.chunk_files`` and ``chunking.manifests`` cut them: each chunk once."""
        self._put("chunks", chunks)
        columns = ["file_hash", "total_size", "chunks"]
        own = self.spark.createDataFrame([], TABLES["manifests"]).unionByName(manifests.select(*columns))
        own.dropDuplicates(["file_hash"]).join(self._table("manifests").select("file_hash"), "file_hash", "left_anti").select(*columns).write.mode("append").parquet(f"{self.path}/manifests")

    def _put(self, name: str, objects: DataFrame) -> None:
        bad = objects.where(~is_hash("hash") | (F.sha2("data", 256) != F.lower("hash")) | F.col("data").isNull())
        if not bad.isEmpty():
            raise ValueError("a content's bytes do not have its hash")
        new = objects.select(F.lower("hash").alias("hash"), "data").dropDuplicates(["hash"])
        new.join(self._table(name).select("hash"), "hash", "left_anti").write.mode("append").parquet(f"{self.path}/{name}")

    def content(self, wanted: DataFrame) -> DataFrame:
        """hash, data of wanted contents (hash): the blob, or the file that its manifest puts together; null if neither is
        there whole."""
        from palimpsest.functions.chunking import reassemble

        hashes = wanted.select(F.lower("hash").alias("hash")).distinct()
        own = self._table("manifests").join(hashes.select(F.col("hash").alias("file_hash")), "file_hash", "left_semi")
        blobs = self.blobs().join(hashes, "hash", "left_semi")
        return tables.content(hashes, blobs, reassemble(own, self._table("chunks")))

    def missing(self, asked: DataFrame, kind: str = "content") -> DataFrame:
        """Of asked hashes (ord, hash), in their order, those that are not there. ``kind`` is content (a blob), manifest,
        chunk (of a file) or node (a folder's hash)."""
        column = {"content": ("blobs", "hash"), "manifest": ("manifests", "file_hash"), "chunk": ("chunks", "hash"), "node": ("prefixes", "prefix_hash")}
        table, name = column[kind]
        return scan.missing(asked, self._table(table).select(F.col(name).alias("hash")).distinct())

    # --- writing versions ---------------------------------------------------------------------------------------------

    def _store(self, entries: DataFrame, parent: str | None, device: str, now_ms: int, kept: DataFrame | None = None) -> str:
        """Writes a version of these entries and the folders ``kept`` as they are; returns its root.

        Equal contents have one root. Only folders that no version has yet are written.
        """
        batch = uuid.uuid4().hex
        entries = self._stage(entries.select(*ENTRY_COLS).withColumn("prefix", tree.top_prefix("path")))
        built = self._stage(tree.build_prefixes(tree.build_leaves(entries, self.leaf_size)))
        held = self._table("prefixes").groupBy("prefix_hash").agg(F.min("batch").alias("held"))
        own = built.join(held, "prefix_hash", "left").select("prefix", "prefix_hash", "leaves", "files", F.coalesce("held", F.lit(batch)).alias("batch"))
        table = self._stage(own if kept is None else own.unionByName(kept.select(*PREFIX)))
        root = tree.build_root(table).first()
        if self._table("prefixes").where(F.col("root_hash") == root.root_hash).isEmpty():
            new = table.where(F.col("batch") == batch).select("prefix", "prefix_hash")
            rows = entries.join(new, "prefix").withColumns({"batch": F.lit(batch), "shard": F.substring("prefix_hash", 1, 2)})
            if not new.isEmpty():
                by = ["shard", "prefix_hash", "path"]
                rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
                rows.select(*[f.split()[0] for f in TABLES["entries"].split(", ")]).write.mode("append").partitionBy("batch", "shard").parquet(f"{self.path}/entries")
            table.select(F.lit(root.root_hash).alias("root_hash"), *PREFIX).write.mode("append").parquet(f"{self.path}/prefixes")
        self._append([(root.root_hash, parent, now_ms, 1, device, root.total_files)], "roots")
        return root.root_hash

    # --- the guard ----------------------------------------------------------------------------------------------------

    def approve_bulk_change(self, device: str, now_ms: int | None = None, lives_ms: int = BYPASS_MS) -> None:
        """Lets one push of the device pass the guard, until its time is over; the approval survives a restart.

        Without ``now_ms`` the clock's time counts.
        """
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        self._append([(device, uuid.uuid4().hex, now_ms + lives_ms)], "approvals")

    def _approved(self, device: str, now_ms: int) -> str | None:
        """An approval of the device that is neither over nor used."""
        live = self._table("approvals").where((F.col("device") == device) & (F.col("expires_at") > now_ms)).orderBy("expires_at", "id").collect()
        used = claims.names(self.spark, f"{self.path}/used")
        return next((r.id for r in live if r.id not in used), None)

    def _guarded(self, current: str, candidate: str, device: str, now_ms: int) -> str | None:
        if self.guard_mode == "off":
            return None
        old, new = self.prefixes(current), self.prefixes(candidate)
        changed = self._stage(diffs.changed_prefixes(old, new))
        total = self._table("roots").where(F.col("root_hash") == current).first().total_files
        limits = {k: v for k, v in self.guard_limits.items() if k != "skew_ms"}
        skew = {k: v for k, v in self.guard_limits.items() if k == "skew_ms"}
        sides = [self._entries_of(p.join(changed, "prefix", "left_semi")).select(*ENTRY_COLS) for p in (old, new)]
        found = guard.guard_trigger(guard.guard_scan(*sides, **skew).withColumn("current_total", F.lit(total).cast("long")), **limits).first()
        if found.reason and self.guard_mode == "enforce":
            approval = self._approved(device, now_ms)
            if approval and claims.claim(self.spark, f"{self.path}/used", approval, device):
                return None
            raise GuardRejected(found)
        return found.reason

    # --- operations ---------------------------------------------------------------------------------------------------

    def push(self, entries: DataFrame, parent: str | None, device: str, now_ms: int, compat: str = "lossless") -> PushResult:
        """The first push is taken; one from the current version moves it forward; another is merged over its parent.

        A merge decides folders by their stored hashes; only those that both sides changed are read.
        """
        current = self.current()
        if current is not None and parent != current:
            self.prefixes(parent)  # unknown parents are an error: a full scan is needed
        incoming = self._store(entries, parent, device, now_ms)
        if current is None:
            self._move(incoming, None)
            return PushResult(True, False, incoming)
        if parent == current:
            reason = self._guarded(current, incoming, device, now_ms)
            self._move(incoming, current)
            return PushResult(True, False, incoming, guard_reason=reason)
        sides = [self.prefixes(r) for r in (parent, current, incoming)]
        actions = self._stage(merge.hash_actions(*sides))
        both = actions.where("act = 'recurse'")
        result = merge.merge_trees(*(self._entries_of(p.join(both, "prefix", "left_semi")) for p in sides), self.blobs(), compat, actions)
        if result.merged_blobs is not None:
            self.put_blobs(self._stage(result.merged_blobs))
        conflicts, counts = self._stage(result.conflicts), result.metrics.first()
        kept = None
        for side, own in zip(merge.SIDES, sides, strict=True):
            rows = own.join(actions.where(F.col("act") == side), "prefix", "left_semi")
            kept = rows if kept is None else kept.unionByName(rows)
        merged = self._store(result.entries, current, "server", now_ms, kept)
        reason = self._guarded(current, merged, device, now_ms)
        self._move(merged, current)
        return PushResult(True, True, merged, counts.auto_resolved, counts.text_merged, conflicts, reason)

    def _changed(self, old: str | None, new: str | None) -> list[DataFrame]:
        """The entries of both versions in the folders whose hashes differ."""
        a, b = self.prefixes(old), self.prefixes(new)
        changed = diffs.changed_prefixes(a, b)
        return [self._entries_of(p.join(changed, "prefix", "left_semi")).select(*ENTRY_COLS) for p in (a, b)]

    def diff(self, from_root: str | None, to_root: str | None = None) -> DataFrame:
        """What a device at ``from_root`` (null or zeros: nothing) must do to be at a version; reads differing folders."""
        return diffs.compute_deltas(*self._changed(from_root, to_root or self.current()))

    def diff_with_hashes(self, from_root: str | None, to_root: str | None = None) -> DataFrame:
        return diffs.diff_with_hashes(*self._changed(from_root, to_root or self.current()))

    def history(self, limit: int | None = HISTORY_LIMIT) -> DataFrame:
        return versions.history(self.roots(), self.current(), limit)

    def versions(self) -> DataFrame:
        """All versions, newest first."""
        return self.history(None)

    def version_stats(self, limit: int = STATS_LIMIT) -> DataFrame:
        """Files and bytes that versions changed; reads the folders whose hashes differ from the parent's."""
        return versions.stored_version_stats(self.roots(), self._table("prefixes"), self._table("entries"), limit)

    def lineage(self, root: str | None = None) -> DataFrame:
        return versions.lineage(self.roots(), root or self.current())

    def rollback(self, root: str) -> None:
        """Makes a version of the history current, without the guard."""
        if not self._known(root):
            raise KeyError(f"unknown version {root}")
        self._move(root, self.current())

    def purge(self, patterns: Sequence[str], now_ms: int, device: str = "server") -> tuple[str, int, int]:
        """(root, removed, kept) after the paths that match are left out; no new version if none does.

        Folders without a match stay as they are.
        """
        current = self.current()
        own = self.prefixes(current)
        rows = self._entries_of(own)
        hit = path_matches("path", patterns, "server")
        counts = rows.agg(F.count_if(hit).alias("removed"), F.count_if(~hit).alias("kept")).first()
        if not counts.removed:
            return current, 0, counts.kept
        touched = self._stage(rows.where(hit).select("prefix").distinct())
        rest = self._entries_of(own.join(touched, "prefix", "left_semi")).where(~hit)
        root = self._store(rest, current, device, now_ms, own.join(touched, "prefix", "left_anti"))
        self._move(root, current)
        return root, counts.removed, counts.kept

    def export(self, root: str | None = None) -> DataFrame:
        """path, data, mtime_ms, size_bytes, by path; a content that is missing is an error."""
        rows = self.entries(root or self.current())
        met = rows.join(self.content(rows.select("hash")), "hash", "left")
        gone = F.raise_error(F.concat(F.lit("the content is missing of "), F.col("path")))
        return met.select("path", F.coalesce("data", gone.cast("binary")).alias("data"), "mtime_ms", "size_bytes").orderBy("path")

    def preserve(self, conflicts: DataFrame, device: str, when_ms: int) -> DataFrame:
        """path, hash, data of the copies that keep conflicts' losing sides."""
        from palimpsest.functions.paths import conflict_copy_path

        name = conflict_copy_path("path", F.lit(device), F.timestamp_millis(F.lit(when_ms)))
        lost = conflicts.select(name.alias("path"), F.col("side_b_hash").alias("hash"))
        return lost.join(self.content(lost), "hash").where("data IS NOT NULL").select("path", "hash", "data")
