import hashlib
import tarfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest.operators import diff, guard, tree
from palimpsest.sources import tables
from palimpsest.sources.files import register_sources
from palimpsest.vault import GuardRejected, Vault

SCHEMA = "path string, hash string, mtime_ms long, size_bytes long"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def files(spark, contents, mtime=0):
    return spark.createDataFrame([(p, sha(t), mtime, len(t)) for p, t in contents.items()], SCHEMA)


def many(spark, n, prefix="notes/"):
    return spark.range(n).select(F.format_string(f"{prefix}%06d.md", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(0).cast("long").alias("mtime_ms"), F.col("id").alias("size_bytes"))


def test_1005_entries_make_two_leaves_and_come_back(spark):
    entries = many(spark, 1005)
    built = tree.build_tree(entries)
    assert rows(built.leaves, "leaf_no", "n") == [(0, 1000), (1, 5)]
    assert rows(tree.flatten(built.leaves)) == rows(entries)
    assert built.root.first().total_files == 1005


@pytest.mark.parametrize("cells", [1, 7, 64])
def test_leaf_numbers_do_not_depend_on_the_cells(spark, cells):
    got = tree.leaf_numbers(many(spark, 12_500).unionByName(many(spark, 30, "")), 1000, cells)
    want = {(f"notes/{i:06d}.md", i // 1000) for i in range(12_500)} | {(f"{i:06d}.md", 0) for i in range(30)}
    assert set(rows(got, "path", "leaf_no")) == want


def test_the_root_has_no_metadata_and_leaves_have_times(spark):
    a, b = (tree.build_tree(files(spark, {"a/x": "1", "y": "2"}, m)) for m in (0, 1))
    assert a.root.first().root_hash != b.root.first().root_hash
    assert a.root.first().root_hash == tree.build_tree(files(spark, {"y": "2", "a/x": "1"})).root.first().root_hash


def test_empty_tree(spark):
    built = tree.build_tree(files(spark, {"a": "1"}).limit(0))
    assert (built.root.first().total_files, built.leaves.count()) == (0, 0)


T0, DAY = 1_800_000_000_000, 86_400_000


@pytest.mark.parametrize(
    "current, candidate, want",
    [
        ([("a", "1", T0), ("b", "2", T0), ("c", "3", T0)], [("a", "0", T0 - 2 * DAY), ("b", "0", T0 - 2 * DAY)], (1, 2, 2, 0, 3)),
        ([("a", "1", T0), ("b", "2", T0)], [("a", "9", T0 + 3_600_000), ("b", "2", T0), ("d", "4", T0)], (0, 1, 0, 1, 2)),
        ([("a", "1", T0), ("b", "2", T0)], [("a", "8", T0 - 7_200_000), ("b", "9", T0 - 7_200_000)], (0, 2, 0, 0, 2)),
        ([("keep/x", "1", T0), ("work/y", "2", T0)], [("keep/x", "1", T0), ("work/y", "0", T0 - 2 * DAY)], (0, 1, 1, 0, 2)),
    ],
)
def test_guard_scan(spark, current, candidate, want):
    frame = lambda rows_: spark.createDataFrame([(p, h, m, 1) for p, h, m in rows_], SCHEMA)
    scan = guard.guard_scan(frame(current), frame(candidate))
    assert tuple(scan.first()) == want
    reason = guard.guard_trigger(scan, regressions=1).first().reason
    assert reason == ("mtime_regression" if want[2] > 1 else None)


def test_guard_limits_are_exceeded_not_reached(spark):
    scan = spark.createDataFrame([(250, 0, 25, 0, 1000), (251, 0, 25, 0, 1000), (0, 0, 26, 0, 1000)], "deletions long, content_changes long, mtime_regressions long, additions long, current_total long")
    assert [r.reason for r in guard.guard_trigger(scan).orderBy("mtime_regressions", "deletions").collect()] == [None, "blast_radius", "mtime_regression"]


# --- vault ------------------------------------------------------------------------------------------------------------


def put(vault, spark, contents, parent, device="d", now=1):
    data = spark.createDataFrame([(sha(t), bytearray(t.encode())) for t in set(contents.values())], "hash string, data binary")
    vault.put_blobs(data)
    return vault.push(files(spark, contents), parent, device, now)


def state(vault, root=None):
    return {r.path: bytes(r.data).decode() for r in vault.export(root).collect()}


def test_push_merge_history_rollback_and_export(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"))
    assert not vault.exists() and vault.current() is None
    v1 = put(vault, spark, {"a.md": "base-a\n", "n/b.md": "base-b\n"}, None).root_hash
    v2 = put(vault, spark, {"a.md": "A edited\n", "n/b.md": "base-b\n"}, v1, now=2).root_hash
    merged = put(vault, spark, {"a.md": "base-a\n", "n/b.md": "B edited\n"}, v1, now=3)
    assert merged.merged and merged.auto_resolved >= 2 and merged.conflicts.count() == 0
    assert state(vault) == {"a.md": "A edited\n", "n/b.md": "B edited\n"}
    assert state(vault, v1) == {"a.md": "base-a\n", "n/b.md": "base-b\n"}
    assert rows(vault.diff(v2), "action", "path") == [("modified", "n/b.md")]
    assert vault.diff(vault.current()).count() == 0
    assert rows(vault.diff(None, v1), "action", "path") == [("added", "a.md"), ("added", "n/b.md")]
    assert [r.root_hash for r in vault.lineage().orderBy("depth").collect()] == [merged.root_hash, v2, v1]
    assert vault.history().where("current").count() == 1
    assert dict(rows(vault.version_stats(), "root_hash", "files"))[v2] == 1
    vault.rollback(v1)
    assert vault.current() == v1
    with pytest.raises(KeyError):
        vault.rollback("0" * 63 + "1")
    with pytest.raises(KeyError):
        vault.push(files(spark, {"x": "1"}), "f" * 64, "d", 4)


def test_conflicts_keep_both_contents(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"))
    v1 = put(vault, spark, {"doc.md": "v1\n"}, None).root_hash
    put(vault, spark, {"doc.md": "A\n"}, v1, now=2)
    got = put(vault, spark, {"doc.md": "B\n"}, v1, now=3)
    assert rows(got.conflicts) == [("doc.md", sha("v1\n"), sha("A\n"), sha("B\n"))]
    assert state(vault) == {"doc.md": "A\n"}
    kept = vault.preserve(got.conflicts, "Mac", 1_783_992_720_000).first()
    assert (kept.path, bytes(kept.data)) == ("doc (conflict Mac 2026-07-14 0132).md", b"B\n")


def test_a_stale_device_loses_no_file(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"), guard_mode="enforce", guard_limits={"floor": 2, "regressions": 2})
    all_ = {f"f{i}.md": f"{i}\n" for i in range(1, 6)}
    v1 = put(vault, spark, all_, None).root_hash
    with pytest.raises(GuardRejected):
        put(vault, spark, {"f1.md": "1\n"}, v1, device="old", now=2)
    assert state(vault) == all_
    vault.approve_bulk_change("old")
    put(vault, spark, {"f1.md": "1\n"}, v1, device="old", now=3)
    assert state(vault) == {"f1.md": "1\n"}


def test_purge(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"))
    put(vault, spark, {"a.md": "1", "target/x": "2", "b/target/y": "3"}, None)
    root, removed, kept = vault.purge(["target/"], 5)
    assert (removed, kept, set(state(vault))) == (2, 1, {"a.md"})
    assert vault.purge(["target/"], 6) == (root, 0, 1)


def test_diff_prunes_folders(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"))
    v1 = put(vault, spark, {"a/x": "1", "b/y": "2"}, None).root_hash
    put(vault, spark, {"a/x": "1", "b/y": "3"}, v1, now=2)
    changed = diff.changed_prefixes(vault.prefixes(v1), vault.prefixes(vault.current()))
    assert rows(changed) == [("b/", "modified")]


def files_read(frame):
    """How many files the scan of a frame opens."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.collectAsList()
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def test_a_diff_of_one_folder_reads_its_files_only(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "v"))
    wide = {f"d{i:02d}/x": str(i) for i in range(40)}
    v1 = put(vault, spark, wide, None).root_hash
    files_before = {f for f in vault._table("entries").inputFiles()}
    v2 = put(vault, spark, wide | {"d07/x": "new"}, v1, now=2).root_hash
    written = {f for f in vault._table("entries").inputFiles()} - files_before
    assert len(written) == 1  # a push writes the folders that it changes
    old, new = vault._changed(v1, v2)
    assert [files_read(x) for x in (old, new)] == [1, 1] and files_read(vault._table("entries")) > 30
    assert rows(vault.diff(v1, v2), "action", "path") == [("modified", "d07/x")]
    assert rows(vault.diff_with_hashes(v1, v2)) == [("M", "d07/x", sha("7"), sha("new"))]


def test_many_changed_folders_are_joined(spark, tmp_path, monkeypatch):
    from palimpsest import vault as module

    monkeypatch.setattr(module, "FEW", 3)
    vault = Vault(spark, str(tmp_path / "v"))
    v1 = put(vault, spark, {f"d{i}/x": str(i) for i in range(9)}, None).root_hash
    put(vault, spark, {f"d{i}/x": str(i % 2) for i in range(9)}, v1, now=2)
    assert vault.diff(v1).count() == 7 and state(vault) == {f"d{i}/x": str(i % 2) for i in range(9)}


def test_only_one_writer_moves_the_pointer(spark, tmp_path):
    from palimpsest.sources import claims

    vault, other = Vault(spark, str(tmp_path / "v")), Vault(spark, str(tmp_path / "v"))
    v1 = put(vault, spark, {"a": "1"}, None).root_hash
    assert claims.latest(spark, f"{vault.path}/current") == (1, v1)
    assert claims.claim(spark, f"{vault.path}/current", 2, "x" * 64) and not claims.claim(spark, f"{vault.path}/current", 2, v1)
    with pytest.raises(RuntimeError, match="moved"):
        other._move(v1, v1)
    assert other.current() == "x" * 64


def test_approvals_expire_and_outlive_the_object(spark, tmp_path):
    how = {"guard_mode": "enforce", "guard_limits": {"floor": 0, "regressions": 2}}
    vault = Vault(spark, str(tmp_path / "v"), **how)
    v1 = put(vault, spark, {f"f{i}": str(i) for i in range(5)}, None).root_hash
    vault.approve_bulk_change("d", 1_000, 50)
    with pytest.raises(GuardRejected):
        put(vault, spark, {"f1": "1"}, v1, now=1_050)
    vault.approve_bulk_change("d", 2_000, 50)
    v2 = put(Vault(spark, str(tmp_path / "v"), **how), spark, {"f1": "1"}, v1, now=2_049).root_hash
    with pytest.raises(GuardRejected):
        put(vault, spark, {"f1": "2"}, v2, now=2_049)


def test_contents_from_chunks_and_what_is_missing(spark, tmp_path):
    from palimpsest.functions import chunking

    vault, big = Vault(spark, str(tmp_path / "v")), "0123456789abcdef" * 4000
    files_ = spark.createDataFrame([(bytearray(big.encode()),)], "data binary")
    chunks = chunking.chunk_files(files_, 256, 1024, 4096).cache()
    vault.put_chunks(chunking.manifests(chunks), chunks)
    vault.put_blobs(spark.createDataFrame([(sha("x"), bytearray(b"x"))], "hash string, data binary"))
    asked = spark.createDataFrame([(1, sha(big)), (2, sha("x").upper()), (3, sha("y")), (4, "no hash")], "ord int, hash string")
    got = {r.hash: r.data and bytes(r.data).decode() for r in vault.content(asked).collect()}
    assert got[sha(big)] == big and got[sha("x")] == "x" and got[sha("y")] is None
    assert rows(vault.missing(asked), "ord") == [(1,), (3,)] and rows(vault.missing(asked, "manifest"), "ord") == [(2,), (3,)]
    with pytest.raises(ValueError):
        vault.put_blobs(spark.createDataFrame([(sha("x"), bytearray(b"y"))], "hash string, data binary"))


# --- sources ----------------------------------------------------------------------------------------------------------


def test_objects_logs_and_archives(spark, tmp_path):
    register_sources(spark)
    objects = spark.createDataFrame([(sha(t), bytearray(t.encode())) for t in ("x", "y")], "hash string, data binary")
    objects.write.format("objects").mode("append").option("path", str(tmp_path / "o")).save()
    assert rows(tables.read_objects(spark, str(tmp_path / "o")), "hash") == rows(objects, "hash")
    assert tables.dir_stats(spark, str(tmp_path / "o")).first() == (2, 2)
    with pytest.raises(Exception, match="do not have the hash"):
        objects.withColumn("hash", F.lit("0" * 64)).write.format("objects").mode("append").option("path", str(tmp_path / "p")).save()

    from palimpsest.operators import logs

    updates = spark.createDataFrame([("v", "n", 1, bytearray(b"one")), ("v", "n", 0, bytearray(b"zero")), ("v", "m", 0, bytearray(b""))], "vault string, note_key string, seq long, update binary")
    logs.encode_log(updates).write.format("oplog").mode("append").option("path", str(tmp_path / "l")).save()
    with (tmp_path / "l/v/n.log").open("ab") as f:
        f.write(b"\x09\x00\x00\x00cut")
    got = spark.read.format("oplog").option("path", str(tmp_path / "l")).load()
    assert [(r.seq, bytes(r.update)) for r in got.orderBy("seq").collect()] == [(0, b"zero"), (1, b"one")]

    export = spark.createDataFrame([("a/b.md", bytearray(b"text"), 5000)], "path string, data binary, mtime_ms long")
    export.write.format("tar").mode("append").option("path", str(tmp_path / "t")).save()
    (archive,) = (tmp_path / "t").glob("*.tar")
    with tarfile.open(archive) as tar:
        (m,) = tar.getmembers()
        assert (m.name, m.mtime, m.mode, tar.extractfile(m).read()) == ("a/b.md", 5, 0o644, b"text")


def test_compaction_reports_refused_notes(spark):
    from palimpsest.model import MAX_FRAME
    from palimpsest.operators import logs

    half = MAX_FRAME // 2
    updates = spark.createDataFrame([("n", 1, "b", half), ("n", 0, "a", half), ("m", 0, "c", half), ("m", 1, "d", half + 1), (None, 0, "e", MAX_FRAME + 1), ("o", 0, "", 1)], "note_key string, seq long, c string, times int")
    updates = updates.selectExpr("'v' AS vault", "note_key", "seq", "CAST(repeat(c, times) AS BINARY) AS update")
    got = {r.note_key: (r.bytes, r.refused, r.log) for r in logs.compact_notes(updates).collect()}
    with pytest.raises(Exception, match="too large for a frame"):
        logs.encode_log(updates).collect()
    assert got["m"] == (MAX_FRAME + 1, True, None) and got[None] == (MAX_FRAME + 1, True, None)
    assert got["n"][:2] == (MAX_FRAME, False) and logs.split_frames(bytes(got["n"][2])) == [b"a" * half + b"b" * half]
    assert got["o"][:2] == (0, False) and logs.split_frames(bytes(got["o"][2])) == [b""] and len(got) == 4


def test_compaction_keeps_a_crowded_source(spark, tmp_path):
    """A source above 4 MiB in all: each of its documents is a note of its own and keeps its row."""
    from palimpsest.plans.queries import QUERIES

    docs = spark.range(1, 7).selectExpr("id AS doc_id", "repeat(chr(96 + id), IF(id = 6, 4194305, 1000000)) AS text", "'en' AS lang", "'src1' AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["oplog_note_compaction"](spark, str(tmp_path)).collect()
    assert sorted((r.bytes, r.refused, r.update_hash) for r in got if not r.refused) == sorted((1_000_000, False, sha(c * 1_000_000)) for c in "abcde")
    assert [(r.bytes, r.update_hash) for r in got if r.refused] == [(4_194_305, None)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "j.ndjson").write_text('{"action": "created", "path": "a", "ts": 1, "synced": false}\nnot json\n')
    assert rows(tables.read_journal(spark, str(tmp_path / "j.ndjson")), "action", "path", "synced") == [("created", "a", False)]
    (tmp_path / "b.json").write_text('{"lastSyncTimestamp": 7, "entries": {"a": {"hash": "h", "mtime": 1, "size": 2}}}')
    assert rows(tables.read_sync_base(spark, str(tmp_path / "b.json"))) == [("a", "h", 1, 2, None, 7)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/1.json").write_text('{"name": "n", "device_id": "x", "last_seen": 5}')
    (tmp_path / "d/2.json").write_text("{broken")
    assert rows(tables.read_devices(spark, str(tmp_path / "d")), "device_id") == [("x",)]
