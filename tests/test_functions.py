import hashlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest.functions import chunking, formats, patterns, paths, rules
from palimpsest.functions.register import register_functions


def hits(spark, names, pats, dialect):
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    return [r[0] for r in frame.where(patterns.path_matches("path", pats, dialect)).collect()]


@pytest.mark.parametrize(
    "pats, dialect, yes, no",
    [
        (["target/"], "client", ["target/x", "a/target/b/c"], ["notes/target", "projects/target.md"]),
        (["target/"], "server", ["target/x", "a/target/b/c"], ["notes/target", "projects/target.md"]),
        (["node_modules"], "client", ["node_modules", "a/node_modules/b"], ["a/node_modules2"]),
        (["*.tmp"], "client", ["a.tmp", "d/a.tmp", "x.tmp/y"], ["a.tmp2", "tmp"]),
        (["a/b"], "client", ["a/b", "a/b/c", "/a/b", "./a/b"], ["x/a/b", "a/bc"]),
        (["docs/**/tmp"], "client", ["docs/x/y/tmp", "docs/x/tmp/z"], ["docs/tmpx"]),
        (["a/*"], "server", ["a/*"], ["a/b"]),
        (["/x"], "client", ["x", "d/x"], ["xx"]),
        (["f?o"], "client", ["foo", "d/fao"], ["fo", "f/o"]),
        (["f?o"], "server", ["f?o"], ["foo"]),
        (["# c", "", "  "], "client", [], ["# c", "a"]),
        (["ab*ba"], "server", ["abba", "abxba"], ["ab"]),
        (["a.b"], "client", ["a.b"], ["axb"]),
    ],
)
def test_patterns(spark, pats, dialect, yes, no):
    assert sorted(hits(spark, yes + no, pats, dialect)) == sorted(yes)


def test_null_and_empty_paths_match_nothing(spark):
    frame = spark.createDataFrame([(None,), ("",)], "path string")
    assert frame.where(patterns.path_matches("path", ["*"])).count() == 0


@pytest.mark.parametrize("n, want", [(1023, "1023 B"), (1024, "1 KB"), (3 << 19, "1.5 MB"), (2 << 30, "2.00 GB")])
def test_bytes(spark, n, want):
    assert spark.range(1).select(formats.format_bytes(F.lit(n))).first()[0] == want


# the values of these doubles lie beside the middle between two hundredths, or on it, or round up to a whole
@pytest.mark.parametrize("n, want", [(44320966934622372, "41277117.03 GB"), (45128061136446425, "42028782.09 GB"), (1 << 30, "1.00 GB"), ((1 << 30) + (1 << 27), "1.12 GB"), ((1 << 30) + 3 * (1 << 27), "1.38 GB"), ((2 << 30) - 1, "2.00 GB"), (2**63 - 1, "8589934592.00 GB"), (None, None)])
def test_gigabytes_round_by_value(spark, n, want):
    assert spark.range(1).select(formats.format_bytes(F.lit(n).cast("long"))).first()[0] == want


def test_null_values_stay_null(spark):
    none = F.lit(None).cast("long")
    assert tuple(spark.range(1).select(formats.format_bytes(none), formats.format_ago(none, 1), formats.format_duration(none)).first()) == (None, None, None)


@pytest.mark.parametrize("s, want", [(5, "5s"), (75, "1m 15s"), (3 * 3600 + 14 * 60, "3h 14m"), (2 * 86400 + 5 * 3600, "2d 5h")])
def test_durations(spark, s, want):
    assert spark.range(1).select(formats.format_duration(F.lit(s))).first()[0] == want


@pytest.mark.parametrize("path, want", [("notes/doc.md", "notes/doc (conflict Mac 2026-07-14 0132).md"), (".hidden", ".hidden (conflict Mac 2026-07-14 0132)"), ("d.x/none", "d.x/none (conflict Mac 2026-07-14 0132)")])
def test_conflict_copies(spark, path, want):
    made = spark.range(1).select(paths.conflict_copy_path(F.lit(path), F.lit("Mac"), F.lit("2026-07-14 01:32:00").cast("timestamp")).alias("c"))
    assert made.first()[0] == want
    assert made.select(paths.conflict_original("c")).first()[0] == path


def test_strategies(spark):
    names = {"a/x.sqlite": "local-only", "x.PNG": "conflict-copy", "x.png": "immutable", "d/.DS_Store": "local-only", "x.md": "conflict-copy"}
    frame = spark.createDataFrame(list(names.items()), "path string, want string")
    assert frame.where(rules.sync_strategy("path") != F.col("want")).count() == 0


# --- chunking ---------------------------------------------------------------------------------------------------------

BIG = np.arange(2_000_000, dtype="<u4").tobytes()


def test_chunks_are_contiguous_bounded_and_repeatable():
    ends = chunking.cut_points(BIG)
    sizes = np.diff([0, *ends])
    assert len(ends) > 1 and ends[-1] == len(BIG) and ends == chunking.cut_points(BIG)
    assert (sizes[:-1] >= chunking.CHUNK_MIN).all() and (sizes <= chunking.CHUNK_MAX).all()
    assert chunking.cut_points(b"") == [] and chunking.cut_points(b"x") == [1]


def test_a_small_edit_changes_few_chunks():
    data = bytearray(np.random.default_rng(3).integers(0, 256, 8_000_000, np.uint8).tobytes())

    def hashes(d):
        ends = chunking.cut_points(bytes(d))
        return {hashlib.sha256(d[s:e]).hexdigest() for s, e in zip([0, *ends], ends)}

    before = hashes(data)
    data[4_000_000:4_000_100] = b"x" * 100
    assert len(hashes(data) - before) <= 3


@pytest.fixture
def chunked(spark):
    files = spark.createDataFrame([(bytearray(BIG[:300_000]),), (bytearray(b""),), (bytearray(b"small"),)], "data binary")
    chunks = chunking.chunk_files(files, 256, 1024, 4096)
    return chunking.manifests(chunks).cache(), chunks.cache()


def test_files_come_back(chunked):
    manifests, chunks = chunked
    back = chunking.reassemble(manifests, chunks)
    assert back.where(F.sha2("data", 256) == F.col("file_hash")).count() == 2


def test_damage_is_found(spark, chunked):
    manifests, chunks = chunked
    big = manifests.where("total_size = 300000")
    less = chunks.where("pos <> 3")
    wrong = chunks.withColumn("data", F.when(F.col("pos") == 3, F.lit(b"?")).otherwise(F.col("data")))
    other = big.withColumn("file_hash", F.lit("0" * 64))
    for m, c in ((big, less), (big, wrong), (other, chunks)):
        assert chunking.reassemble(m, c).first().data is None
    with pytest.raises(Exception, match="a chunk is missing"):
        chunking.reassemble(big, less, verify=False).collect()


def test_sql_functions(spark):
    register_functions(spark)
    got = spark.sql("SELECT content_hash(CAST('a' AS BINARY)) h, top_prefix('a/b') p, is_text_path('x.MD') t, sync_strategy('a/x.png') s, classify_sync('1', '2', '1') c, text_merge3('a\nb\n', 'x\nb\n', 'a\ny\n').content m").first()
    assert tuple(got) == (hashlib.sha256(b"a").hexdigest(), "a/", True, "immutable", "local_only", "x\ny\n")
    assert spark.sql("SELECT sum(size) FROM fastcdc(CAST(repeat('abcdefgh', 1000) AS BINARY), 256, 1024, 4096)").first()[0] == 8000
    assert rows(spark.sql("SELECT seq, CAST(update AS STRING) FROM split_frames(X'010000006102000000')")) == [(0, "a")]
    assert spark.sql("SELECT unified_diff(CAST('a' AS BINARY), CAST('a' AS BINARY)).kind").first()[0] == "same"


def test_shared_folders_are_discarded(spark):
    from pathlib import Path

    from palimpsest import session

    since = session.made(spark)
    kept, gone = session.shared_dir(spark), session.shared_dir(spark)
    for path in (kept, gone):
        spark.range(3).write.parquet(f"{path}/t")
    assert session.made(spark) == since + 2
    session.discard(spark, since, keep=(kept,))
    assert session.made(spark) == since + 1
    assert Path(kept.removeprefix("file://")).exists() and not Path(gone.removeprefix("file://")).exists()
    session.discard(spark, since)


def test_hashes_of_groups_run_over_their_pieces(spark):
    import hashlib

    from palimpsest.functions.hashing import hash_groups, u64_bytes

    pieces = [("a", 2, b"two"), ("a", 1, b"one"), (None, 1, b"n"), (None, 2, None), ("b", 1, None)]
    frame = spark.createDataFrame([(k, o, d and bytearray(d)) for k, o, d in pieces], "k string, o int, data binary")
    got = {r.k: (r.parts, r.bytes, r.hash) for r in hash_groups(frame, "k", "o").collect()}
    sha = lambda d: hashlib.sha256(d).hexdigest()
    assert got == {"a": (2, 6, sha(b"onetwo")), None: (2, 1, sha(b"n")), "b": (1, 0, sha(b""))}
    assert hash_groups(frame.limit(0), "k", "o").count() == 0
    assert bytes(spark.range(1).select(u64_bytes(F.lit(0x0102030405060708))).first()[0]) == bytes(range(8, 0, -1))


def test_lossy_text_clock_and_capped_strings(spark):
    from palimpsest.functions.formats import capped_strings, clock, lossy_text

    frame = spark.createDataFrame([(bytearray(b"a\xffb"), 3_723_004, '{"v": [1, "x", null, "y", "z"]}'), (bytearray("é".encode()), 86_400_000, "no json")], "d binary, ms long, j string")
    got = frame.select(lossy_text("d"), clock("ms"), capped_strings("j", "v", 2)).collect()
    assert [tuple(r) for r in got] == [("a�b", "01:02:03.004", ["x", "y"]), ("é", "00:00:00.000", [])]
