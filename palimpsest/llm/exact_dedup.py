"""Exact deduplication by a log-structured merge index.

Write path: each task fills a memtable, a map from digest to the distinct normalised texts seen under it. A hit is
compared byte by byte with the text that the memtable holds, so a digest collision opens another variant instead of
merging two texts. A full memtable is flushed as a run: rows sorted by digest, each with the smallest identifier and the
number of copies in its run, and a Bloom filter over the run's digests.

Compaction: the entries of the runs (one for each distinct text of a run, however many copies it has) and of the level
below are merged by digest; the smallest identifier and the number of copies survive. Digests that several runs share
are hits between runs. The representatives of a hit, one text a run, are compared by an aggregation (smallest text =
largest text), which no group of copies can skew; digests that fail it are merged again by their whole text.

Read path: a filter over the digests that runs share tells most documents that their own run knows all about their text,
so only the others look their class up, by (run, digest), and copies of one text never meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

RUN_SCHEMA = "run string, digest binary, variant int, sha binary, id long, doc_id long, first boolean, low long, copies long, filter binary"
_ARROW = pa.schema([("run", pa.string()), ("digest", pa.binary()), ("variant", pa.int32()), ("sha", pa.binary()), ("id", pa.int64()), ("doc_id", pa.int64()), ("first", pa.bool_()), ("low", pa.int64()), ("copies", pa.int64()), ("filter", pa.binary())])
KEY = ["run", "digest", "variant"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, " ")


def squeezed(text: bytes) -> bytes:
    """The same over UTF-8, whose white space of one byte is that of ``common.SPACE``."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(d, digest_size=8).digest() for d in digests), np.uint64)


class Memtable:
    """Rows by digest and text, in at most ``most_rows`` rows and ``most_bytes`` bytes of distinct texts and of what the
    rows carry."""

    def __init__(self, digest_bytes: int, most_rows: int, most_bytes: int) -> None:
        self.digest_bytes, self.most_rows, self.most_bytes = digest_bytes, most_rows, most_bytes
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, list[list]] = {}
        self.rows = self.bytes = 0
        self.carried: list[pa.Array] = []

    def add(self, id_: int, doc_id: int | None, text: bytes, carried: pa.Array | None = None) -> bool:
        """True when the table is full. ``carried`` is the row's own columns, kept for the smallest identifier of a text."""
        sha = hashlib.sha256(text).digest()
        variants = self.table.setdefault(sha[: self.digest_bytes], [])
        for v in variants:
            if v[0] == text:  # the byte verification of a hit
                v[2].append((id_, doc_id))
                if carried is not None and id_ < v[3]:
                    v[3], self.carried[v[4]] = id_, carried
                break
        else:
            variants.append([text, sha, [(id_, doc_id)], id_, len(self.carried)])
            self.bytes += len(text)
            if carried is not None:
                self.carried.append(carried)
                self.bytes += carried.nbytes
        self.rows += 1
        return self.rows >= self.most_rows or self.bytes >= self.most_bytes

    def flush(self, run: str) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        keys = sorted(self.table)
        bits = 1 << max(10, (16 * len(keys) - 1).bit_length())
        cols: list[list] = [[] for _ in _ARROW]
        filter_, places = common.bloom(_words(keys), bits).tobytes(), []
        for key in keys:
            for n, (_, sha, members, _, place) in enumerate(self.table[key]):
                best = min(range(len(members)), key=lambda i: members[i][0])
                low = members[best][1]
                for i, (id_, doc_id) in enumerate(members):
                    for c, x in zip(cols, (run, key, n, sha, id_, doc_id, i == best, low, len(members), filter_), strict=True):
                        c.append(x)
                    places.append(place if i == best else None)
                    filter_ = None
        arrays, fields = [pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], list(_ARROW)
        if self.carried:
            arrays.append(pa.concat_arrays(self.carried).take(pa.array(places, pa.int64())))
            fields.append(pa.field("row", arrays[-1].type))
        self.clear()
        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


class LsmIndex:
    """An index under one folder of the shared storage: ``runs`` (level 0) and ``merged`` (level 1)."""

    def __init__(self, spark, path: str | None = None, digest_bytes: int = 32, memtable_rows: int = 50_000, memtable_bytes: int = 16 << 20) -> None:
        self.spark, self.path = spark, path or common.shared_dir(spark)
        self.digest_bytes, self.memtable_rows, self.memtable_bytes = digest_bytes, memtable_rows, memtable_bytes

    def ingest(self, documents: DataFrame, whole: bool = False) -> DataFrame:
        """Flushes every document (doc_id, text) into sorted runs; the table has a row for each document.

        With ``whole`` the row of the smallest identifier of each text of a run has all the document's columns, in a
        struct ``row``; the others' is null.
        """
        digest_bytes, rows, size = self.digest_bytes, self.memtable_rows, self.memtable_bytes

        def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, task, n = Memtable(digest_bytes, rows, size), TaskContext.get().partitionId(), 0
            for part in parts:
                ids, doc_ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                for i, (id_, doc_id) in enumerate(zip(ids, doc_ids, strict=True)):
                    text = squeezed(part.column(2)[i].as_py() or b"")
                    if table.add(id_, doc_id, text, part.column(3).slice(i, 1) if whole else None):
                        yield from table.flush(f"{task:07d}-{n:05d}")
                        n += 1
            yield from table.flush(f"{task:07d}-{n:05d}")

        own = [common.order_id("doc_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
        schema = T.StructType.fromDDL(RUN_SCHEMA)
        if whole:
            own.append(F.struct(*[common.own_column(c) for c in documents.columns]).alias("row"))
            schema = schema.add("row", documents.select(own[-1]).schema[0].dataType)
        return common.materialise(documents.select(*own).mapInArrow(fill, schema), f"{self.path}/runs")

    @staticmethod
    def entries(runs: DataFrame) -> DataFrame:
        return runs.where("first").select(*KEY, "sha", "id", "doc_id", "copies")

    @staticmethod
    def merge(entries: DataFrame, *by: str) -> DataFrame:
        """One row for each key: the smallest (id, run, variant), the copies and the entries."""
        return entries.groupBy(*by).agg(F.min(F.struct("id", "run", "variant", "doc_id")).alias("keep"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("entries"))

    def compact(self, runs: DataFrame, below: DataFrame | None = None, name: str = "merged") -> DataFrame:
        """Level 1 of the runs and, if there is one, of the level below, whose rows count as entries of their own."""
        rows = self.entries(runs).select("digest", "id", "run", "variant", "doc_id", "copies")
        if below is not None:
            rows = rows.unionByName(below.select("digest", "keep.id", "keep.run", "keep.variant", "keep.doc_id", "copies"))
        return common.materialise(self.merge(rows, "digest"), f"{self.path}/{name}")

    def shared_classes(self, documents: DataFrame, runs: DataFrame, merged: DataFrame) -> DataFrame | None:
        """For each (run, digest, variant) whose digest is another run's or variant's, too, its class: ``keep`` (id, run,
        variant, doc_id) and the copies. None if there is no such digest."""
        hits = common.materialise(merged.where("entries > 1").select("digest", "keep", "copies"), f"{self.path}/hits")
        if hits.isEmpty():
            return None
        reps = common.materialise(self.entries(runs).join(hits.select("digest"), "digest", "left_semi"), f"{self.path}/representatives")
        # The representatives' texts are read again, picked by their ids before they are normalised.
        # A text too many does no harm: one that differs from others of its digest is a representative itself.
        passes = common.filter_of(reps.select("id").distinct(), "id")
        texts = documents.select(common.order_id("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where(passes(F.col("id")))
        texts = texts.select("id", normalised(F.col("text")).alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("digest", F.substring("sha", 1, self.digest_bytes))
        wrong = common.materialise(texts.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differ")).where("differ").select("digest"), f"{self.path}/collisions")
        alike = reps.select(*KEY).join(hits, "digest")
        if wrong.isEmpty():
            return alike
        # Different texts under one digest: their classes are by the text itself.
        named = reps.join(wrong, "digest", "left_semi").join(texts.select("id", "sha", "norm").distinct(), ["id", "sha"])
        apart = named.select(*KEY, "norm").join(self.merge(named, "norm").drop("entries"), "norm").drop("norm")
        return alike.join(wrong, "digest", "left_anti").unionByName(apart.select(*alike.columns))

    def resolved(self, documents: DataFrame, runs: DataFrame, merged: DataFrame) -> DataFrame:
        """The runs' rows with keep_id, group_size and kept. Rows whose digest no other run has are told by their own run;
        the others meet their class."""
        classes = self.shared_classes(documents, runs, merged)
        names = [c for c in runs.columns if c not in ("copies", "filter", "low")]
        alone = lambda rows: rows.select(*names, F.col("low").alias("keep_id"), F.col("copies").alias("group_size"), F.col("first").alias("kept"))
        if classes is None:
            return alone(runs)
        classes = common.materialise(classes, f"{self.path}/classes")
        passes = common.filter_of(classes.select("digest").distinct(), "digest")
        marked = runs.withColumn("maybe", passes(F.col("digest")))
        own = alone(marked.where("NOT maybe"))
        met = marked.where("maybe").drop("maybe").join(classes.withColumnRenamed("copies", "all"), KEY, "left")
        kept = F.col("first") & F.coalesce((F.col("run") == F.col("keep.run")) & (F.col("variant") == F.col("keep.variant")), F.lit(True))
        in_class = F.col("keep").isNotNull()
        keep_id = F.when(in_class, F.col("keep.doc_id")).otherwise(F.col("low"))
        return own.unionByName(met.select(*names, keep_id.alias("keep_id"), F.coalesce("all", "copies").alias("group_size"), kept.alias("kept")))

    def probe(self, batch: DataFrame, most_filter_bytes: int = 64 << 20) -> DataFrame:
        """For texts of another batch (doc_id, text): doc_id, digest and the indexed keep_id, or null if none is equal.

        Rows that every run's filter excludes skip the lookup. The filters are handed out only while their sizes sum
        to ``most_filter_bytes`` or less; beyond that every row takes the lookup, with the same result.
        """
        runs, merged = (self.spark.read.parquet(f"{self.path}/{x}") for x in ("runs", "merged"))
        sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
        rows = batch.select("doc_id", sha.alias("sha")).withColumn("digest", F.substring("sha", 1, self.digest_bytes))
        filters = runs.where("filter IS NOT NULL")
        asked = rows
        if (filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= most_filter_bytes:
            shared = self.spark.sparkContext.broadcast([np.frombuffer(bytes(r[0]), np.uint8) for r in filters.select("filter").collect()])

            @F.pandas_udf("boolean")
            def maybe(d):
                import pandas as pd

                words = _words([bytes(x) for x in d])
                hit = np.zeros(len(words), bool)
                for f in shared.value:
                    hit |= common.might_hold(f, words)
                return pd.Series(hit)

            asked = rows.withColumn("maybe", maybe("digest"))
        else:
            asked = rows.withColumn("maybe", F.lit(True))
        found = asked.join(merged.select("digest", F.col("keep.doc_id").alias("keep_id")), (asked.digest == merged.digest) & asked.maybe, "left")
        return found.select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id")


def exact_dedup(documents: DataFrame, digest_bytes: int = 32, **limits) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null text counts as empty, and all empty texts are equal to each other. A null doc_id comes after every other; of
    repeated rows with one doc_id and text exactly one is kept. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    index = LsmIndex(documents.sparkSession, digest_bytes=digest_bytes, **limits)
    runs = index.ingest(documents)
    rows = index.resolved(documents, runs, index.compact(runs))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_documents(documents: DataFrame, **limits) -> DataFrame:
    """The documents that ``exact_dedup`` keeps, one of each group of equal texts, with their own columns.

    The runs hold the whole rows of their first texts. Only keys of those whose text another run has, too, are shuffled,
    and the texts of these for the comparison.
    """
    index = LsmIndex(documents.sparkSession, **limits)
    runs = index.ingest(documents, whole=True)
    firsts = runs.where("first")
    classes = index.shared_classes(documents, runs, index.compact(runs))
    if classes is None:
        return firsts.select("row.*")
    gone = classes.where((F.col("run") != F.col("keep.run")) | (F.col("variant") != F.col("keep.variant"))).select(*KEY)
    gone = common.materialise(gone, f"{index.path}/gone")
    return common.without(firsts.select(*KEY, "row"), gone, f"{index.path}/alike", *KEY).select("row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
