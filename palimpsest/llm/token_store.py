"""Token files of directly addressable codes.

An id is split into chunks of ``WIDTH`` bits. Level 0 holds every id's lowest chunk, level k the next chunk of those ids
that need it. A level's bitmap marks the ids that go on, and its rank directory holds the number of marks before each
block of ``BLOCK`` bits; so any id is found by one rank a level, without decoding its neighbours.

The ids of all documents follow each other by doc_id. The stream is cut into segments of ``SEGMENT`` ids; a row of the
file is a segment: its place, its levels, and the documents that it holds a part of. A long document spans segments. The
files lie in a folder for each part of the stream, and the directory has a row for each part: its first id's place and
its number of ids; so a token's segment is known before anything else is read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

WIDTH, BLOCK, SEGMENT, END = 8, 512, 1 << 18, 0
SCHEMA = "part int, seq int, base long, n long, chunks array<binary>, marks array<binary>, ranks array<binary>, docs array<struct<doc_id: bigint, ord: bigint, at: bigint, n: bigint, first: bigint>>"
_DOC = pa.struct([("doc_id", pa.int64()), ("ord", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.int64())])
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("n", pa.int64()), ("chunks", pa.list_(pa.binary())), ("marks", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("docs", pa.list_(_DOC))])


# --- the code ---------------------------------------------------------------------------------------------------------


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, marks and rank directories, a value a level."""
    chunks, marks, ranks = [], [], []
    left = ids.astype(np.uint32)
    while True:
        chunks.append((left & np.uint32((1 << WIDTH) - 1)).astype(np.uint8).tobytes())
        left = left >> np.uint32(WIDTH)
        on = left > 0
        bits = np.packbits(on, bitorder="little")
        marks.append(bits.tobytes())
        by_block = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32) if len(on) else np.empty(0, np.uint32)
        ranks.append((np.cumsum(by_block, dtype=np.uint32) - by_block).astype("<u4").tobytes())
        if not on.any():
            return chunks, marks, ranks
        left = left[on]


def decode_levels(chunks: list[bytes], marks: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.zeros(0, np.uint32)
    for c, m in zip(reversed(chunks), reversed(marks), strict=True):
        low = np.frombuffer(c, np.uint8).astype(np.uint32)
        on = np.unpackbits(np.frombuffer(m, np.uint8), count=len(low), bitorder="little").view(bool)
        if on.any():
            low[on] |= out << np.uint32(WIDTH)
        out = low
    return out


def access(chunks: list[bytes], marks: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place ``i`` of a segment: one rank a level."""
    out = 0
    for level, (c, m, r) in enumerate(zip(chunks, marks, ranks, strict=True)):
        out |= c[i] << (WIDTH * level)
        if not m[i >> 3] >> (i & 7) & 1:
            return out
        block = i // BLOCK
        inside = int.from_bytes(m[block * BLOCK // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
        i = int.from_bytes(r[4 * block : 4 * block + 4], "little") + inside.bit_count()
    raise ValueError("the last level has a mark")


# --- CRC-32 of parts --------------------------------------------------------------------------------------------------


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo CRC-32's, bits reflected."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_join(a: int, b: int, bytes_of_b: int) -> int:
    """The CRC-32 of two byte strings that follow each other, from theirs and the second's length."""
    power, x, n = 1 << 31, 1 << 30, 8 * bytes_of_b  # x^0; x^1
    while n:
        if n & 1:
            power = _times(power, x)
        x = _times(x, x)
        n >>= 1
    return _times(power, a) ^ b


# --- files ------------------------------------------------------------------------------------------------------------


class TokenStore:
    """A folder of segments."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path, self._directory = spark, path, None

    @classmethod
    def write(cls, documents: DataFrame, path: str | None = None, tokenizer: str | None = None, end: int = END, segment: int = SEGMENT) -> TokenStore:
        """Tokenizes the documents (doc_id, text) and writes their ids, ``end`` after each, by ascending doc_id.

        Rows of one doc_id follow each other by their text's hash; a null doc_id comes last.
        """
        spark = documents.sparkSession
        tokenizer, path = tokenizer or common.tokenizer_path(), path or f"{common.shared_dir(spark)}/tokens"

        def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, task = common.encoder(tokenizer), TaskContext.get().partitionId()
            held, size, docs, base, seq, ordinal = [], 0, [], 0, 0, 0

            def flush() -> pa.RecordBatch:
                ids = np.concatenate(held)
                row = (task, seq, base, len(ids), *encode_levels(ids), docs)
                return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

            for part in parts:
                for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                    first = base + size
                    doc = {"doc_id": doc_id.as_py(), "ord": ordinal, "at": size, "n": 0, "first": first}
                    docs.append(doc)
                    for ids in (*encoder.pieces(text.as_py()), np.array([end], "<u4")):
                        while len(ids):
                            take = ids[: segment - size]
                            ids = ids[len(take) :]
                            held.append(take)
                            size += len(take)
                            doc["n"] += len(take)
                            if size == segment:
                                yield flush()
                                base, seq, size, held = base + size, seq + 1, 0, []
                                doc = {**doc, "at": 0, "n": 0}
                                docs = [doc]
                    ordinal += 1
                    if docs and not docs[-1]["n"]:  # the document ended where the segment did
                        docs = []
            if size:
                yield flush()

        by = [common.order_id("doc_id").alias("id"), F.xxhash64("text").alias("h")]
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        dealt = rows.withColumns({"__id": by[0], "__h": by[1]}).repartitionByRange(common.partitions_for(documents), "__id", "__h").sortWithinPartitions("__id", "__h").select("doc_id", "text")
        dealt.mapInArrow(encode, SCHEMA).write.mode("overwrite").option("compression", "lz4").partitionBy("part").parquet(path)
        return cls(spark, path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def directory(self) -> list[tuple[int, int, int, int]]:
        """(start, part, ids, ids of a whole segment) by the place in the stream, asked for once.

        The driver holds a row for each part, which is a task's share of the corpus.
        """
        if self._directory is None:
            sizes = self._rows().groupBy("part").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
            at, self._directory = 0, []
            for r in sorted(sizes, key=lambda r: r.part):
                self._directory.append((at, r.part, r.n, r.most))
                at += r.n
        return self._directory

    def segments(self) -> DataFrame:
        """The segments with ``start``, the place of their first id in the whole stream."""
        offsets = self.spark.createDataFrame([(part, at) for at, part, _, _ in self.directory()], "part int, before long")
        return self._rows().join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("base"))

    def segment_at(self, place: int) -> tuple[DataFrame, int] | None:
        """The one segment that holds a place of the stream, and the place in it; None beyond the stream.

        All segments of a part but its last are of one size, so part and number are literals that prune the scan.
        """
        own = self.directory()
        k = bisect_right(own, place, key=lambda r: r[0]) - 1
        if k < 0 or place >= own[k][0] + own[k][2]:
            return None
        start, part, _, most = own[k]
        seq, at = divmod(place - start, most)
        return self._rows().where((F.col("part") == part) & (F.col("seq") == seq)), at

    def token(self, place: int) -> int | None:
        """The id at a place of the whole stream; null beyond its end. Reads one segment's levels, a rank a level."""
        found = self.segment_at(place)
        if found is None:
            return None
        row = found[0].select("chunks", "marks", "ranks").first()
        return access([bytes(x) for x in row.chunks], [bytes(x) for x in row.marks], [bytes(x) for x in row.ranks], found[1])

    def documents(self) -> DataFrame:
        """Read back: doc_id, start, n_tokens, ids_crc32 for each document."""

        def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["part", "ord", "doc_id", "start", "seq", "n", "crc"]
            for part in parts:
                out: list[list] = [[] for _ in names]
                for row in part.to_pylist():
                    ids = decode_levels(row["chunks"], row["marks"]).astype("<u4", copy=False)
                    for d in row["docs"]:
                        crc = zlib.crc32(ids[d["at"] : d["at"] + d["n"]].tobytes())
                        for c, x in zip(out, (row["part"], d["ord"], d["doc_id"], row["before"] + d["first"], row["seq"], d["n"], crc), strict=True):
                            c.append(x)
                kinds = [pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        rows = self.segments().select("part", "seq", "before", "chunks", "marks", "docs")
        thin = rows.mapInArrow(decode, "part int, ord long, doc_id long, start long, seq long, n long, crc long")
        own = thin.groupBy("part", "ord", "doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))

        @F.pandas_udf("long")
        def joined(parts):
            import pandas as pd

            out = []
            for own in parts:
                crc = own[0]["crc"]
                for x in own[1:]:
                    crc = crc32_join(crc, x["crc"], 4 * x["n"])
                out.append(crc)
            return pd.Series(out, dtype="int64")

        return own.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts hold the end id alone; repeated rows are documents of their own; an empty table is empty."""
    return TokenStore.write(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents()
