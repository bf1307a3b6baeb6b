"""Content-defined chunking with a gear hash and two-step normalisation, and putting files together again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import CHUNK_AVG, CHUNK_MAX, CHUNK_MIN, CHUNK_THRESHOLD

#: One word for each byte value, from a rule: the first eight bytes of its SHA-256.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "little") for i in range(256)], np.uint64)


def _gear(data: np.ndarray) -> np.ndarray:
    """At each place the gear hash of the (up to) 64 bytes that end there, by doubling the window six times."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        if len(h) > step:
            moved = h[:-step] << np.uint64(step)
            h = h.copy()
            h[step:] += moved
    return h


def _mask(bits: int) -> np.uint64:
    """``bits`` ones at the top, where the hash depends on the whole window."""
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def cut_points(data: bytes, smallest: int = CHUNK_MIN, average: int = CHUNK_AVG, largest: int = CHUNK_MAX) -> list[int]:
    """Ends of the chunks. Before the average size a cut needs two more zero bits than the average calls for, after it
    two fewer; no chunk but the last is below ``smallest`` and none above ``largest``. Empty data has no chunk."""
    n = len(data)
    if not n:
        return []
    bits = average.bit_length() - 1
    h = _gear(np.frombuffer(data, np.uint8))
    hard, easy = (np.flatnonzero((h & _mask(k)) == 0) + 1 for k in (bits + 2, max(1, bits - 2)))
    out, at = [], 0
    while n - at > smallest:
        middle, end = min(at + average, n), min(at + largest, n)
        k = np.searchsorted(hard, at + smallest)
        if k < len(hard) and hard[k] <= middle:
            cut = int(hard[k])
        else:
            k = np.searchsorted(easy, middle)
            cut = int(easy[k]) if k < len(easy) and easy[k] <= end else end
        out.append(cut)
        at = cut
    if at < n:
        out.append(n)
    return out


CHUNK_SCHEMA = "file_hash string, total_size long, pos long, offset long, size long, hash string, data binary"


def chunk_files(files: DataFrame, smallest: int = CHUNK_MIN, average: int = CHUNK_AVG, largest: int = CHUNK_MAX) -> DataFrame:
    """A row for each chunk of each file (a column ``data``): file_hash, total_size, pos, offset, size, hash, data."""
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for cell in part.column(0):
                data = cell.as_py() or b""
                whole, ends = hashlib.sha256(data).hexdigest(), cut_points(data, smallest, average, largest)
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                pieces = [data[s:e] for s, e in zip(starts, ends, strict=True)]
                cols = ([whole] * len(ends), [len(data)] * len(ends), list(range(len(ends))), starts, [len(p) for p in pieces], [hashlib.sha256(p).hexdigest() for p in pieces], pieces)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return files.select(F.col("data").cast("binary")).mapInArrow(cut, CHUNK_SCHEMA)


def should_chunk(size: Column) -> Column:
    return size >= CHUNK_THRESHOLD


def manifests(chunks: DataFrame) -> DataFrame:
    """file_hash, total_size, chunks (array of hash, offset, size in order) from rows of ``chunk_files``."""
    rows = chunks.groupBy("file_hash", "total_size").agg(F.array_sort(F.collect_set(F.struct("pos", "hash", "offset", "size"))).alias("c"))
    return rows.select("file_hash", "total_size", F.transform("c", lambda x: F.struct(x["hash"].alias("hash"), x["offset"].alias("offset"), x["size"].alias("size"))).alias("chunks"))


def reassemble(manifests: DataFrame, chunks: DataFrame, verify: bool = True) -> DataFrame:
    """file_hash, data. With ``verify`` data is null unless every chunk is there with its size and hash and the whole
    has the file's hash; without it a missing chunk is an error and nothing else is looked at."""
    store = chunks.select("hash", "data").dropDuplicates(["hash"])
    wanted = manifests.select("file_hash", "total_size", F.size("chunks").alias("n"), F.posexplode_outer("chunks").alias("pos", "c"))
    met = wanted.join(store, F.col("c.hash") == store.hash, "left").select("file_hash", "total_size", "n", "pos", F.col("c.hash").alias("h"), F.col("c.size").alias("size"), "data")
    sound = (F.octet_length("data") == F.col("size")) & (F.sha2("data", 256) == F.col("h"))
    whole = F.expr("listagg(data) WITHIN GROUP (ORDER BY pos)")
    rows = met.groupBy("file_hash", "total_size", "n").agg(whole.alias("data"), F.count_if(sound).alias("sound"), F.count("data").alias("there"))
    rows = rows.withColumn("data", F.coalesce("data", F.lit(b"")))
    if verify:
        good = (F.greatest(F.col("n"), F.lit(0)) == F.col("sound")) & (F.sha2("data", 256) == F.col("file_hash")) & (F.octet_length("data") == F.col("total_size"))
        return rows.select("file_hash", F.when(good, F.col("data")).alias("data"))
    missing = F.raise_error(F.concat(F.lit("a chunk is missing of "), F.col("file_hash")))
    return rows.select("file_hash", F.when(F.col("there") == F.greatest(F.col("n"), F.lit(0)), F.col("data")).otherwise(missing).alias("data"))


def chunk_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over two files' chunks: shared (distinct hashes of both) and changed (the second's others)."""
    mine, other = a.select("hash").distinct().withColumn("a", F.lit(1)), b.select("hash").distinct().withColumn("b", F.lit(1))
    return other.join(mine, "hash", "left").agg(F.count("a").alias("shared"), (F.count(F.lit(1)) - F.count("a")).alias("changed"))
