"""Content hashes and hashes of ordered lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import col, is_hash


def content_hash(data: Column | str) -> Column:
    """SHA-256 as 64 lower-case hexadecimal digits."""
    return F.sha2(col(data), 256)


def ordered_hash(parts: Column, separator: str = "") -> Column:
    """The hash of an array's strings, in its order."""
    return F.sha2(F.array_join(parts, separator), 256)


def u64_bytes(n: Column | str) -> Column:
    """A whole number's eight bytes, least first, as the incremental hash takes numbers."""
    digits = F.lpad(F.hex(col(n).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def hash_groups(rows: DataFrame, key: str, order: str, data: str = "data") -> DataFrame:
    """key, parts, bytes and hash of each group's pieces behind each other, in order.

    The hash runs over the pieces as they come by, one at a time, so a group of any size needs no memory of its own; a
    null piece counts as empty, and the pieces of a null key are a group.
    """
    kind = dict(rows.dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, size, begun = None, hashlib.sha256(), 0, 0, False
        out: list[tuple] = []
        for part in parts:
            keys, pieces = part.column(0).to_pylist(), part.column(1)
            for i, k in enumerate(keys):
                if begun and k != now:
                    out.append((now, n, size, state.hexdigest()))
                    state, n, size = hashlib.sha256(), 0, 0
                now, begun = k, True
                piece = pieces[i].as_py() or b""
                state.update(piece)
                n, size = n + 1, size + len(piece)
            if out:
                yield table(out, part.schema.field(0).type)
                out = []
            own = part.schema.field(0).type
        if begun:
            yield table([(now, n, size, state.hexdigest())], own)

    def table(out: list[tuple], own: pa.DataType) -> pa.RecordBatch:
        kinds = (own, pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[key, "parts", "bytes", "hash"])

    own = rows.select(F.col(key), F.col(data).cast("binary").alias("__data"), F.col(order).alias("__order"))
    dealt = own.repartition(key).sortWithinPartitions(key, "__order")
    return dealt.select(key, "__data").mapInArrow(run, f"`{key}` {kind}, parts long, bytes long, hash string")


def set_digest(*fields: Column) -> Column:
    """A digest of a group's set of rows that needs no order: XOR of the four words of each row's SHA-256, and their
    number. It combines on the map side, so a group of any size costs one row a task."""
    sha = F.sha2(F.concat_ws("\n", *[f.cast("string") for f in fields]), 256)
    words = [F.bit_xor(F.conv(F.substring(sha, 1 + 16 * k, 16), 16, -10).cast("long")) for k in range(4)]
    return F.concat_ws("-", F.count(F.lit(1)).cast("string"), *[F.hex(w) for w in words])


def slice_bytes(data: Column | str, offset: Column, size: Column) -> Column:
    """``size`` bytes from ``offset``; empty if they are not all there."""
    data = col(data)
    return F.when(offset + size <= F.octet_length(data), F.substr(data, (offset + 1).cast("int"), size.cast("int"))).otherwise(F.lit(b""))


def batch_hashes(rows: DataFrame, data: str = "data", slices: str = "slices") -> DataFrame:
    """For each slice (offset, size) of a buffer its place and hash; slices out of range hash as empty."""
    each = rows.select("*", F.posexplode(slices).alias("pos", "s")).drop(slices)
    return each.withColumn("hash", content_hash(slice_bytes(data, F.col("s.offset"), F.col("s.size")))).withColumn("pos", F.col("pos").cast("long")).drop("s", data)


def verify_puts(puts: DataFrame, key: str = "hash", data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Objects whose bytes have the hash they are put under, and the rejected."""
    marked = puts.withColumn("__ok", is_hash(key) & (F.lower(F.col(key)) == content_hash(F.coalesce(F.col(data), F.lit(b"")))))
    return marked.where("__ok").drop("__ok"), marked.where("NOT __ok").drop("__ok")
