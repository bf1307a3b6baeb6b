"""Packing tokenized documents into sequences by minimum bin slack.

A document's ids are cut into whole windows and a remainder. The remainders' lengths, not the documents, are the items:
there are fewer classes than the window has places, however many documents there are. For each pattern the longest
length left is set, and a bitset subset-sum dynamic program over the other classes' counts finds the multiset that
fills the window closest to its capacity; the counts are found by walking the bitsets back. A pattern is used as often
as the counts allow, and the search goes on with what is left.

Pieces find their place by their rank within their length: the task that cuts a piece numbers it among its own pieces of
that length, and counts by (length, task) say how many come before; so a length that a third of all documents share
stays dealt over the tasks that cut it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

WINDOW, END = 2048, 1
_PIECES = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("local", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
#: Bytes of ids that a task gathers before it hands them on; ids of one document that it holds to count them.
_HELD, _WHOLE = 2 << 20, 1 << 22
_OWN = ("part", "doc", "local")


def _ended(pieces: Iterator[np.ndarray], end: int) -> Iterator[tuple[np.ndarray, bool]]:
    """The pieces and the end id, and whether it is the last of them."""
    yield from ((ids, False) for ids in pieces)
    yield np.array([end], "<u4"), True


def cut_pieces(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, path: str | None = None, words: int = common.WORDS) -> DataFrame:
    """A table of pieces: part, doc (the document's number there), local (the piece's number among those of its length
    there), doc_id, start, length, doc_tokens, ids (little-endian, 32 bits).

    A document's ids come piece by piece. Of one with more than ``_WHOLE`` of them no more than a window is held; its
    pieces learn their document's length when the table is read. ``words`` bounds what an encoder remembers.
    """
    tokenizer, whole, most = tokenizer or common.tokenizer_path(), _WHOLE, _HELD

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = common.encoder(tokenizer, words), TaskContext.get().partitionId(), [0] * (window + 1)
        held: list[list] = []
        size = doc = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PIECES, strict=True)], schema=_PIECES)

        for part in parts:
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                first, start, rest = len(held), 0, np.empty(0, "<u4")
                for ids, last in _ended(encoder.pieces(text.as_py()), end):
                    rest = np.concatenate([rest, ids]) if len(rest) else ids
                    cuts = len(rest) // window * window
                    for at in [*range(0, cuts, window), *([cuts] if last and cuts < len(rest) else [])]:
                        own = rest[at : at + window]
                        held.append([task, doc, seen[len(own)], doc_id.as_py(), start, len(own), None, own.tobytes()])
                        seen[len(own)] += 1
                        start, size = start + len(own), size + 4 * len(own)
                    rest = rest[cuts:]
                    if start > whole and size >= most:
                        yield batch()
                        held, size, first = [], 0, None
                if first is not None:
                    for row in held[first:]:
                        row[6] = start
                doc += 1
                if size >= most:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    spark = documents.sparkSession
    thin = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = thin.mapInArrow(cut, "part int, doc long, local long, doc_id long, start long, length int, doc_tokens long, ids binary")
    pieces = common.materialise(pieces, path or f"{common.shared_dir(spark)}/pieces")
    long_ = pieces.where("doc_tokens IS NULL").groupBy("part", "doc").agg(F.max(F.col("start") + F.col("length")).alias("total"))
    if long_.isEmpty():
        return pieces
    return pieces.join(long_, ["part", "doc"], "left").withColumn("doc_tokens", F.coalesce("doc_tokens", "total")).select(*pieces.columns)


def fill(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """The multiset (length, how many) with the greatest sum up to ``capacity``; counts are (length, how many there are)."""
    mask, want = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, before = 1, []
    for length, most in counts:
        if length > capacity:
            continue
        before.append((length, most, reach))
        left, step = min(most, capacity // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach & want:
            break
    total, out = reach.bit_length() - 1, []
    for length, most, had in reversed(before):
        k = 0
        while not had >> total & 1:
            total -= length
            k += 1
        if k:
            out.append((length, k))
    return out


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, its (length, how many), longest first) for each pattern; together they use every item once."""
    left, out = dict(histogram), []
    while left:
        longest = max(left)
        rest = [(length, left[length] - (length == longest)) for length in sorted(left, reverse=True)]
        own: dict[int, int] = {longest: 1}
        for length, k in fill([x for x in rest if x[1]], window - longest):
            own[length] = own.get(length, 0) + k
        times = min(left[length] // k for length, k in own.items())
        out.append((times, sorted(own.items(), reverse=True)))
        for length, k in own.items():
            left[length] -= times * k
            if not left[length]:
                del left[length]
    return out


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, first sequence, pieces of that length in each, offset of the first)."""
    rows, used, first = [], {}, 0
    for times, own in found:
        offset = 0
        for length, k in own:
            lo = used.get(length, 0)
            used[length] = lo + times * k
            rows.append((length, lo, lo + times * k, first, k, offset))
            offset += length * k
        first += times
    return rows


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces, with all their columns but part, doc and local, and the sequence_id and offset of each."""
    spark = pieces.sparkSession
    counts = common.materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("c")), f"{common.shared_dir(spark)}/counts")
    histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    table = spark.createDataFrame(slots(patterns(histogram, window)), "length int, lo long, hi long, first long, k long, at long")
    before = counts.select("length", "part", (F.sum("c").over(Window.partitionBy("length").orderBy("part")) - F.col("c")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    # A row for each length of each pattern: their number is bounded by the window, whatever the number of documents.
    # Each class's slots, sorted by rank, are one array that a piece searches.
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "first", "k", "at"))).alias("slots"))
    met = ranked.join(F.broadcast(by_length), "length")
    met = met.withColumn("slot", F.expr("filter(slots, s -> s.lo <= rank AND rank < s.hi)[0]"))
    j = F.col("rank") - F.col("slot.lo")
    met = met.withColumn("sequence_id", F.col("slot.first") + F.expr("(rank - slot.lo) div slot.k")).withColumn("offset", F.col("slot.at") + (j % F.col("slot.k")) * F.col("length"))
    return met.select(*[c for c in pieces.columns if c not in _OWN], "sequence_id", "offset")


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, words: int = common.WORDS) -> DataFrame:
    """Rows doc_id, start, length, doc_tokens, ids, sequence_id, offset: each id of each document lies in one piece.

    Null and empty texts are the end id alone. Repeated rows and ties are packed each on their own; a null doc_id stays
    null. Texts of any length are cut into windows. An empty table gives no rows. Other columns are ignored.
    """
    return place(cut_pieces(documents, tokenizer, window, end, words=words), window)


def sequences(placed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """One row for each sequence: sequence_id, tokens (array, padded to the window unless its length is a power of two)
    and doc_ids by piece."""
    by = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(by.alias("p"))

    @F.pandas_udf("array<int>")
    def join(pieces):
        import pandas as pd

        out = []
        for own in pieces:
            ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).astype(np.int32)
            out.append(ids if len(ids) & (len(ids) - 1) == 0 else np.r_[ids, np.full(window - len(ids), pad, np.int32)])
        return pd.Series(out)

    return rows.select("sequence_id", join("p").alias("tokens"), F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"))


@F.pandas_udf(T.LongType())
def crc32_of(ids):
    import pandas as pd

    return pd.Series([zlib.crc32(x) for x in ids], dtype="int64")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    placed = place(pieces.withColumn("ids_crc32", crc32_of("ids")).drop("ids"))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
