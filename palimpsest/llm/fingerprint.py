"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. In each round runs of one symbol become one, and deterministic coin tossing labels
each symbol by the lowest bit in which it differs from the one before (and that bit's value). After ``TOSSES`` rounds of
it on the labels themselves there are six labels or fewer, equal neighbours still don't occur, and the labels' local
maxima, which are never far apart, begin the phrases. A phrase's name is a hash of its symbols; the names are the next
round's sequence. Where a phrase begins depends on a few neighbours only, so equal substrings share the names of their
interior phrases wherever they stand.

The signatures of a text are the names of its phrases from round ``FROM`` on (and of lower rounds where a text is too
short for those); the fingerprint is a one-permutation MinHash of them, so the likeness of two fingerprints estimates
the share of common signatures. All texts of a batch are parsed at once, as arrays.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

SLOTS, FROM, FEW, TOSSES = 64, 3, 8, 3
#: Code points that are parsed together, unless one text has more.
GATHER = 1 << 20
_EMPTY = np.uint64(0xFFFF)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _toss_table(symbols: int) -> np.ndarray:
    """Label of (symbol, symbol before) for small alphabets."""
    a, b = np.arange(symbols)[:, None], np.arange(symbols)[None, :]
    d = a ^ b
    low = np.where(d > 0, np.bitwise_count((d & -d) - 1), 0)
    return (2 * low + (a >> low & 1)).astype(np.uint8)


#: 128 labels after the first toss of 64-bit symbols, 14 after the second, 8 after the third, 6 after the fourth.
_TABLE = _toss_table(128)


def labels(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Few labels for symbols of which no neighbours are equal; ``start`` marks the first symbol of each text."""
    d = x ^ np.concatenate([[~x[0]], x[:-1]]) if len(x) else x
    d[start] = np.uint64(1)
    low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1))
    out = (low << 1) | ((x >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(TOSSES):
        before = np.concatenate([out[:1], out[:-1]])
        first = out[start] & 1
        out = _TABLE[out, before]
        out[start] = first
    return out


def next_round(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of each text, and the text of each; x has 64-bit symbols, doc is sorted."""
    n = len(x)
    new_doc = np.empty(n, bool)
    new_doc[:1] = True
    np.not_equal(doc[1:], doc[:-1], out=new_doc[1:])
    # runs of one symbol become one symbol that says how long they were
    head = new_doc.copy()
    head[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(head)
    if len(at) < n:
        length = np.diff(np.append(at, n)).astype(np.uint64)
        x, doc, new_doc = x[at], doc[at], new_doc[at]
        long_ = length > 1
        x[long_] = _mix(x[long_] + length[long_] * _M1)
        # a named run can't equal its neighbour but by a clash of hashes; one bit keeps neighbours apart even then
        clash = np.flatnonzero((x[1:] == x[:-1]) & ~new_doc[1:]) + 1
        x[clash] ^= np.uint64(1)
        n = len(x)
    lab = labels(x, new_doc)
    # phrases begin at local maxima
    top = np.empty(n, bool)
    top[:1] = True
    if n > 1:
        top[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] >= lab[2:])
        top[-1] = lab[-1] > lab[-2]
        after = np.append(new_doc[1:], True)
        top[after] &= False  # a last symbol never stands alone
        second = np.flatnonzero(new_doc[:-1]) + 1
        top[second] = False
    top |= new_doc
    begin = np.flatnonzero(top)
    pos = np.arange(n, dtype=np.int64) - np.repeat(begin, np.diff(np.append(begin, n)))
    names = np.add.reduceat(_mix(x + (pos.astype(np.uint64) + np.uint64(1)) * _M1), begin) if n else x
    return _mix(names), doc[begin]


def _slots(names: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """One-permutation MinHash: for each text and slot the least 48-bit value of the names that fall there."""
    out = np.full(texts * SLOTS, 2**63, np.uint64)
    if len(names):
        h = _mix(names + _M1)
        key = doc.astype(np.int64) * SLOTS + (h >> np.uint64(58)).astype(np.int64)
        np.minimum.at(out, key, h & np.uint64((1 << 48) - 1))
    return out.reshape(texts, SLOTS)


def sketches(texts: list[np.ndarray]) -> np.ndarray:
    """For each text (an array of code points) its slots, 16 bits each; ``_EMPTY`` where no signature falls."""
    size = [len(t) for t in texts]
    x = np.concatenate([*texts, np.empty(0, "<u4")]).astype(np.uint64)
    x = _mix((x + np.uint64(1)) * _M1)
    doc = np.repeat(np.arange(len(texts)), size)
    least = _slots(x[:0], doc[:0], len(texts))
    told = np.zeros(len(texts), bool)  # texts whose signatures are complete
    held: list[tuple[np.ndarray, np.ndarray]] = [(x, doc)]
    rounds = 0
    while len(x):
        x, doc = next_round(x, doc)
        rounds += 1
        if rounds < FROM:
            held.append((x, doc))
            continue
        least = np.minimum(least, _slots(x, doc, len(texts)))
        if rounds == FROM:
            # short texts: the lower rounds, from the top, until there are a few signatures
            count = np.bincount(doc, minlength=len(texts))
            told = count >= FEW
            for lx, ld in reversed(held):
                use = ~told[ld]
                if use.any():
                    least = np.minimum(least, _slots(lx[use], ld[use], len(texts)))
                    count += np.bincount(ld[use], minlength=len(texts))
                    told = told | (count >= FEW)
        left = np.bincount(doc, minlength=len(texts))[doc] > 1  # texts of one phrase are done
        x, doc = x[left], doc[left]
    return np.where(least < 2**63, least % np.uint64(0xFFFF), _EMPTY).astype(np.uint16)


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row: common signatures over the mean of both texts' signatures; 1 for two empty texts.

    Equal slots among the filled ones estimate common / united signatures, from which that share follows.
    """
    filled = (a != 0xFFFF) | (b != 0xFFFF)
    used = filled.sum(-1)
    united = ((a == b) & filled).sum(-1) / np.maximum(1, used)
    return np.where(used > 0, 2 * united / (1 + united), 1.0)


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def edited(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its last floor(n / 2) code points replaced by as many first ones of the following text, or all."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], following[:half]])


def with_successors(documents: DataFrame, buckets: int) -> DataFrame:
    """Rows bucket, last (true for the row that only lends its text), id, doc_id, text; sorted in each bucket.

    Buckets are ranges of (id, hash of the text); an id that many rows share (null ids do) is cut by the hashes. The first
    row of a bucket is also lent to the bucket before it (the first bucket's to the last), so each row meets its successor
    in its own bucket. The driver holds two numbers a bucket.
    """
    rows = documents.select(common.order_id("doc_id").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = rows.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.1 / buckets) if buckets > 1 else []
    parts = Counter(min(int(c), common.LAST_ID) for c in found)  # a cut that comes m times is an id of about m buckets' rows
    cuts = [(c, -(2**63) + k * 2**64 // m) for c, m in sorted(parts.items()) for k in range(m)]
    at_id, at_h = (np.array(x, np.int64) for x in (zip(*cuts, strict=True) if cuts else ([], [])))

    @F.pandas_udf("int")
    def bucket_of(id_, h):
        import pandas as pd

        ids, hashes = id_.to_numpy(np.int64), h.to_numpy(np.int64)
        out = np.searchsorted(at_id, ids, side="right")
        for c, m in parts.items():
            own = np.flatnonzero(ids == c) if m > 1 else ()
            if len(own):
                lo = int(np.searchsorted(at_id, c, side="left"))
                out[own] = lo + np.searchsorted(at_h[lo : lo + m], hashes[own], side="right")
        return pd.Series(out.astype(np.int32))

    bucket = bucket_of("id", "h")
    thin = rows.select(bucket.alias("bucket"), "id", "h")
    firsts = sorted((r.bucket, r.f.id, r.f.h) for r in thin.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("f")).collect())
    lend = documents.sparkSession.createDataFrame([(i, h, firsts[k - 1][0]) for k, (_, i, h) in enumerate(firsts)], "id long, h long, lender int")
    own = rows.withColumn("bucket", bucket).withColumn("last", F.lit(False))
    lent = rows.join(F.broadcast(lend), ["id", "h"]).dropDuplicates(["id", "h", "lender"]).withColumn("bucket", F.col("lender")).withColumn("last", F.lit(True)).drop("lender")
    both = own.unionByName(lent)
    return both.repartition(common.partitions_for(documents), "bucket").sortWithinPartitions("bucket", "last", "id", "h")


def fingerprint_documents(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    Null text counts as empty. The next document is that of the next higher doc_id, the first one's after the last;
    rows of one doc_id follow each other by their text's hash, a null doc_id comes last, and a lone document is its own
    next. Repeated rows are documents of their own. An empty table gives no rows. Other columns are ignored.
    """

    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(kinds)

    def work(rows: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        """Rows but the last, which is the successor of the one before it."""
        own = [p for _, p in rows]
        changed = [edited(a, b) for a, b in zip(own, own[1:], strict=False)]
        all_ = sketches(own + changed)
        a, e = all_[: len(own)], all_[len(own) :]
        sha = [hashlib.sha256(c.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for c in changed]
        cols = ([d for d, _ in rows[:-1]], [len(p) for p in own[:-1]], sha, [text_of(s) for s in a[:-1]], [text_of(s) for s in e], likeness(a[:-1], e), likeness(a[:-1], a[1:]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for part in parts:
            for bucket, doc_id, text in zip(*(part.column(i) for i in range(3)), strict=True):
                if bucket.as_py() != now:
                    if len(held) > 1:
                        yield work(held)
                    held, size, now = [], 0, bucket.as_py()
                held.append((doc_id.as_py(), points(text.as_py())))
                size += 2 * len(held[-1][1])
                if size >= GATHER and len(held) > 1:
                    yield work(held)
                    held = held[-1:]
                    size = 2 * len(held[0][1])
        if len(held) > 1:
            yield work(held)

    dealt = with_successors(documents, buckets or 8 * common.partitions_for(documents)).select("bucket", "doc_id", "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
