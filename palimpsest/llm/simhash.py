"""SimHash near-deduplication, verified through pivot distance tables.

A fingerprint has 64 bits; two documents link when their fingerprints differ in ``DISTANCE`` bits or fewer. The work is
done on distinct fingerprints, so copies of a text never meet each other: they share one.

Candidates: the bits are cut into ``blocks`` blocks. Of two fingerprints that differ in at most three bits, at least
``blocks - 3`` blocks are equal, so each choice of that many blocks is a table whose key is their value; linked
fingerprints share a key in one table at least. The number of blocks follows the number of fingerprints, which keeps
the expected number of strangers in a bucket constant; no number of blocks misses a link.

Pivot distance table: each bucket holds its fingerprints' Hamming distances to ``PIVOTS`` reference fingerprints. By the
triangle inequality two fingerprints with a coordinate difference above three can't link, so pairs are discarded by
their maximum coordinate difference, and the survivors are verified bit by bit. A bucket emits links of a spanning
forest only, so its output is linear in its size. A bucket above ``SPLIT`` fingerprints is cut again by the pigeonhole
principle over the bits in which they differ before pairs are looked at.

Components come from trees that tasks join of their own shares of the links, and from alternating large-star and
small-star steps over those trees, as joins and aggregations; no links or components are collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

DISTANCE, SHINGLE, SEED, PIVOTS, SPLIT = 3, 3, 42, 24, 2048
#: Pairs that a sweep looks at together.
PAIRS = 1 << 20
#: Reference fingerprints: fixed and spread out, the same on every run.
REFERENCES = np.random.default_rng(64).integers(0, 2**64, PIVOTS, dtype=np.uint64)
_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64())])


# --- fingerprints -------------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; the whole sequence if it has fewer words; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns ``carry`` for each row; null text counts as empty."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.view(np.int64)), *part.columns[2:]], names=["doc_id", "fp", *carry])

    kinds = dict(documents.dtypes)
    schema = ", ".join(["doc_id long", "fp long", *(f"{c} {kinds[c]}" for c in carry)])
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry).mapInArrow(make, schema)


# --- links between distinct fingerprints ----------------------------------------------------------------------------


def block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def table_masks(blocks: int) -> list[int]:
    """A mask for each table: the bits that its key compares."""
    masks = block_masks(blocks)
    return [sum(c) for c in combinations(masks, blocks - DISTANCE)]


def blocks_for(n: int) -> int:
    """The fewest blocks whose keys have two bits more than the number of fingerprints; 4 at least, 12 at most."""
    need = max(1, n).bit_length() + 2
    return next((b for b in range(DISTANCE + 1, 12) if 64 * (b - DISTANCE) // b >= need), 12)


def near_pairs(fps: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that link: the pivot table discards, the bits of the survivors decide."""
    for p in range(table.shape[1]):
        if len(i) < 64:
            break
        keep = np.abs(table[i, p] - table[j, p]) <= DISTANCE
        i, j = i[keep], j[keep]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= DISTANCE
    return i[near], j[near]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def forest(n: int, i: np.ndarray, j: np.ndarray, parent: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Those of the links that join two trees so far, and the trees."""
    parent = np.arange(n) if parent is None else parent
    kept = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept, parent


def sweep(fps: np.ndarray) -> np.ndarray:
    """A spanning forest of the links among some fingerprints, by bands of the first pivot's coordinate."""
    n = len(fps)
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    hi = np.searchsorted(table[:, 0], table[:, 0] + DISTANCE, side="right")
    kept, parent, step = [], np.arange(n), max(1, PAIRS // n)
    for lo in range(0, n, step):
        top = min(lo + step, n)
        while not (parent[parent] == parent).all():
            parent = parent[parent]
        i, j = np.meshgrid(np.arange(lo, top), np.arange(lo, int(hi[top - 1])), indexing="ij")
        apart = (i < j) & (parent[i] != parent[j])  # pairs in one tree need no look
        new, parent = forest(n, *near_pairs(fps, i[apart], j[apart], table), parent)
        kept += new
    return fps[np.array(kept, np.int64).reshape(-1, 2)]


def bucket_links(fps: np.ndarray) -> np.ndarray:
    """A spanning forest of the links within one bucket.

    A large bucket is cut by the bits in which its members differ, four parts of them, of which linked members agree
    in one at least; unless that leaves a part's groups nearly as large, when cutting would only repeat the work.
    """
    n = len(fps)
    bits = [b for b in range(64) if n > SPLIT and len(np.unique(fps >> np.uint64(b) & np.uint64(1))) > 1]
    if len(bits) <= DISTANCE + 1:
        return sweep(fps)
    groups = []
    for part in np.array_split(np.array(bits, np.uint64), DISTANCE + 1):
        keys = fps & np.bitwise_or.reduce(np.uint64(1) << part)
        order = np.argsort(keys, kind="stable")
        groups += [g for g in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(g) > 1]
    if max(map(len, groups), default=0) > n // 8:
        return sweep(fps)
    links = np.concatenate([np.empty((0, 2), np.uint64), *(bucket_links(fps[g]) for g in groups)])
    order = np.argsort(fps)
    at = order[np.searchsorted(fps[order], links)]
    kept, _ = forest(n, at[:, 0], at[:, 1])
    return fps[np.array(kept, np.int64).reshape(-1, 2)]


def stretch_links(keys: np.ndarray, tables: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links of a stretch of rows sorted by (table, key) that holds whole buckets."""
    start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (tables[1:] != tables[:-1])])
    size = np.diff(np.r_[start, len(keys)])
    out = [np.empty((0, 2), np.uint64)]
    few = (size > 1) & (size <= 32)
    if few.any():
        of, f = np.repeat(np.flatnonzero(few), size[few]), fps[np.repeat(few, size)]
        table = pivot_table(f)
        for lag in range(1, int(size[few].max())):
            i = np.flatnonzero(of[lag:] == of[:-lag])
            a, b = near_pairs(f, i, i + lag, table)
            out.append(np.stack([f[a], f[b]], 1))
    for g in np.flatnonzero(size > 32):
        part = slice(start[g], start[g] + size[g])
        out.append(bucket_links(fps[part]))
    return np.concatenate(out)


def links(distinct: DataFrame, blocks: int) -> DataFrame:
    """Pairs (a, b), a < b as signed longs, whose transitive closure is that of all links between the fingerprints."""
    masks = table_masks(blocks)
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]

        def found(t, key, fp) -> pa.RecordBatch:
            got = stretch_links(key, t, fp.view(np.uint64)).view(np.int64)
            got = np.unique(np.sort(got, 1), axis=0) if len(got) else got
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=_OUT)

        pending: list[list[np.ndarray]] = []
        for part in parts:
            new = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            if not len(new[0]):
                continue
            if pending and (new[0][-1], new[1][-1]) == (pending[0][0][0], pending[0][1][0]):
                pending.append(new)  # a bucket that goes on
                continue
            held = [np.concatenate(c) for c in zip(*pending, new, strict=True)]
            last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1]) + 1 if (held[0][0], held[1][0]) != (held[0][-1], held[1][-1]) else 0
            if last:
                yield found(*(c[:last] for c in held))
            pending = [[c[last:] for c in held]]
        if pending:
            yield found(*(np.concatenate(c) for c in zip(*pending, strict=True)))

    dealt = rows.repartition(common.parallelism(distinct.sparkSession), "t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(search, "a long, b long")


# --- components ------------------------------------------------------------------------------------------------------


#: Links that one task joins into trees.
LINKS_A_TASK = 1 << 20


def trees(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) that join each node to the least one of its tree, the edges being dealt over ``parts`` tasks of which
    each joins its own."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in x.columns], 1) for x in batches if x.num_rows]
        pairs = np.concatenate(held) if held else np.empty((0, 2), np.int64)
        nodes = np.unique(pairs)
        at = np.searchsorted(nodes, pairs)
        _, parent = forest(len(nodes), at[:, 0], at[:, 1])
        while len(parent) and not (parent[parent] == parent).all():
            parent = parent[parent]
        low = parent < np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[parent[low]])], schema=_OUT)

    return edges.repartition(parts).mapInArrow(join, "a long, b long")


def star_components(edges: DataFrame, path: str, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """node and root (the least node of its component, itself included) for each node on an edge (a, b).

    Each task joins its share of the edges into trees first. Several tasks' trees are joined by alternating large-star and
    small-star steps until no edge changes; each round is written to ``path``. The least node of a large component is on
    most of its edges, so lookups by node are salted.
    """

    def settle(e: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        out = common.materialise(e.distinct(), f"{path}/stars-{k}")
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # an edge is (a, b) with a > b
    own = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{path}/links")
    parts = max(1, -(-own.count() // links_a_task))
    now, was = settle(trees(own, parts), 0)
    k = 0
    while parts > 1:
        k += 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.salted_lookup(both.where("v > u"), least, "u", f"{path}/large-{k}", by="v").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        now, is_ = settle(small, k)
        if is_ == was:
            break
        was = is_
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def near_dedup(documents: DataFrame, blocks: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id, linked (distinct fingerprints
    of its component are more than one), component (one number for each, whatever the ids), and the columns ``carry``.

    Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Repeated rows
    and ties share a fingerprint and so a component. component_id is the smallest doc_id of the component; a null
    doc_id counts only where it is alone. An empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    path = common.shared_dir(spark)
    prints = common.materialise(fingerprints(documents, carry), f"{path}/fingerprints")
    distinct = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), f"{path}/distinct")
    found = links(distinct.select("fp"), blocks or blocks_for(distinct.count()))
    stars = common.materialise(star_components(found, path), f"{path}/components")
    named = distinct.join(stars, distinct.fp == stars.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), (F.count(F.lit(1)) > 1).alias("linked"))
    by_print = common.salted_lookup(named, lows, "root", f"{path}/by-root", by="fp").select("fp", "component_id", "linked", F.col("root").alias("component"))
    # Copies of one text share a fingerprint: they are dealt by a salt, and the fingerprint's row goes to each salt.
    out = common.salted_lookup(prints, by_print, "fp", f"{path}/by-print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "linked", "component", *carry)


# --- groups by similarity ---------------------------------------------------------------------------------------------

#: Bands of minima and minima a band: two texts of similarity 0.8 share a band but in 3 of 100,000 cases.
BANDS, ROWS = 20, 4
#: Bits in which fingerprints of texts of similarity 0.8 differ at most: 10 on average, with a deviation of 3.
APART = 23
_A = np.random.default_rng(80).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SKETCH = "key long, id long, same binary, n int, fp long, bands array<long>"
#: Shingles that count as one member where a bucket's load is told, so that few long texts are as much as many short ones.
LOAD = 256


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def minima(hashes: np.ndarray) -> list[int]:
    """A key for each band of ``ROWS`` minima of the shingles' hashes under ``BANDS * ROWS`` permutations."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096, None] * _A
        low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(0))
    mixed = (low * _A).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)  # bands have factors of their own
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64).tolist()


def sketched(documents: DataFrame, shingle: int, path: str) -> DataFrame:
    """The documents as a column ``row``, with key (one a row), id, same (a hash of the set of shingles), n (its size),
    fp and bands; written to ``path``, so that the keys stay."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for part in parts:
            cols: list[list] = [[] for _ in range(5)]
            for text in part.column(1):
                hashes = shingle_hashes(text.as_py(), shingle)
                own = np.unique(hashes)
                told = (key, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own), np.uint64(fingerprint(hashes)).view(np.int64), minima(own) if len(own) else [])
                for c, x in zip(cols, told, strict=True):
                    c.append(x)
                key += 1
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            k, same, n, fp, bands = (pa.array(c, t) for c, t in zip(cols, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([k, part.column(0), same, n, fp, bands, part.column(2)], names=["key", "id", "same", "n", "fp", "bands", "row"])

    own = documents.select(common.order_id("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*[common.own_column(c) for c in documents.columns]).alias("row"))
    return common.materialise(own.mapInArrow(make, T.StructType.fromDDL(_SKETCH).add("row", own.schema["row"].dataType)), path)


def set_links(fps: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Places (i, j) of a spanning forest of the links among the members of a bucket, by their sets of shingles.

    Pivot distance table: each member's distance (one less the similarity, which is a metric) to ``PIVOTS`` members, each
    chosen farthest from those before. It links whoever is near a pivot, and by the triangle inequality discards pairs
    whose distances to some pivot differ too much. Of the survivors those in one tree need no look, fingerprints discard
    more, and the sets decide about the rest.
    """
    n = np.array([len(x) for x in sets])
    at = np.arange(len(sets))
    if len(sets) > 2:
        # what a member shares with no other can't be common to two
        _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.add.reduceat((count[inv] > 1).astype(np.int64), np.r_[0, np.cumsum(n)[:-1]])
        at = np.flatnonzero(shared >= least * n)
    if len(at) < 2:
        return np.empty((0, 2), np.int64)
    n, fps, sets = n[at], fps[at], [sets[i] for i in at]
    size, kept, comp = len(sets), [], np.arange(len(sets))
    words, inv = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(n)[:-1]]
    mark = np.zeros(len(words), bool)

    def common_with(i: int, others: np.ndarray | None = None) -> np.ndarray:
        """How many shingles member i has in common with the others, or with each member."""
        own = inv[start[i] : start[i] + n[i]]
        mark[own] = True
        if others is None:
            out = np.add.reduceat(mark[inv].astype(np.int64), start)
        else:
            out = np.array([np.count_nonzero(mark[inv[start[j] : start[j] + n[j]]]) for j in others.tolist()])
        mark[own] = False
        return out

    def join(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = comp[i], comp[j]
            if a != b:
                comp[comp == max(a, b)] = min(a, b)
                kept.append((i, j))

    ones = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    middle = np.packbits(2 * ones > size, bitorder="little").view("<u8")[0]
    pivot, table, near = int(np.bitwise_count(fps ^ middle).argmin()), [], np.full(size, 2.0)
    for _ in range(min(size - 1, PIVOTS)):
        both = common_with(pivot)
        table.append(1 - both / (n + n[pivot] - both))
        join(pivot, np.flatnonzero(both >= least * (n + n[pivot] - both)))
        near = np.minimum(near, table[-1])
        near[pivot] = -1
        pivot = int(near.argmax())
    if size - 1 > PIVOTS:
        table = np.stack(table, 1)
        for i in range(size - 1):
            j = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            j = j[np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j])]
            j = j[np.abs(table[j] - table[i]).max(1, initial=0) <= 1 - least + 1e-9]
            j = j[np.bitwise_count(fps[j] ^ fps[i]) <= APART]
            if len(j):
                both = common_with(i)[j] if 16 * len(j) > size else common_with(i, j)
                join(i, j[both >= least * (n[i] + n[j] - both)])
    return at[np.array(kept, np.int64).reshape(-1, 2)]


def bucket_forests(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) whose transitive closure is that of all links within the buckets (code, salt) of rows key, fp, hashes."""

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def take(bucket: list[tuple]) -> None:
            if len(bucket) > 1:
                keys, fps = np.array([r[0] for r in bucket], np.int64), np.array([r[1] for r in bucket], np.int64).view(np.uint64)
                sets = [np.frombuffer(r[2], np.uint32) for r in bucket]
                small, large = sorted((len(sets[0]), len(sets[1])))
                if len(bucket) > 2 or small >= least * large and np.bitwise_count(fps[0] ^ fps[1]) <= APART:
                    out.append(keys[set_links(fps, sets, least)])

        bucket, of = [], None
        for part in parts:
            for code, salt, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (code, salt) != of:
                    take(bucket)
                    bucket, of = [], (code, salt)
                bucket.append(row)
            got = np.concatenate([np.empty((0, 2), np.int64), *out])
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=_OUT)
        take(bucket)
        got = np.concatenate([np.empty((0, 2), np.int64), *out])
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=_OUT)

    dealt = rows.select("code", "salt", "key", "fp", "hashes").repartition(common.parallelism(rows.sparkSession), "code", "salt").sortWithinPartitions("code", "salt")
    return dealt.mapInArrow(search, "a long, b long")


def similar(documents: DataFrame, shingle: int = 5, least: float = 0.8, split: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """Rows key, id, grp for each document, and a table key, row (the document's columns): documents are linked when the
    sets of their word shingles have a similarity (common over all) of ``least`` or more, and grp is one number for all
    that links reach.

    Fingerprints of 64 bits differ in about 10 bits at that similarity, too many for buckets of equal bits, so buckets are
    bands of minima of the shingles' hashes. Of buckets with the same members one is searched, through a pivot distance
    table over the sets, which are hashes of 32 bits (``set_links``). Texts with one set of shingles are one node, so
    copies never meet. A bucket of a load above ``split`` is dealt over tasks: first by lots, and then the nodes outside its
    largest group meet all its parts.
    """
    spark = documents.sparkSession
    path = common.shared_dir(spark)
    rows = sketched(documents, shingle, f"{path}/sketched")
    nodes = rows.groupBy("same").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = common.materialise(nodes, f"{path}/nodes")
    all_ = Window.partitionBy("code")
    each = nodes.select("key", "n", F.explode("bands").alias("code"))
    each = each.select("code", "key", F.count(F.lit(1)).over(all_).alias("members"), F.sum("n").over(all_).alias("n"), F.bit_xor(F.xxhash64("key")).over(all_).alias("who")).where("members > 1")
    each = common.materialise(each, f"{path}/shared")
    once = each.groupBy("members", "n", "who").agg(F.min("code").alias("code")).select("code")
    size = F.greatest("members", F.ceil(F.col("n") / LOAD)).alias("size")
    buckets = common.materialise(each.join(once, "code", "left_semi").select("code", "key", size), f"{path}/buckets")
    sets = _sets_of(rows, common.materialise(buckets.select("key").distinct(), f"{path}/wanted"), shingle, f"{path}/sets")
    found = common.materialise(bucket_forests(_dealt(buckets, split).join(sets, "key"), least), f"{path}/found")
    stars = common.materialise(star_components(found, f"{path}/first"), f"{path}/stars")
    groups = nodes.select("key").join(stars, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("comp"))
    hot = buckets.where(F.col("size") > split)
    if not hot.isEmpty():
        more = common.materialise(bucket_forests(_rest(hot.join(groups, "key"), split).join(sets, "key"), least), f"{path}/more")
        stars = common.materialise(star_components(found.unionByName(more), f"{path}/last"), f"{path}/all-stars")
        groups = nodes.select("key").join(stars, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("comp"))
    named = nodes.select("same", "key").join(groups, "key").select("same", F.col("comp").alias("grp"))
    told = common.salted_lookup(rows.select("key", "id", "same"), named, "same", f"{path}/named", by="key")
    return told.select("key", "id", "grp"), rows.select("key", "row")


def _sets_of(rows: DataFrame, wanted: DataFrame, shingle: int, path: str) -> DataFrame:
    """key, fp and hashes (the sorted set of shingles, four bytes each) of the wanted nodes."""

    @F.pandas_udf("binary")
    def hashes(text):
        import pandas as pd

        return pd.Series([np.unique(shingle_set(t if isinstance(t, str) else None, shingle).astype(np.uint32)).tobytes() for t in text])

    texts = rows.select("key", "fp", F.col("row.text").cast("string").alias("text"))
    texts = texts.where(common.filter_of(wanted, "key")(F.col("key")))
    if wanted.count() > common.FILTER_BITS // 8:  # the filter lets many others pass, whose sets would be made for nothing
        texts = texts.join(wanted, "key", "left_semi")
    return common.materialise(texts.select("key", "fp", hashes("text").alias("hashes")), path)


def _lot(split: int) -> tuple[Column, Column]:
    """How many parts a bucket is dealt over, and whose part a member is in."""
    parts = F.ceil(F.col("size") / split).cast("int")
    return parts, F.pmod(F.xxhash64("key", F.lit(0)), parts).cast("int")


def _dealt(rows: DataFrame, split: int) -> DataFrame:
    """Bucket rows with ``salt``: 0 but in buckets above ``split``, which are dealt by lots."""
    return rows.withColumn("salt", F.when(F.col("size") > split, _lot(split)[1]).otherwise(0))


def _rest(hot: DataFrame, split: int) -> DataFrame:
    """Rows of dealt buckets whose members (of groups comp) are not yet all of one group: those of a bucket's largest
    group once, in their own part, and the others in each part."""
    counts = hot.groupBy("code", "comp").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("code").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    parts, own = _lot(split)
    salts = F.when(F.col("comp") == F.col("top"), F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))
    return hot.join(top, "code").withColumn("salt", F.explode(salts)).drop("top", "groups", "comp")


def one_of_each(documents: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, with their own columns, but of each group of similar ones the row of the smallest doc_id only.

    A null doc_id comes last, and ties go to the row that comes first. Null and empty texts, and texts of white space only,
    are one group; a text of fewer words than a shingle is a shingle as a whole. An empty table gives no rows.
    """
    told, rows = similar(documents, shingle, least)
    path = common.shared_dir(documents.sparkSession)
    told = common.materialise(told, f"{path}/groups")
    first = told.groupBy("grp").agg(F.min(F.struct("id", "key")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("grp", F.col("f.key").alias("first"))
    gone = common.salted_lookup(told, first, "grp", f"{path}/first", by="key").where("key <> first").select("key")
    gone = common.materialise(gone, f"{path}/gone")
    return common.without(rows, gone, f"{path}/alike", "key").select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
