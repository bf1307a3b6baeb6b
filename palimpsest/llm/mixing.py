"""Mixing sources to target weights by the cube method.

Targets: the sources, by code point with null last, weigh 1, 2, 3 and so on in turn and share the sum of all sizes; a
target stops at three times its source's size and the excess goes to the others by weight, until none is above.

Each document of a source is due target / source size times, three at most: that many whole copies, and one more with
a fractional inclusion probability. The cube method settles the fractions. Flight: among three documents the move that
leaves both totals (tokens and documents) as they are lies in the null space of two equations, which is their cross
product; the step goes to one of the two faces of the cube, by lot weighted so that no document's probability changes on
average. Each step settles a document, the largest first. Flights run in blocks of a source, so a source of any size is
dealt over many tasks; what a block leaves (two small documents) goes to the next round's blocks. Landing, in a source's
last block: a linear program over the one or two documents that are still open, which keeps their probabilities. A source
whose draw is then off by more than ``NEAR`` of its target has documents turned round until it is not: a source of few
documents, or with one document that is a large part of it, can't keep both its probabilities and its target.

Lots are hashes of (seed, round, source, block), so reruns agree.
"""

from __future__ import annotations

import hashlib
import random
from collections import deque
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

BLOCK, MOST, WEIGHTS, SEED, NEAR = 4096, 3.0, (1, 2, 3), 9, 0.01
_EPS = 1e-9
#: Sources whose targets are broadcast; of more, the join is left to Spark.
MOST_SOURCES = 100_000
#: Rows of a table in files whose copies are handed out by place (a byte each); of more, the rows meet their copies.
MOST_PLACED = 1 << 25
#: Rows that one row becomes in one go.
REPEATS = 1 << 16


def word_count(text: str = "text") -> Column:
    """The number of words; 0 for null."""
    words = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(words, common.SPACE, "")).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Each source's share of the sum of all sizes."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = dict(zip(order, cycle(weights), strict=False))
    left, rest, out = float(sum(sizes.values())), list(order), {}
    while rest:
        by = left / sum(weight[s] for s in rest)
        full = [s for s in rest if by * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: by * weight[s] for s in rest}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            rest.remove(s)
    return out


def flight(prob: list[float], size: list[float], lot: random.Random) -> tuple:
    """Moves probabilities until two of them at most are fractions; sums of prob * size and of prob stay.

    Returns the probabilities, the places of the fractions, and the step that moves them along a direction. Each
    probability is kept on average.
    """
    prob = [p if 0 < p < 1 else float(p >= 1) for p in prob]

    def move(own: list[int], step: list[float]) -> list[int]:
        ahead = min((1 - prob[i]) / s if s > 0 else prob[i] / -s for i, s in zip(own, step, strict=True) if s)
        back = min(prob[i] / s if s > 0 else (1 - prob[i]) / -s for i, s in zip(own, step, strict=True) if s)
        by = ahead if lot.random() * (ahead + back) < back else -back
        for i, s in zip(own, step, strict=True):
            prob[i] += by * s
            if prob[i] < _EPS:
                prob[i] = 0.0
            elif prob[i] > 1 - _EPS:
                prob[i] = 1.0
        return [i for i in own if 0 < prob[i] < 1]

    # The two largest open documents pay for each other and the smallest makes up the difference, so large ones settle
    # first and what is left to the landing is small.
    rest = deque(sorted((i for i, p in enumerate(prob) if 0 < p < 1), key=lambda i: -size[i]))
    large: list[int] = []
    small: list[int] = []
    while True:
        while len(large) < 2 and rest:
            large.append(rest.popleft())
        if not small and rest:
            small.append(rest.pop())
        if len(large) + len(small) < 3:
            break
        a, b, c = (size[k] for k in large + small)
        step = [1.0, -1.0, 0.0] if a == b else [0.0, 1.0, -1.0] if b == c else [1.0, 0.0, -1.0] if a == c else [(b - c) / abs(a - c), (c - a) / abs(a - c), (a - b) / abs(a - c)]
        left = move(large + small, step)
        large, small = [i for i in large if i in left], [i for i in small if i in left]
    open_ = large + small
    if len(open_) == 2 and size[open_[0]] == size[open_[1]]:
        open_ = move(open_, [1.0, -1.0])
    return prob, open_, move


def land(prob: list[float], size: list[float], lot: random.Random) -> list[float]:
    """A flight, and a landing of the documents that it leaves open, two at most, on whole draws.

    Of all draws that keep both probabilities, which differ in the chance t of taking both, the linear program takes the
    one whose tokens are nearest to their due on average; its objective is linear in t, so t is an end of its range.
    """
    prob, open_, _ = flight(prob, size, lot)
    if len(open_) == 2:
        (p, q), (a, b) = (prob[k] for k in open_), (size[k] for k in open_)
        off = lambda x, y: abs((x - p) * a + (y - q) * b)
        both = max(0.0, p + q - 1) if off(1, 1) + off(0, 0) >= off(1, 0) + off(0, 1) else min(p, q)
        at = lot.random()  # both, the first alone, the second alone, none
        prob[open_[0]] = float(at < p)
        prob[open_[1]] = float(at < both or p <= at < p + q - both)
    elif open_:
        prob[open_[0]] = float(lot.random() < prob[open_[0]])
    return prob


def corrected(drawn: list[float], prob: list[float], size: list[float], slack: float) -> list[float]:
    """The draw, if its tokens are within ``slack`` of their due; else with documents turned round, each time the one that
    brings the tokens nearest, until they are or none helps.

    A draw is that far off only where a document is a large part of what its source is due, since no draw can keep the
    probability of such a document and the total, too; there the total goes first.
    """
    off = sum((d - p) * s for d, p, s in zip(drawn, prob, size, strict=True))
    if abs(off) <= slack:
        return drawn
    out, sizes = np.array(drawn), np.array(size, float)
    while abs(off) > slack:
        turned = off + np.where(out > 0, -sizes, sizes)
        best = int(np.abs(turned).argmin())
        if abs(turned[best]) >= abs(off) - _EPS:
            break
        out[best], off = 1 - out[best], float(turned[best])
    return out.tolist()


def lot(*key) -> random.Random:
    return random.Random(hashlib.blake2b(repr(key).encode(), digest_size=8).digest())


def numbered(rows: DataFrame, times: str, n: str) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 1 in a new column ``n``, in parts of ``REPEATS`` rows
    that are dealt over the tasks."""
    own = rows.columns
    part, size = common.fresh("part", own), F.col(f"`{times}`").cast("long")
    parts = rows.where(size > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / REPEATS))).alias(part))
    if not rows.where(size > REPEATS).isEmpty():
        parts = parts.repartition(common.parallelism(rows.sparkSession))
    first = F.col(part) * REPEATS
    return parts.select(*[common.own_column(c) for c in own], F.explode(F.sequence(first + 1, F.least(first + REPEATS, size))).alias(n))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = SEED, near: float = NEAR) -> DataFrame:
    """One row for each document: doc_id, source, size (words), source_size, target, copies, taken (copies * size).

    Null text has size 0 and takes nothing; a null source is a source of its own. Repeated rows and ties are settled
    one by one, each as its own row. A source without words has target 0. An empty table gives no rows. Other columns
    are ignored. The driver holds a few numbers for each source.
    """
    spark = documents.sparkSession
    path = common.shared_dir(spark)
    thin = common.materialise(documents.select(common.order_id("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), f"{path}/sizes")
    by = {r.source: r for r in thin.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    goal = targets({s: r["size"] for s, r in by.items()}, weights, most)
    plan = [(s, int(r["size"]), float(goal[s]), goal[s] / r["size"] if r["size"] else 0.0) for s, r in by.items()]
    table = spark.createDataFrame(plan, "source string, source_size long, target double, due double")
    rows = thin.join(F.broadcast(table) if len(plan) <= MOST_SOURCES else table, thin.source.eqNullSafe(table.source)).select("doc_id", thin.source, "size", "source_size", "target", F.floor("due").alias("whole"), (F.col("due") - F.floor("due")).alias("prob"))

    def settle(frame: DataFrame, k: int, most_rows: int) -> DataFrame:
        """Rows (source, doc_id, size, target, prob, n) after a flight in each block; n is the number of repeated rows."""
        last = most_rows <= block
        blocks = max(1, -(-most_rows // block))
        spread = frame.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "n", F.lit(seed + k)), F.lit(blocks)).cast("int"))

        def fly(pdf):
            pdf = pdf.sort_values(["doc_id", "size", "n"], kind="stable", na_position="last").reset_index(drop=True)
            source = None if pdf.source.isna().iloc[0] else pdf.source.iloc[0]
            prob, size = pdf.prob.tolist(), pdf["size"].tolist()
            by = lot(seed, k, source, int(pdf.part.iloc[0]))
            pdf["prob"] = corrected(land(prob, size, by), prob, size, near * float(pdf.target.iloc[0])) if last else flight(prob, size, by)[0]
            return pdf[["source", "doc_id", "size", "target", "n", "prob"]]

        return spread.groupBy("source", "part").applyInPandas(fly, "source string, doc_id long, size long, target double, n long, prob double")

    # Repeated rows are told apart by their number among rows with the same id and size, counted by source.
    single = rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"), F.first("prob").alias("prob"), F.first("target").alias("target"))
    left = single.where("prob > 0 AND size > 0").select("source", "doc_id", "size", "target", "times", "prob")
    left = common.materialise(numbered(left, "times", "n").drop("times"), f"{path}/fractions")
    settled, k, most_rows = [], 0, max([r.n for r in by.values()], default=0)
    while True:
        out = common.materialise(settle(left, k, most_rows), f"{path}/flight-{k}")
        settled.append(out.where("prob = 0 OR prob = 1"))
        left = out.where("prob > 0 AND prob < 1")
        if most_rows <= block:
            break
        most_rows = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        k += 1
    drawn = settled[0]
    for s in settled[1:]:
        drawn = drawn.unionByName(s)
    extra = drawn.where("prob = 1").groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("drawn"))
    counted = rows.groupBy("source", "doc_id", "size", "source_size", "target", "whole").agg(F.count(F.lit(1)).alias("times")).alias("r")
    joined = counted.join(extra.alias("e"), F.expr("r.source <=> e.source AND r.doc_id <=> e.doc_id AND r.size = e.size"), "left")
    copies = F.col("whole") + F.when(F.col("n") <= F.coalesce("drawn", F.lit(0)), 1).otherwise(0)
    each = numbered(joined.select("r.*", "drawn"), "times", "n")
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("long")
    return each.select(F.nullif("doc_id", F.lit(common.LAST_ID)).alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: Bits of the numbers of rows of a file that share an array of copies.
_CHUNK = 16


@F.pandas_udf(T.ArrayType(T.ByteType()))
def _by_place(at: pd.Series, times: pd.Series) -> list:
    out = np.full(int(at.max()) + 1, -1, np.int8)
    out[at.to_numpy()] = times.to_numpy()
    return out.tolist()


def with_copies(documents: DataFrame, by_id: DataFrame, due: str, path: str) -> DataFrame | None:
    """The documents with a column ``due``: how often each is taken, or -1 where ids don't tell. None if the rows come
    from no files that number them. ``by_id`` has doc_id, source, total and rows, and is met without the texts.

    A row's place is its file and its number there. The copies of a file's rows are arrays, a byte a row, that go to every
    task; so the texts stay where they are. Places that several rows have, and totals of over a byte, are -1.
    """
    try:
        meta = documents.metadataColumn("_metadata")
        number = meta.getField("row_index")
        place, at = F.xxhash64(meta.getField("file_path"), F.shiftright(number, _CHUNK)), (number % (1 << _CHUNK)).cast("int")
        names = documents.columns
        near, spot, all_ = (common.fresh(c, [*names, due]) for c in ("place", "at", "times"))
        rows = documents.select(*[common.own_column(c) for c in names], place.alias(near), at.alias(spot))
    except AnalysisException:
        return None
    thin = rows.select(common.own_column("doc_id").cast("long").alias("doc_id"), common.own_column("source").cast("string").alias("source"), F.col(near).alias("place"), F.col(spot).alias("at"))
    told = F.when((F.col("rows") == 1) & F.col("total").between(0, 127), F.col("total")).otherwise(-1)
    met = thin.alias("d").join(by_id.alias("m"), F.expr("d.doc_id <=> m.doc_id AND d.source <=> m.source")).select("place", "at", told.alias("times"))
    single = met.groupBy("place", "at").agg(F.when(F.count(F.lit(1)) == 1, F.min("times")).otherwise(-1).cast("int").alias("times"))
    arrays = common.materialise(single.groupBy("place").agg(_by_place("at", "times").alias("times")), path)
    arrays = arrays.select(F.col("place").alias(near), F.col("times").alias(all_))
    found = rows.join(F.broadcast(arrays), near)
    return found.select(*[common.own_column(c) for c in names], F.get(all_, F.col(spot)).cast("long").alias(due))


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The documents, with their own columns, each as often as the mix takes it.

    Rows that share their doc_id and source (null ids do) have copies of their own. The mix tells them apart by size
    only, so of those of one size the ones with the smallest hashes of their texts get the greater number. Of up to
    ``MOST_PLACED`` documents in files only such rows are moved.
    """
    path = common.shared_dir(documents.sparkSession)
    copies = common.materialise(mix(documents, **how).select("doc_id", "source", "size", "copies"), f"{path}/copies")
    names = documents.columns
    due, size, n = common.fresh("due", names), common.fresh("size", names), common.fresh("n", names)
    own = [common.own_column(c, "d") for c in names]
    by_id = copies.groupBy("doc_id", "source").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"))

    def repeated(rows: DataFrame) -> DataFrame:
        each = rows.where(F.col(due) > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(due))).alias(n))
        return each.select(*[common.own_column(c) for c in names])

    out, told = None, with_copies(documents, by_id, due, f"{path}/places") if copies.count() <= MOST_PLACED else None
    if told is not None:
        out = repeated(told)
        if documents.sparkSession.read.parquet(f"{path}/places").where("exists(times, x -> x < 0)").isEmpty():
            return out
        documents = told.where(F.col(due) < 0).select(*[common.own_column(c) for c in names])
    met = F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("m.source"))
    single = documents.alias("d").join(by_id.where("rows = 1 AND total > 0").alias("m"), met)
    single = repeated(single.select(*own, F.col("m.total").alias(due)))
    out = single if out is None else out.unionByName(single)
    shared = common.materialise(by_id.where("rows > 1").select("doc_id", "source"), f"{path}/shared")
    if shared.isEmpty():
        return out
    by_size = copies.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows")).where("total > 0")
    some = by_size.alias("c").join(shared.alias("s"), F.expr("c.doc_id <=> s.doc_id AND c.source <=> s.source"), "left_semi")
    sized = documents.withColumn(size, word_count())
    rows = sized.alias("d").join(some.alias("m"), met & (common.own_column(size, "d") == F.col("m.size")))
    order = Window.partitionBy("m.doc_id", "m.source", "m.size").orderBy(F.xxhash64("d.text"), "d.text")
    each = F.expr("m.total div m.rows") + F.when(F.row_number().over(order) <= F.col("m.total") % F.col("m.rows"), 1).otherwise(0)
    return out.unionByName(repeated(rows.select(*own, each.cast("long").alias(due))))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
