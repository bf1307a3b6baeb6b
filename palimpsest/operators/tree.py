"""Merkle trees over entries: prefix groups, leaves of fixed size, nodes and a root, as three chained aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.paths import top_prefix
from palimpsest.model import ENTRY_COLS, LEAF_SIZE


def entry_line() -> Column:
    return F.concat_ws("\n", "path", "hash", F.col("mtime_ms").cast("string"), F.col("size_bytes").cast("string"))


def path_cells(paths: DataFrame, cells: int) -> Column:
    """The number of the cell of ``path``: ranges between about ``cells`` paths that their own hashes pick.

    The same table gives the same cells on every run and in every plan; the driver holds the picked paths.
    """
    n = paths.count()
    step = max(1, n // max(1, cells))
    picked = [] if n < 2 * cells else sorted(r.path for r in paths.where(F.pmod(F.xxhash64("path"), F.lit(step)) == 0).select("path").collect())
    if not picked:
        return F.lit(0)
    # by code point, as Spark orders strings; a binary search, so many cells cost no more than few
    edges = [p.encode() for p in picked]

    @F.pandas_udf("int")
    def cell(path):
        import bisect

        import pandas as pd

        return pd.Series([bisect.bisect_right(edges, p.encode()) for p in path], dtype="int32")

    return cell("path")


def leaf_numbers(entries: DataFrame, leaf_size: int = LEAF_SIZE, cells: int | None = None) -> DataFrame:
    """The entries with prefix and leaf_no: leaves are runs of ``leaf_size`` entries of a prefix, by path.

    A prefix may hold most of the entries, so no task ranks a whole prefix: an entry's rank is the number of entries in
    the prefix's cells before its own, plus its rank within the cell.
    """
    own = entries.select(*ENTRY_COLS).withColumn("prefix", top_prefix("path"))
    cells = cells or 2 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.withColumn("cell", path_cells(own.select("path"), cells))
    counts = own.groupBy("prefix", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("prefix", "cell", (F.sum("n").over(Window.partitionBy("prefix").orderBy("cell")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("prefix", "cell").orderBy("path"))
    ranked = own.withColumn("local", local).join(before, ["prefix", "cell"])
    return ranked.withColumn("leaf_no", F.floor((F.col("before") + F.col("local") - 1) / leaf_size).cast("long")).drop("before", "local", "cell")


@dataclass
class Tree:
    """The nodes of one snapshot. ``leaves`` carry their entries, ``prefixes`` the hash of each group, ``root`` is a row."""

    leaves: DataFrame
    prefixes: DataFrame
    root: DataFrame


def build_leaves(entries: DataFrame, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """prefix, leaf_no, hash, n and entries (sorted by path, ``leaf_size`` at most)."""
    numbered = leaf_numbers(entries, leaf_size).withColumn("line", F.concat(entry_line(), F.lit("\n")))
    rows = numbered.groupBy("prefix", "leaf_no").agg(F.array_sort(F.collect_list(F.struct("path", "hash", "mtime_ms", "size_bytes", "line"))).alias("e"))
    return rows.select(
        "prefix",
        "leaf_no",
        F.sha2(F.array_join(F.transform("e", lambda x: x["line"]), ""), 256).alias("hash"),
        F.size("e").cast("long").alias("n"),
        F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in ENTRY_COLS])).alias("entries"),
    )


def build_prefixes(leaves: DataFrame) -> DataFrame:
    """prefix, prefix_hash, leaves, files: a single leaf's hash is its prefix's; else that of the ordered list."""
    by = F.array_sort(F.collect_list(F.struct("leaf_no", "hash")))
    rows = leaves.groupBy("prefix").agg(by.alias("l"), F.sum("n").alias("files"))
    node = F.sha2(F.array_join(F.transform("l", lambda x: F.concat(x["leaf_no"].cast("string"), F.lit(":"), x["hash"], F.lit("\n"))), ""), 256)
    return rows.select("prefix", F.when(F.size("l") == 1, F.col("l")[0]["hash"]).otherwise(node).alias("prefix_hash"), F.size("l").cast("long").alias("leaves"), "files")


def build_root(prefixes: DataFrame) -> DataFrame:
    """One row: root_hash (prefixes and their hashes only, so equal contents have equal roots), total_files, prefixes."""
    rows = prefixes.agg(F.array_sort(F.collect_list(F.struct("prefix", "prefix_hash"))).alias("p"), F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["prefix"], F.lit("\n"), x["prefix_hash"], F.lit("\n"))), "")
    return rows.select(F.sha2(text, 256).alias("root_hash"), F.col("total_files").cast("long").alias("total_files"), F.size("p").cast("long").alias("prefixes"))


def build_tree(entries: DataFrame, leaf_size: int = LEAF_SIZE) -> Tree:
    leaves = build_leaves(entries, leaf_size)
    prefixes = build_prefixes(leaves)
    return Tree(leaves, prefixes, build_root(prefixes))


def flatten(leaves: DataFrame) -> DataFrame:
    """The entries of a tree's leaves."""
    return leaves.select(F.explode("entries").alias("e")).select(*[f"e.{c}" for c in ENTRY_COLS])


def apply_changes(entries: DataFrame, upserts: DataFrame, deletes: DataFrame, order: str | None = None) -> DataFrame:
    """The entries after the deletes and then the upserts; of several upserts of a path the last by ``order`` wins."""
    if order:
        last = upserts.groupBy("path").agg(F.max_by(F.struct("hash", "mtime_ms", "size_bytes"), order).alias("e")).select("path", "e.*")
    else:
        last = upserts.select(*ENTRY_COLS).dropDuplicates(["path"])
    gone = deletes.select("path").unionByName(last.select("path")).distinct()
    return entries.select(*ENTRY_COLS).join(gone, "path", "left_anti").unionByName(last.select(*ENTRY_COLS))


def update_tree(tree: Tree, upserts: DataFrame, deletes: DataFrame, leaf_size: int = LEAF_SIZE, order: str | None = None) -> Tree:
    """The tree after the changes: only the prefixes that they touch are cut into leaves again."""
    touched = upserts.select(top_prefix("path").alias("prefix")).unionByName(deletes.select(top_prefix("path").alias("prefix"))).distinct()
    old = tree.leaves.join(touched, "prefix", "left_semi")
    new = build_leaves(apply_changes(flatten(old), upserts, deletes, order), leaf_size)
    kept = tree.prefixes.join(touched, "prefix", "left_anti")
    prefixes = kept.unionByName(build_prefixes(new))
    return Tree(tree.leaves.join(touched, "prefix", "left_anti").unionByName(new), prefixes, build_root(prefixes))
