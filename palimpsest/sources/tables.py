"""Readers and writers of what the model keeps in files: objects by hash, manifests, journals, registries, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.paths import top_prefix

MANIFEST = "total_size long, chunks array<struct<hash: string, offset: long, size: int>>"
JOURNAL = "action string, path string, oldPath string, ts long, synced boolean"
DEVICE = "name string, device_id string, enrolled_at long, last_seen long, vaults array<string>, bearer_token string"
SYNC_BASE = "lastSyncTimestamp long, entries map<string, struct<hash: string, mtime: long, size: long, treeMtime: long>>"


def object_path(hash_: str = "hash"):
    """Where an object lies under its store: two digits, a slash, the other digits."""
    return F.concat_ws("/", F.substring(hash_, 1, 2), F.substring(hash_, 3, 62))


def read_objects(spark: SparkSession, store: str) -> DataFrame:
    """hash, data of the files ``<2 digits>/<62 digits>`` below a folder; other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store)
    place = F.regexp_extract("path", r"([0-9a-f]{2})/([0-9a-f]{62})$", 0)
    return files.select(F.replace(place, F.lit("/"), F.lit("")).alias("hash"), F.col("content").alias("data")).where("hash <> ''")


def file_stats(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), mtime in ms and size of all files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    top = folder.rstrip("/").split("://")[-1]
    return files.select(F.substring_index("path", f"{top}/", -1).alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


def dir_stats(spark: SparkSession, folder: str) -> DataFrame:
    return file_stats(spark, folder).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))


def read_manifests(spark: SparkSession, store: str) -> DataFrame:
    """file_hash, total_size, chunks from JSON files by hash; hashes inside are hexadecimal."""
    texts = read_objects(spark, store).select(F.col("hash").alias("file_hash"), F.from_json(F.col("data").cast("string"), MANIFEST).alias("m"))
    return texts.select("file_hash", "m.*").where("chunks IS NOT NULL")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A journal of one JSON object a line; lines that aren't are left out."""
    rows = spark.read.schema(f"{JOURNAL}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL AND action IS NOT NULL").drop("_bad")


def read_sync_base(spark: SparkSession, path: str) -> DataFrame:
    """path, hash, mtime, size, tree_mtime, last_sync of a JSON file of the last synced state."""
    rows = spark.read.schema(SYNC_BASE).option("multiLine", "true").json(path)
    each = rows.select("lastSyncTimestamp", F.explode("entries").alias("path", "e"))
    return each.select("path", "e.hash", "e.mtime", "e.size", F.col("e.treeMtime").alias("tree_mtime"), F.col("lastSyncTimestamp").alias("last_sync"))


def read_devices(spark: SparkSession, folder: str) -> DataFrame:
    """The registry's JSON files but those of tokens, without corrupt ones, last seen first."""
    rows = spark.read.schema(f"{DEVICE}, _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.where("_bad IS NULL AND device_id IS NOT NULL").drop("_bad").orderBy(F.desc("last_seen"), "device_id")


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries as Parquet in folders by prefix, so that a diff of few prefixes reads few folders."""
    rows = entries.withColumn("prefix", top_prefix("path"))
    rows.repartition("prefix", F.pmod(F.xxhash64("path"), F.lit(16))).write.mode("overwrite").partitionBy("prefix").parquet(path)


def put_objects(puts: DataFrame, store: DataFrame) -> DataFrame:
    """The store (hash, data) with the puts that it lacks."""
    new = puts.select("hash", "data").dropDuplicates(["hash"]).join(store.select("hash"), "hash", "left_anti")
    return store.select("hash", "data").unionByName(new)


def content(wanted: DataFrame, blobs: DataFrame, whole: DataFrame) -> DataFrame:
    """hash, data of wanted contents: the blob, or the file that its manifest puts together (``whole``: file_hash, data)."""
    met = wanted.select("hash").distinct().join(blobs.select("hash", F.col("data").alias("b")).dropDuplicates(["hash"]), "hash", "left")
    met = met.join(whole.select(F.col("file_hash").alias("hash"), F.col("data").alias("w")), "hash", "left")
    return met.select("hash", F.coalesce("b", "w").alias("data"))
