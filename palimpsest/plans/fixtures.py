"""Snapshots derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What the two dialects call the same function.
SPARK = {"sha": "sha2({}, 256)", "bytes": "octet_length({})"}
DUCKDB = {"sha": "sha256({})", "bytes": "strlen({})"}

#: Some of the English sources become folders of their own, whose history covers every arm of the merge by prefix.
FOLDERS = {"src1": "en-same", "src2": "en-a", "src3": "en-b", "src4": "en-new-a", "src5": "en-new-b", "src6": "en-new-both", "src7": "en-del-a", "src8": "en-del-b", "src9": "en-gone"}

_TOP = "CASE WHEN doc_id % 50 = 0 THEN '' " + " ".join(f"WHEN lang = 'en' AND source = '{s}' THEN '{f}'" for s, f in FOLDERS.items()) + " ELSE lang END"
SRC = f"""
SELECT doc_id, lang, source, top, m, t,
       CASE WHEN top = '' THEN '' ELSE top || '/' || source || '/' END || lpad(CAST(doc_id AS STRING), 8, '0') || '.md' AS path
FROM (SELECT doc_id, lang, source, {_TOP} AS top, 1700000000000 + doc_id * 1000 AS m, coalesce(text, '') AS t FROM documents)
"""
_IN_BASE = "doc_id % 10 <> 9"
_NEW = "top IN ('en-new-a', 'en-new-b', 'en-new-both')"
SIDES = {
    "base": {"where": f"{_IN_BASE} AND NOT {_NEW}", "text": "t", "mtime": "m"},
    "a": {
        "where": f"""top NOT IN ('es', 'en-new-b', 'en-del-a', 'en-gone') AND CASE
            WHEN top IN ('en-same', 'en-b', 'en-del-b') THEN {_IN_BASE}
            WHEN {_NEW} THEN true
            ELSE (doc_id % 10 <> 9 OR doc_id % 3 = 0) AND NOT (doc_id % 13 = 0 AND top <> 'fr') END""",
        "text": """CASE WHEN top IN ('en-same', 'en-b', 'en-del-b', 'fr') THEN t
            WHEN top = 'en-a' THEN t || ' [A]'
            WHEN doc_id % 70 = 0 THEN t || ' [AB]'
            WHEN doc_id % 7 = 0 THEN t || ' [A]'
            WHEN doc_id % 10 = 9 AND doc_id % 12 <> 9 THEN t || ' [A]' ELSE t END""",
        "mtime": """CASE WHEN top IN ('en-same', 'en-b', 'en-del-b') THEN m WHEN top = 'fr' AND doc_id % 7 = 0 THEN m + 1
            WHEN doc_id % 7 = 0 THEN m + 5 ELSE m END""",
    },
    "b": {
        "where": f"""top NOT IN ('fr', 'en-new-a', 'en-del-b', 'en-gone') AND CASE
            WHEN top IN ('en-same', 'en-a', 'es') THEN {_IN_BASE}
            WHEN {_NEW} THEN true
            ELSE (doc_id % 10 <> 9 OR doc_id % 4 = 1) AND NOT doc_id % 11 = 0 END""",
        "text": """CASE WHEN top IN ('en-same', 'en-a', 'es') THEN t
            WHEN top = 'en-del-a' THEN t || ' [B]'
            WHEN doc_id % 70 = 0 THEN t || ' [AB]'
            WHEN doc_id % 5 = 0 THEN t || ' [B]'
            WHEN doc_id % 10 = 9 AND doc_id % 12 <> 9 THEN t || ' [B]' ELSE t END""",
        "mtime": "CASE WHEN top NOT IN ('en-same', 'en-a', 'es') AND doc_id % 5 = 0 THEN m + 7 ELSE m END",
    },
}


def side_sql(side: str, names: dict[str, str], source: str) -> str:
    """Entries (path, hash, mtime_ms, size_bytes) of a side, with doc_id, top and content."""
    s = SIDES[side]
    return f"""SELECT doc_id, top, path, {names["sha"].format("x")} AS hash, mtime AS mtime_ms, CAST({names["bytes"].format("x")} AS BIGINT) AS size_bytes, x AS content
        FROM (SELECT *, {s["text"]} AS x, {s["mtime"]} AS mtime FROM {source} WHERE {s["where"]})"""


def oracle_ctes() -> str:
    """``WITH`` src, base, a, b for DuckDB; queries go on with more tables or a SELECT."""
    sides = ",\n".join(f"{s} AS ({side_sql(s, DUCKDB, 'src')})" for s in SIDES)
    return f"WITH src AS ({SRC}),\n{sides}"


class Snapshots:
    """The derived snapshots: ``src``, and ``base``, ``a``, ``b`` as entries; ``blobs`` of a side has hash and data."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        self.src = spark.sql(SRC.replace("FROM documents", "FROM {documents}"), documents=self.docs)

    def full(self, side: str) -> DataFrame:
        return self.spark.sql(side_sql(side, SPARK, "{src}"), src=self.src)

    def __getattr__(self, side: str) -> DataFrame:
        if side not in SIDES:
            raise AttributeError(side)
        return self.full(side).select("path", "hash", "mtime_ms", "size_bytes")

    def blobs(self, side: str) -> DataFrame:
        return self.full(side).selectExpr("hash", "CAST(content AS BINARY) AS data")
