"""Functions for SQL text."""

import hashlib
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from palimpsest.functions.chunking import cut_points
from palimpsest.functions.patterns import compile_pattern
from palimpsest.functions.textops import text_merge3, unified_diff
from palimpsest.model import CHUNK_AVG, CHUNK_MAX, CHUNK_MIN
from palimpsest.operators.logs import split_frames


@F.udtf(returnType="pos int, offset long, size int, hash string")
class FastCdc:
    """fastcdc(data, min, avg, max): a row for each chunk."""

    def eval(self, data: bytes, smallest: int = CHUNK_MIN, average: int = CHUNK_AVG, largest: int = CHUNK_MAX):
        data, at = bytes(data or b""), 0
        for pos, end in enumerate(cut_points(data, smallest, average, largest)):
            yield pos, at, end - at, hashlib.sha256(data[at:end]).hexdigest()
            at = end


@F.udtf(returnType="seq int, update binary")
class SplitFrames:
    """split_frames(log): a row for each update."""

    def eval(self, log: bytes):
        yield from enumerate(split_frames(bytes(log or b"")))


#: Functions that are SQL expressions themselves, so the optimizer sees through them.
SQL_FUNCTIONS = {
    "content_hash(data BINARY) RETURNS STRING": "sha2(data, 256)",
    "top_prefix(path STRING) RETURNS STRING": "regexp_extract(path, '^[^/]*/', 0)",
    "is_text_path(path STRING) RETURNS BOOLEAN": None,
    "sync_strategy(path STRING) RETURNS STRING": None,
    "classify_sync(base STRING, mine STRING, remote STRING) RETURNS STRING": "CASE WHEN mine = remote THEN 'no_change' WHEN mine = base THEN 'fast_forward' WHEN remote = base THEN 'local_only' ELSE 'conflict' END",
}


@F.pandas_udf(BooleanType())
def path_matches(path: pd.Series, patterns: pd.Series, dialect: pd.Series) -> pd.Series:
    """path_matches(path, patterns, dialect): whether any of an array of patterns matches, as ``patterns.path_matches``."""
    known: dict[tuple, list[re.Pattern]] = {}

    def match(p, rules, kind) -> bool:
        if p is None or rules is None:
            return False
        key = (kind, *rules)
        if key not in known:
            known[key] = [re.compile(r, re.S) for r in (compile_pattern(x, kind) for x in rules if x is not None) if r]
        norm = re.sub(r"^\.?/" if kind == "client" else r"^(?:\./)*/*", "", p)
        return bool(norm) and any(r.search(norm) for r in known[key])

    return pd.Series([match(*row) for row in zip(path, patterns, dialect, strict=True)], dtype=bool)


def register_functions(spark: SparkSession) -> None:
    """content_hash, top_prefix, is_text_path, path_matches, sync_strategy, classify_sync, text_merge3, unified_diff, fastcdc,
    split_frames."""
    from palimpsest.functions.paths import TEXT_EXTENSIONS
    from palimpsest.functions.patterns import glob_regex
    from palimpsest.functions.rules import DEFAULT_RULES

    quoted = ", ".join(f"'{x}'" for x in TEXT_EXTENSIONS)
    arms = " ".join(f"WHEN substring_index(path, '/', -1) RLIKE r'{glob_regex(g)}' THEN '{s}'" for g, s in DEFAULT_RULES)
    bodies = {"is_text_path": f"lower(substring_index(path, '.', -1)) IN ({quoted})", "sync_strategy": f"CASE {arms} END"}
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body or bodies[head.split('(')[0]]}")
    spark.udf.register("path_matches", path_matches)
    spark.udf.register("text_merge3", text_merge3())
    spark.udf.register("unified_diff", unified_diff())
    spark.udtf.register("fastcdc", FastCdc)
    spark.udtf.register("split_frames", SplitFrames)
