"""Schemas, constants and enumerations of the snapshot model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Stands for "absent" wherever a hash is wanted: 64 zeros, never null.
ZERO_HASH = "0" * 64
#: Entries of one leaf.
LEAF_SIZE = 1000
#: Files of this many bytes or more are chunked; texts below it may be merged by lines.
CHUNK_THRESHOLD = 1 << 20
#: Smallest, average and largest chunk.
CHUNK_MIN, CHUNK_AVG, CHUNK_MAX = 64 << 10, 256 << 10, 1 << 20
#: Bytes of a side above which no line diff is shown.
DIFF_LIMIT = 2 << 20
#: Times in milliseconds.
ONLINE_MS, TOUCH_MS, PRESENCE_MS, DEBOUNCE_MS = 300_000, 30_000, 90_000, 3_000
ENROLL_MS, TICKET_MS, BYPASS_MS, REVOKED_MS = 600_000, 600_000, 900_000, 30 * 86_400_000
#: The guard's defaults: mtime regressions allowed, clock skew, per cent of the files, floor.
GUARD_REGRESSIONS, GUARD_SKEW_MS, GUARD_PCT, GUARD_FLOOR = 25, 43_200_000, 25, 200
#: A device forgets others' presence that is older; vaults that one subscription may name.
PEER_MS, MOST_VAULTS = 120_000, 16
HISTORY_LIMIT, STATS_LIMIT, JOURNAL_CAP, MAX_FRAME = 50, 300, 10_000, 4 << 20

ENTRY = T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("mtime_ms", T.LongType()), T.StructField("size_bytes", T.LongType())])
ENTRY_COLS = [f.name for f in ENTRY.fields]
DELTA_COLS = ["action", "path", "old_path", "hash", "size", "mtime_ms"]
