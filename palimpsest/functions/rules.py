"""What happens to a file on conflict, by its name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.paths import basename
from palimpsest.functions.patterns import glob_regex

#: The default rules, in their order; the first that fits decides.
LOCAL_ONLY = ("*.sqlite", "*.sqlite-wal", "*.sqlite-shm", ".DS_Store", "thumbs.db")
IMMUTABLE = ("*.png", "*.jpg", "*.jpeg", "*.webp", "*.gif", "*.bmp", "*.svg", "*.pdf", "*.mp3", "*.mp4", "*.wav", "*.ogg", "*.flac", "*.zip", "*.tar", "*.gz")
DEFAULT_RULES = (*((g, "local-only") for g in LOCAL_ONLY), *((g, "immutable") for g in IMMUTABLE), ("*", "conflict-copy"))


def sync_strategy(path: Column | str, rules: Sequence[tuple[str, str]] = DEFAULT_RULES) -> Column:
    name, out = basename(path), F.lit("conflict-copy")
    for glob, strategy in reversed(rules):
        out = F.when(name.rlike(glob_regex(glob)), strategy).otherwise(out)
    return out


def is_local_only(path: Column | str) -> Column:
    return sync_strategy(path) == "local-only"


def classify_sync(base: Column, local: Column, remote: Column) -> Column:
    """What a file needs, from its three hashes; the first that holds."""
    return F.when(local == remote, "no_change").when(local == base, "fast_forward").when(remote == base, "local_only").otherwise("conflict")
