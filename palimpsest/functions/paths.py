"""Paths and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of files that are merged by lines.
TEXT_EXTENSIONS = ("md", "txt", "css", "json", "js", "ts", "html", "xml", "yaml", "yml", "toml", "csv", "canvas", "excalidraw", "svg", "tex", "bib", "org", "rst")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_prefix(path: Column | str) -> Column:
    """The first directory with its slash; empty for files at the root."""
    return F.regexp_extract(col(path), r"^[^/]*/", 0)


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """What follows the last dot, or the whole path without one; lower case."""
    return F.lower(F.substring_index(col(path), ".", -1))


def is_text_path(path: Column | str) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def segments(path: Column | str) -> Column:
    return F.split(col(path), "/")


def short_id(device: Column | str, n: int = 12) -> Column:
    return F.substring(col(device), 1, n)


def is_hash(text: Column | str) -> Column:
    """64 hexadecimal digits; null is not."""
    return F.coalesce(col(text).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


#: Fixed value: the characters that a device's name may not have in a file name.
UNSAFE = r'[\\/:*?"<>|()]'


def conflict_copy_path(path: Column | str, device: Column | str, when: Column) -> Column:
    """The name of the copy that keeps the losing side: ``stem (conflict device date time).ext``.

    A name that starts with its only dot has no extension. ``when`` is a timestamp.
    """
    path = col(path)
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    stem = F.substr(path, F.lit(1), F.length(path) - F.length(ext))
    name = F.trim(F.regexp_replace(col(device), UNSAFE, "-"))
    name = F.when(name == "", "device").otherwise(name)
    return F.concat(stem, F.lit(" (conflict "), name, F.lit(" "), F.date_format(when, "yyyy-MM-dd HHmm"), F.lit(")"), ext)


#: Fixed value: what the names of conflict copies look like.
CONFLICT_COPY = r"^(.*) \(conflict [^)]+\)(\.[^./]+)?$"


def conflict_original(path: Column | str) -> Column:
    """The path whose conflict copy this is; null if it is none."""
    path = col(path)
    return F.when(path.rlike(CONFLICT_COPY), F.concat(F.regexp_extract(path, CONFLICT_COPY, 1), F.regexp_extract(path, CONFLICT_COPY, 2)))


def pattern_list(text: Column | str) -> Column:
    """Patterns from a form's text: split at line ends and commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(col(text), "[\n,]"), F.trim), lambda p: p != "")


def html_escape(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
