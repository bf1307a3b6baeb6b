"""Ignore patterns and globs, compiled when the plan is made to one regular expression each.

Two dialects differ where their users differ. ``client``: ``*`` and ``?`` within a segment, ``**`` across, wildcards in
anchored patterns too, and one leading ``./`` or ``/`` of the path is dropped. ``server``: only ``*``, anchored patterns
are literal, and all leading ``./`` and then ``/`` are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.paths import col

#: What a client ignores unless told otherwise.
DEFAULT_IGNORE = ("target/", "node_modules/", ".git/", ".DS_Store", "Thumbs.db", "*.tmp")


def _quote(text: str) -> str:
    return "".join(rf"\{c}" if c in r"\^$.|+()[]{}*?-&~#" else c for c in text)


def _client_glob(glob: str) -> str:
    kinds = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(kinds.get(t) or _quote(t) for t in re.findall(r"\*\*|.", glob, re.S))


def _server_glob(glob: str) -> str:
    """Literals between stars match as early as they can, the last one ends the segment."""
    if "*" not in glob:
        return _quote(glob)
    first, *middle, last = glob.split("*")
    body = _quote(first) + "".join(f"[^/]*?{_quote(m)}" for m in middle if m)
    if not last:
        return f"{body}[^/]*"
    # the last literal ends the segment at or after where the middle's shortest match ended
    return f"{body}[^/]*{_quote(last)}"


def compile_pattern(pattern: str, dialect: str = "client") -> str | None:
    """A regular expression over the normalised path; None for blank lines and comments."""
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    only_dir = p.endswith("/")
    p = p[:-1] if only_dir else p
    p = p[1:] if p.startswith("/") else p
    if not p:
        return None
    if "/" in p:
        return f"^{_client_glob(p) if dialect == 'client' else _quote(p)}(?:/.*)?$"
    glob = (_client_glob if dialect == "client" else _server_glob)(p)
    if dialect == "client" and ".*" in glob:
        # ``**`` in a floating pattern is matched against single segments
        glob = re.sub(r"(?<!\\)\.\*", "[^/]*", glob)
    return f"(?:^|/){glob}/" if only_dir else f"(?:^|/){glob}(?:/|$)"


def normalise(path: Column | str, dialect: str = "client") -> Column:
    return F.regexp_replace(col(path), r"^\.?/" if dialect == "client" else r"^(?:\./)*/*", "")


def path_matches(path: Column | str, patterns: Sequence[str], dialect: str = "client") -> Column:
    """True if any pattern matches; false for null and empty paths and without rules."""
    rules = [f"(?s){r}" for r in (compile_pattern(p, dialect) for p in patterns) if r]
    if not rules:
        return F.lit(False)
    norm = normalise(path, dialect)
    return F.coalesce(reduce(lambda a, b: a | b, (norm.rlike(r) for r in rules)) & (norm != ""), F.lit(False))


def glob_regex(glob: str) -> str:
    """A glob over a whole name: ``*`` is any characters, slashes too; ``?`` is one character."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or _quote(c) for c in glob) + "$"
