"""URL filtering by rules and, where no rule fits, gradient-boosted trees over lexical features.

The trees are learned from labelled urls: those that a rule decides, with the rule's verdict. Features are lengths,
depth, digit ratio, entropy, parameter counts and the labelled share of blocked urls by host suffix; while the trees are
fitted, a url's suffix shares come from the other folds' labels, so its own label never explains itself. ``evaluate``
holds a fold of the labelled urls out and tells what the trees make of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): the rule's host up to its first slash, then its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled urls that the trees are fitted on, at most.
SAMPLE_URLS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, PRIOR = 40, 3, 32, 0.2, 5, 10.0
#: Folds of the labelled urls; features: ten lexical ones, then three suffix shares.
FOLDS, FEATURES = 5, 13
LEXICAL, SUFFIXES = slice(0, 10), slice(10, 13)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- rules ------------------------------------------------------------------------------------------------------------


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits. Equally long rules: the first given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


# --- features -----------------------------------------------------------------------------------------------------------


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """The host's last label, its last two, and the last with the path's first folder."""
    names = host.split(".")
    return names[-1], ".".join(names[-2:]), f"{names[-1]}/{path[1:].partition('/')[0] if path.count('/') > 1 else ''}"


def lexical(url: str, host: str, path: str) -> tuple[float, ...]:
    """Length, host length, host labels, depth, path length, digit ratio, entropy, parameters, dashes, fragment; host and
    path are those of ``host_path``."""
    n = len(url)
    counts = np.bincount(np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8)) if n else np.empty(0)
    share = counts[counts > 0] / max(1, counts.sum())
    digits = sum(c.isdigit() for c in url)
    query = url.partition("?")[2].partition("#")[0]
    return (n, len(host), host.count(".") + bool(host), path.count("/"), len(path), digits / max(1, n), float(-(share * np.log2(share)).sum()), query.count("=") + query.count("&"), url.count("-"), float("#" in url))


# --- trees --------------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over features cut into quantile bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value by node

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1) if len(self.edges) else np.empty((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b, score = self.binned(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = _sigmoid(score)
            tree = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._value(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes = 2 ** (DEPTH + 1)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        at = np.ones(len(b), np.int64)
        for node in range(1, nodes):
            own = np.flatnonzero(at == node)
            value[node] = RATE * g[own].sum() / (h[own].sum() + 1.0) if len(own) else 0.0
            if node >= nodes // 2 or len(own) < 2 * LEAST_LEAF:
                continue
            best = 1e-6
            for k in range(b.shape[1]):
                gs, hs, ns = (np.bincount(b[own, k], w, BINS + 1).cumsum() for w in (g[own], h[own], None))
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                gain[(ns < LEAST_LEAF) | (ns[-1] - ns < LEAST_LEAF)] = 0
                if gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), k, int(gain.argmax())
            if feature[node] >= 0:
                at[own] = 2 * node + (b[own, feature[node]] > cut[node])
        return feature, cut, value

    @staticmethod
    def _value(tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.ones(len(b), np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + (b[np.arange(len(b)), np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of ``block``."""
        score, b = np.full(len(x), self.base), self.binned(x)
        for tree in self.trees:
            score += self._value(tree, b)
        return _sigmoid(score)


@dataclass
class Labelled:
    """Labelled urls: ``blocked`` is 1.0 or 0.0, ``fold`` a number below ``FOLDS`` that the url alone decides."""

    urls: list[str]
    hosts: list[str]
    paths: list[str]
    blocked: np.ndarray

    @property
    def fold(self) -> np.ndarray:
        return np.array([crc32(u.encode("utf-8", "surrogatepass")) % FOLDS for u in self.urls], np.int64)

    def some(self, keep: np.ndarray) -> Labelled:
        at = np.flatnonzero(keep)
        return Labelled([self.urls[i] for i in at], [self.hosts[i] for i in at], [self.paths[i] for i in at], self.blocked[at])


def suffix_shares(own: Labelled) -> tuple[float, dict[str, float]]:
    """The share of blocked urls, in all and by suffix; rare suffixes are drawn to that of all."""
    share = float(own.blocked.mean()) if len(own.blocked) else 0.0
    seen: dict[str, list[float]] = {}
    for h, p, y in zip(own.hosts, own.paths, own.blocked, strict=True):
        for s in suffixes(h, p):
            t = seen.setdefault(s, [0.0, 0.0])
            t[0], t[1] = t[0] + y, t[1] + 1
    return share, {s: (a + PRIOR * share) / (n + PRIOR) for s, (a, n) in seen.items()}


@dataclass
class UrlModel:
    """``columns`` are the features that the trees look at; all unless an evaluation leaves some out."""

    trees: Boosted
    share: float
    by_suffix: dict[str, float]
    columns: slice = slice(None)

    def shares(self, host: str, path: str) -> tuple[float, float, float]:
        """The shares of a url's suffixes; one that no label has is taken from a shorter one."""
        last, two, folder = suffixes(host, path)
        own = self.by_suffix.get(last, self.share)
        return own, self.by_suffix.get(two, own), self.by_suffix.get(folder, own)

    def features(self, urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        rows = [(*lexical(u or "", h, p), *self.shares(h, p)) for u, h, p in zip(urls, hosts, paths, strict=True)]
        return np.array(rows, np.float64).reshape(len(rows), FEATURES)[:, self.columns]

    def predict(self, urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """The probability of ``block``."""
        return self.trees.predict(self.features(urls, hosts, paths))

    @classmethod
    def learn(cls, own: Labelled, columns: slice = slice(None)) -> UrlModel:
        fold, x = own.fold, np.empty((len(own.urls), FEATURES))[:, columns]
        for k in np.unique(fold):
            inside, others = own.some(fold == k), own.some(fold != k)
            x[fold == k] = cls(Boosted(), *suffix_shares(others), columns).features(inside.urls, inside.hosts, inside.paths)
        return cls(Boosted().fit(x, own.blocked), *suffix_shares(own), columns)


def evaluate(own: Labelled, columns: slice = slice(None)) -> dict[str, float]:
    """Accuracy, and the recall and precision of ``block``, on the fold that is held out of the fit."""
    out = own.fold == 0
    test, model = own.some(out), UrlModel.learn(own.some(~out), columns)
    told, truth = model.predict(test.urls, test.hosts, test.paths) >= 0.5, test.blocked > 0
    hit = float((told & truth).sum())
    return {"urls": float(len(truth)), "accuracy": float((told == truth).mean()) if len(truth) else 0.0, "recall": hit / max(1.0, float(truth.sum())), "precision": hit / max(1.0, float(told.sum()))}


def labelled_sample(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = SAMPLE_URLS) -> list:
    """Rows (url, host, path, verdict) of ``most`` urls at most that a rule decides: distinct, those of the smallest hashes.

    Only hashes low enough to leave about twice the sample go on, so what is sorted and sent doesn't grow with the table.
    The share is of distinct urls, however often each is repeated; should it leave too few, all are taken.
    """
    host, path = host_path(F.col("url"))
    _, verdict = ruled(host, path, rules)
    rows = pages.select("url", host.alias("host"), path.alias("path"), verdict.alias("verdict")).where("verdict IS NOT NULL")
    share = 2.0 * most / max(1, rows.agg(F.approx_count_distinct("url")).first()[0])
    least = lambda some: some.distinct().orderBy(F.xxhash64("url"), "url").limit(most).collect()
    got = least(rows.where(F.shiftrightunsigned(F.xxhash64("url"), 11) / F.lit(2.0**53) < share)) if share < 1 else []
    return got if len(got) == most else least(rows)


def labelled(rows: list) -> Labelled:
    """The sample as the trees learn it, in an order of its own."""
    rows = sorted(rows, key=lambda r: r.url)
    return Labelled([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], np.array([r.verdict == "block" for r in rows], float))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample_urls: int = SAMPLE_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (the trees' probability where no rule fits, else null) a page.

    Null urls and urls without ``://`` have an empty host and path, and are judged by the trees as the empty url or as
    they are. Without labelled urls everything unruled is allowed. Repeated rows get equal answers; an empty table gives
    no rows; other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    model = UrlModel.learn(labelled(labelled_sample(own, rules, sample_urls)))

    @F.pandas_udf("double")
    def score(url, host, path):
        import pandas as pd

        return pd.Series(model.predict([u if isinstance(u, str) else None for u in url], list(host), list(path)))

    host, path = host_path(F.col("url"))
    rows = own.withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    decided = rows.where("rule IS NOT NULL").withColumn("block_score", F.lit(None).cast("double"))
    unruled = rows.where("rule IS NULL").withColumn("block_score", score("url", "host", "path"))
    both = decided.unionByName(unruled)
    by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("said", by_trees).alias("verdict"), "block_score")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
