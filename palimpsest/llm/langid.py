"""Language identification by rank-order profiles.

A profile is the list of the ``TOP`` most frequent letter n-grams (one to three letters, words padded with a blank),
most frequent first, ties by the n-gram's code. A document takes the language whose profile is nearest to its own by
out-of-place distance: the sum of rank differences, ``TOP`` for an n-gram that the language's profile lacks.

Counting is vectorised over whole batches of texts; texts of any length go in slices whose counts are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

TOP, SLICE = 300, 1 << 17
#: Documents of each language that the profiles are fitted on: the bound of the labelled sample.
SAMPLE_DOCS = 400
#: Languages that are learned, at most: the bound of what the driver holds.
MOST_LANGS = 1000
#: Least score of a document that the pipeline keeps; texts below it resemble no learned language.
LEAST_SCORE = 0.1
_GRAM_BITS = 40
_BREAK = re.compile(r"[\W\d_]")


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter plus one, or 1 for everything else."""
    out = np.ones(0x110000, np.int32)
    for c in range(0x32400):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low if len(low) == 1 else x) + 1
    return out


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        m = _BREAK.search(text, at + SLICE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _keys(docs: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (doc << 40 | n-gram) keys of these texts and their counts."""
    x = letters()[np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
    doc = np.repeat(np.array([docs[0], *docs], np.int64), [1, *(len(t) + 1 for t in texts)])
    keep = np.r_[True, (x[1:] != 1) | (x[:-1] != 1)]
    x, doc = x[keep], doc[keep]
    letter = x != 1
    grams = [x[letter]]
    of = [doc[letter]]
    if len(x) > 1:
        a, b = x[:-1], x[1:]
        grams.append(a << 21 | b)
        of.append(np.where(a == 1, doc[1:], doc[:-1]))
    if len(x) > 2:
        mid = letter[1:-1]
        grams.append((x[:-2][mid] << 42) | (x[1:-1][mid] << 21) | x[2:][mid])
        of.append(doc[1:-1][mid])
    g = np.concatenate(grams).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return _tally(np.concatenate(of).view(np.uint64) << np.uint64(_GRAM_BITS) | g >> np.uint64(64 - _GRAM_BITS))


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[start], np.diff(np.r_[start, len(keys)]) if counts is None else np.add.reduceat(counts, start)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parallel arrays (document, n-gram code, count), sorted by document and code."""
    parts, docs, held, size = [], [], [], 0
    for i, text in enumerate(texts):
        for piece in _slices(text or ""):
            if not piece:
                continue
            docs.append(i)
            held.append(piece)
            size += len(piece)
            if size >= SLICE:
                parts.append(_keys(docs, held))
                docs, held, size = [], [], 0
    if held:
        parts.append(_keys(docs, held))
    if not parts:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    elif len(parts) == 1:
        keys, counts = parts[0]
    else:
        keys, counts = _tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    return (keys >> np.uint64(_GRAM_BITS)).astype(np.int64), (keys & np.uint64((1 << _GRAM_BITS) - 1)).astype(np.int64), counts


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank from 0) of each document's TOP most frequent n-grams."""
    order = np.lexsort((gram, -count, doc))
    doc, gram = doc[order], gram[order]
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    rank = np.arange(len(doc)) - np.repeat(start, np.diff(np.r_[start, len(doc)]))
    keep = rank < TOP
    return doc[keep], gram[keep], rank[keep]


@dataclass
class Profiles:
    langs: list[str]
    grams: np.ndarray  # sorted n-gram codes of all profiles
    ranks: np.ndarray  # languages x n-grams; TOP where a profile lacks the n-gram

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Profiles:
        langs = sorted({r[0] for r in rows})
        grams = np.unique(np.array([r[1] for r in rows], np.int64))
        ranks = np.full((len(langs), len(grams)), TOP, np.int64)
        for lang, gram, rank in rows:
            ranks[langs.index(lang), np.searchsorted(grams, gram)] = rank
        return cls(langs, grams, ranks)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """For each text the nearest language and the score: one minus its share of the greatest distance.

        Texts are counted a few at a time, by their length, so memory doesn't follow the number of texts.
        """
        pred, score, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < SLICE):
                size += len(texts[end] or "")
                end += 1
            some = self._judge(texts[at:end])
            pred += some[0]
            score.append(some[1])
            at = end
        return pred, np.concatenate(score) if score else np.empty(0)

    def _judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        doc, gram, rank = ranked(*gram_counts(texts))
        n = np.bincount(doc, minlength=len(texts))
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        dist = np.stack([np.bincount(doc, np.where(known & (r[at] < TOP), np.abs(r[at] - rank), TOP), len(texts)) for r in self.ranks])
        best = dist.argmin(0)
        score = np.where(n > 0, 1 - dist.min(0) / np.maximum(1, n * TOP), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], np.clip(score, 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for one document in five, by the id alone; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, most_langs: int = MOST_LANGS) -> Profiles:
    """Profiles from the labelled documents outside the held-out fifth, ``sample_docs`` a language at most.

    Rows with a null text or lang teach nothing. A row is chosen by a hash of its own id and text, and counted with that
    text, so rows that share an id are rows of their own, repeated rows count once, and the choice doesn't depend on how
    the table is dealt. Of more than ``most_langs`` labels those with the most documents are learned. Only the profiles,
    TOP n-grams a language, reach the driver.
    """
    lang = F.col("lang").cast("string")
    labelled = documents.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    labelled = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    # Hashes low enough to leave a few times the sample, so a language of any size sends a bounded number of rows.
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    counts = counts.select("lang", F.least(F.lit(1.0), 4.0 * sample_docs / F.col("n")).alias("share"))
    lot = F.shiftrightunsigned("h", 11) / F.lit(2.0**53)
    some = labelled.join(F.broadcast(counts), "lang").where(lot <= F.col("share")).dropDuplicates(["lang", "doc_id", "text"])
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    texts = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs).select("lang", "text")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            of: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                of.setdefault(lang, []).append(text)
            for lang, own in ((k, v[i : i + 64]) for k, v in of.items() for i in range(0, len(v), 64)):
                _, gram, n = gram_counts(own)
                gram, n = _tally(gram.view(np.uint64), n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    sums = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= TOP)
    return Profiles.of([(r.lang, r.gram, r["rank"] - 1) for r in top.collect()])


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of ``documents`` with lang_pred and score; only the text decides.

    ``und`` with score 0 if the text is null, empty or has no letter, or if no language was learned. Ties of distance
    go to the first language by code point. Repeated rows get equal answers; columns named lang_pred or score are
    replaced.
    """

    @F.pandas_udf("lang_pred string, score double")
    def judge(text):
        import pandas as pd

        pred, score = profiles.judge([t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": pred, "score": score})

    own = common.fresh("judged", documents.columns)
    got = documents.withColumn(own, judge(F.col("text").cast("string")))
    return got.withColumns({"lang_pred": F.col(own)["lang_pred"], "score": F.col(own)["score"]}).drop(own)


def keep_identified(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, with their own columns, whose language is one of the learned.

    Null and empty texts and those without a letter go, and texts that score below ``least_score``; repeated rows stay or
    go together. An empty table stays empty, and so does one without a label.
    """
    profiles, place = learn(documents), documents.columns.index("text")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pred, score = profiles.judge(part.column(place).to_pylist())
            yield part.filter(pa.array([p != "und" and s >= least_score for p, s in zip(pred, score, strict=True)], pa.bool_()))

    # mapInArrow looks columns up by name, which names with dots or marks don't survive
    plain = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*documents.columns)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = identify(documents.select("doc_id", "text"), learn(documents))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
