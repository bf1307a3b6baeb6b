"""What the training-data operators share: the shared folder, materialised tables, id order and tokenizing."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import shared_dir  # noqa: F401

#: What a null id counts as when rows are ordered: after every other id.
LAST_ID = 2**63 - 1
#: The white space that separates words, as a Java and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to ``path`` and reads it again, which cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_id(name: str) -> Column:
    """The id as a long that orders rows; null comes last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def own_column(name: str, of: str = "") -> Column:
    """A column by its very name, whatever characters it has; of the frame aliased ``of`` where that is given."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is none of ``taken``, whatever their case."""
    lower = {c.lower() for c in taken}
    return next(x for x in (f"__{name}{'_' * k}" for k in range(len(taken) + 1)) if x not in lower)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def partitions_for(frame: DataFrame, each: int = 128 << 20) -> int:
    """How many partitions to deal a table's rows over: one for about ``each`` bytes by the plan's own estimate, taking
    files to unpack to three times their size, and no fewer than there are cores or shuffle partitions."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parallelism(frame.sparkSession), 3 * size // each if size < 1 << 60 else 0)


#: Rows of one key above which a lookup is salted.
HOT_KEY = 10_000


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, path: str, by: str = "doc_id") -> DataFrame:
    """``rows`` inner joined with ``table`` (one row a key) on ``key``; keys of over ``HOT_KEY`` rows are salted
    by the column ``by``.

    At most len(rows) / HOT_KEY keys are hot, each gets as many salts as it has HOT_KEY rows; so the salted copies of
    ``table`` add len(rows) / HOT_KEY rows at most.
    """
    hot = rows.groupBy(key).count().where(F.col("count") > HOT_KEY).select(key, F.ceil(F.col("count") / HOT_KEY).cast("int").alias("salts"))
    hot = materialise(hot, f"{path}-hot")
    if hot.isEmpty():
        return rows.join(table, key)
    marked = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    widest = hot.agg(F.max("salts")).first()[0]
    # A row doesn't know its key's salts; it takes a number below the widest, folded where its key is hot.
    few = F.broadcast(hot) if hot.count() <= 100_000 else hot
    spread = rows.withColumn("salt0", F.pmod(F.xxhash64(by), F.lit(widest)).cast("int")).join(few, key, "left").withColumn("salt", F.coalesce(F.col("salt0") % F.col("salts"), F.lit(0))).drop("salt0", "salts")
    return spread.join(marked, [key, "salt"]).drop("salt")


# --- filters ----------------------------------------------------------------------------------------------------------

#: Most bits of a filter that the driver hands out; beyond it the filter only lets more through.
FILTER_BITS = 1 << 24
HASHES = 4


def bloom(words: np.ndarray, bits: int) -> np.ndarray:
    """A Bloom filter over unsigned 64-bit words that are uniform already; ``bits`` is a power of two."""
    out = np.zeros(bits, bool)
    for k in range(HASHES):
        out[_place(words, k, bits)] = True
    return np.packbits(out, bitorder="little")


def might_hold(filter_: np.ndarray, words: np.ndarray) -> np.ndarray:
    bits, out = len(filter_) * 8, np.ones(len(words), bool)
    for k in range(HASHES):
        at = _place(words, k, bits)
        out &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _place(words: np.ndarray, k: int, bits: int) -> np.ndarray:
    step = (words >> np.uint64(32)) | np.uint64(1)
    return ((words + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def filter_of(keys: DataFrame, key: str):
    """A test of a column against a table's keys, as an expression over a binary literal of bounded size (2 MB at most); it
    never says no to one of them."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * max(1, keys.count()) - 1).bit_length()))
    word = F.xxhash64(key)
    spots = F.array(*[F.pmod(word + F.lit(k) * (F.shiftrightunsigned(word, 32).bitwiseOR(F.lit(1))), F.lit(bits).cast("long")) for k in range(HASHES)])
    rows = keys.select(F.explode(spots).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).collect()
    table = np.zeros(bits // 64, np.int64)
    table[[r.w for r in rows]] = [r.b for r in rows]
    held = F.lit(table.astype("<i8").tobytes())

    def passes(column: Column) -> Column:
        word, out = F.xxhash64(column), None
        for k in range(HASHES):
            spot = F.pmod(word + F.lit(k) * (F.shiftrightunsigned(word, 32).bitwiseOR(F.lit(1))), F.lit(bits).cast("long"))
            byte = F.conv(F.hex(F.substr(held, (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            hit = F.getbit(byte, spot.bitwiseAND(F.lit(7)).cast("int")) == 1
            out = hit if out is None else out & hit
        return out

    return passes


def without(rows: DataFrame, gone: DataFrame, path: str, *key: str) -> DataFrame:
    """``rows`` without those whose key is in ``gone``, which is read several times, as the keys of ``rows`` are.

    Only keys are met; a row is moved only if two filters are in doubt about it. One is over the keys to drop, the other
    over the keys to keep that the first takes for them, so a row that passes the first alone goes. Rows that pass both
    meet the keys to drop: few while there is room in the filters, and beyond that more of them, with the same result.
    """
    word = F.xxhash64(*key)
    hit = filter_of(gone.select(word.alias("k")).distinct(), "k")(word)
    alike = materialise(rows.select(*key).where(hit).join(gone, list(key), "left_anti"), path)
    sure = rows.where(~hit)
    if alike.isEmpty():
        return sure
    doubt = filter_of(alike.select(word.alias("k")).distinct(), "k")(word)
    return sure.unionByName(rows.where(hit & doubt).join(gone, list(key), "left_anti").select(*rows.columns))


# --- tokenizing -------------------------------------------------------------------------------------------------

#: Characters whose classes (letter, digit, white space) no version of Unicode disputes. Texts with others take the
#: library's own path over the whole text.
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u017f\u2010-\u2027]*")
#: The words of a byte-level pre-tokenizer, over those characters.
_WORDS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+").findall
#: A place at which no token can span: a single space between two characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PIECE = 1 << 18




def _byte_level() -> str:
    """The character for each byte in byte-level vocabularies: itself if it shows, else the next one from U+0100."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shows else next(hidden)) for b in range(256))


_BYTE_LEVEL = _byte_level()
_BLANK = _BYTE_LEVEL[0x20]
#: Words that an encoder remembers, of each of two generations; about 160 bytes a word.
WORDS = 350_000


class _Known(dict):
    """Ids of strings, as bytes. Of two generations the older is dropped when the younger is full, so words that go on
    occurring stay and memory is bounded."""

    def __init__(self, encode, most: int) -> None:
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts under a byte-level BPE file of the ``tokenizers`` library.

    BPE works within the words that the file's pre-tokenizer finds, so each distinct word is encoded by the library and
    remembered, in two generations of ``words`` words. Texts outside the plain character set, or with a special token's
    string, are encoded whole by the library. Long texts go piece by piece, cut only where no token can span, so memory
    follows the piece and not the text.
    """

    def __init__(self, path: str, words: int = WORDS) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tok = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        pre = json.loads(self._tok.to_str())["pre_tokenizer"] or {}
        self._model = self._tok.model
        self._by_word = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self._known = _Known(self._word, words)

    def _library(self, text: str) -> list[int]:
        return self._tok.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> bytes:
        """The model's ids of one word, whose bytes are spelled in the pre-tokenizer's alphabet."""
        spelled = word.replace(" ", _BLANK) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > _PIECE:
            cut = _CUT.search(text, at + _PIECE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of one text, in pieces that follow each other; null counts as empty."""
        if not text:
            return
        if not self._by_word or not _PLAIN.fullmatch(text) or any(s in text for s in self._special):
            yield np.array(self._library(text), "<u4")
            return
        for piece in self._pieces(text):
            yield np.frombuffer(b"".join(map(self._known.__getitem__, _WORDS(piece))), "=u4").astype("<u4", copy=False)

    def encode(self, text: str | None, end: int | None = None) -> np.ndarray:
        """All ids of one text, then ``end`` if it is given."""
        parts = [*self.pieces(text), *([] if end is None else [np.array([end], "<u4")])]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, words: int = WORDS) -> Encoder:
    """The worker's encoder of this file; loaded once a Python worker, which keeps the last one."""
    if (path, words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
