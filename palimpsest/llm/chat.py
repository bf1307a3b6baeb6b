"""Chat formatting with Spark expressions only.

A conversation's rows, collected as structs and sorted by turn, become one string in which adjacent rows of one role are
merged into one turn::

    <|turn|>user<|says|>a question<|and|>more of it<|end|><|turn|>assistant<|says|>an answer<|end|>

Control strings inside roles and texts are made harmless by a backslash after their first character, and backslashes
are doubled, which is undone by dropping each escaping backslash. Rows are gathered in blocks of ``BLOCK`` turn numbers
first and the blocks' strings then, so a long conversation's rows never meet in one array.

The loss mask is run lengths in characters of the formatted string: skip so many, keep so many; it keeps the texts of
assistant rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SAYS, AND, STOP, BLOCK = "<|turn|>", "<|says|>", "<|and|>", "<|end|>", 256
#: Where a control string of a common chat template begins, ours among them.
CONTROLS = r"(?:(?<=<)(?=\||/?s>|</?SYS>>)|(?<=\[)(?=/?INST\]))"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), CONTROLS, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(SAYS))


def _between(before: Column, role: Column) -> Column:
    return F.when(before == role, F.lit(AND)).otherwise(F.concat(F.lit(STOP), _opening(role)))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: conv_id, formatted, loss_mask (array of skip, keep), rows.

    Null texts and roles count as empty. Rows come by turn (null first), ties by role and then text, as they are before
    they are escaped; repeated rows all stay. Rows of a null conv_id are one conversation. An empty table gives no rows.
    Other columns are ignored.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own("role"), own("text"))
    row = F.struct(F.coalesce("turn", F.lit(-(2**63) + 1)).alias("turn"), "role", "text")
    sorted_ = rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    first = sorted_.withColumn("t", F.transform("t", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))))
    joint = lambda i: F.when(i == 0, F.lit("")).otherwise(_between(F.col("t")[i - 1]["role"], F.col("t")[i]["role"]))
    learned = lambda t: t["role"] == F.lit(LEARNED)
    first = first.select(
        "conv_id",
        F.struct(
            F.coalesce("block", F.lit(-(2**62))).alias("block"),
            F.col("t")[0]["role"].alias("head"),
            F.element_at("t", -1)["role"].alias("tail"),
            F.size("t").cast("long").alias("rows"),
            F.array_join(F.transform("t", lambda t, i: F.concat(joint(i), t["text"])), "").alias("body"),
            F.transform(
                "t",
                lambda t, i: F.struct(
                    (F.length(joint(i)) + F.when(learned(t), 0).otherwise(F.length(t["text"]))).cast("long").alias("skip"),
                    F.when(learned(t), F.length(t["text"])).otherwise(0).cast("long").alias("keep"),
                ),
            ).alias("mask"),
        ).alias("b"),
    )
    whole = first.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    lead = lambda i: F.when(i == 0, _opening(F.col("b")[i]["head"])).otherwise(_between(F.col("b")[i - 1]["tail"], F.col("b")[i]["head"]))
    return whole.select(
        "conv_id",
        F.concat(F.array_join(F.transform("b", lambda b, i: F.concat(lead(i), b["body"])), ""), F.lit(STOP)).alias("formatted"),
        F.flatten(F.transform("b", lambda b, i: F.concat(F.array(F.struct(F.length(lead(i)).cast("long").alias("skip"), F.lit(0).cast("long").alias("keep"))), b["mask"]))).alias("loss_mask"),
        F.aggregate("b", F.lit(0).cast("long"), lambda n, b: n + b["rows"]).alias("rows"),
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, and turns: the rows (role, text) that the string says, unescaped, with their escaped length.

    A mask that keeps other run lengths than the assistant's texts is an error.
    """
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda b: b != "")

    def told(block: Column) -> Column:
        pair = F.split(block, r"<\|says\|>", 2)
        role = unescape(F.substr(pair[0], F.lit(len(START) + 1)))
        return F.transform(F.split(pair[1], r"<\|and\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), F.length(t).cast("long").alias("n")))

    rows = formatted.withColumn("turns", F.flatten(F.transform(blocks, told)))
    kept = F.filter(F.transform("loss_mask", lambda m: m["keep"]), lambda n: n > 0)
    said = F.filter(F.transform("turns", lambda t: F.when(t["role"] == LEARNED, t["n"]).otherwise(F.lit(0).cast("long"))), lambda n: n > 0)
    return rows.withColumn("turns", F.when(kept == said, F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("the mask does not fit conversation "), F.col("conv_id").cast("string")))))


def loss_text() -> Column:
    """What ``loss_mask`` keeps of ``formatted``, unescaped.

    Places are summed within blocks of ``BLOCK`` runs and then over the blocks, and cut from a copy of four bytes a
    character, so neither is quadratic in a long conversation.
    """
    zero, spans = F.lit(0).cast("long"), lambda kind: F.expr(f"CAST(array() AS array<{kind}>)")
    kind = "struct<at:bigint,keep:bigint>"
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("loss_mask") - 1) / BLOCK).cast("int")), lambda k: F.slice("loss_mask", k * BLOCK + 1, F.lit(BLOCK)))

    def place(s: Column, m: Column) -> Column:
        at = s["at"] + m["skip"]
        own = F.array(F.struct(at.alias("at"), m["keep"].alias("keep")))
        return F.struct((at + m["keep"]).alias("at"), F.when(m["keep"] > 0, F.concat(s["spans"], own)).otherwise(s["spans"]).alias("spans"))

    def follow(s: Column, b: Column) -> Column:
        own = F.array(F.struct(s["at"].alias("base"), b["spans"].alias("spans")))
        return F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["blocks"], own).alias("blocks"))

    blocks = F.transform(runs, lambda r: F.aggregate(r, F.struct(zero.alias("at"), spans(kind).alias("spans")), place))
    placed = F.aggregate(blocks, F.struct(zero.alias("at"), spans(f"struct<base:bigint,spans:array<{kind}>>").alias("blocks")), follow)["blocks"]
    cut = lambda wide, at, keep: unescape(F.decode(F.substr(wide, (4 * at + 1).cast("int"), (4 * keep).cast("int")), "UTF-32"))
    text = lambda wide: F.array_join(F.transform(placed, lambda b: F.array_join(F.transform(b["spans"], lambda s: cut(wide, b["base"] + s["at"], s["keep"])), "")), "")
    return F.transform(F.array(F.encode("formatted", "UTF-32")), text)[0]  # the copy is made once


def op8_chat(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = read_conversations(format_conversations(conversations.unionByName(extra))).withColumn("loss", loss_text())
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace(replace({}, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER w AS before, {_ESC.format("text")} AS etext, {_ESC.format("role")} AS erole
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(etext) + CASE WHEN before = role THEN 7 ELSE 8 + length(erole) + 8 + 7 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
