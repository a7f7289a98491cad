"""Operator 3: chat formatting by relational expressions.

The turns of a conversation are collected as structs and sorted; adjacent turns of
one role become one block; blocks are written as ``<|role|>text<|sep|>text<|end|>``.
Inside roles and texts the characters ``% < [ |`` are written as ``%25 %3C %5B %7C``,
so no control string can come from a text and the writing can be undone exactly.
The loss mask is a list of spans (start, length in code points, start from 1) over the
texts of assistant turns; separators and markers lie outside it.

Only Spark expressions are used; the one shuffle is that of the grouping by conversation.

Defined results: a null text or role counts as empty; a null ``turn`` comes first; turns
with the same number are ordered by role, then text; repeated rows are turns of their own;
rows with a null ``conv_id`` form one conversation; a conversation without rows has no
output row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

END, SEP = "<|end|>", "<|sep|>"
# What is escaped and how, in the order of escaping; undone in reverse.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("|", "%7C"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, formatted, loss_spans array<struct<start, len>>)."""
    rows = turns.select(
        "conv_id",
        F.struct("turn", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # Where blocks start: the first turn and every turn whose role differs from the one before.
    starts = F.filter(
        F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"])
    )
    blocks = F.transform(
        "starts",
        lambda s, i: F.struct(
            F.element_at("t", s)["role"].alias("role"),
            F.slice("t", s, F.coalesce(F.get("starts", i + 1), F.size("t") + 1) - s)["text"].alias("texts"),
        ),
    )

    def pieces(block: Column) -> Column:
        """A block as structs of text and whether the loss covers it."""
        head = F.struct(F.concat(F.lit("<|"), block["role"], F.lit("|>")).alias("s"), F.lit(False).alias("loss"))
        body = F.flatten(
            F.transform(
                block["texts"],
                lambda x, i: F.array(
                    F.struct(F.when(i > 0, F.lit(SEP)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                    F.struct(x.alias("s"), (block["role"] == F.lit(loss_role)).alias("loss")),
                ),
            )
        )
        return F.concat(F.array(head), body, F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))))

    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.length(p["s"]).alias("len"))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return (
        sorted_turns.withColumn("starts", starts)
        .select("conv_id", blocks.alias("blocks"))
        .select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
        .select("conv_id", F.array_join(F.col("pieces")["s"], "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_extract(b, r"(?s)\A<\|[^<|]*\|>(.*)\z", 1), r"<\|sep\|>"),
                lambda x: F.struct(unescape(F.regexp_extract(b, r"\A<\|([^<|]*)\|>", 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["len"]))), "")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"
    )
    out = format_conversations(turns.unionByName(extra)).withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", read_loss(F.col("formatted"), F.col("loss_spans"))
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before,
    replace(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C') AS etext,
    replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), '|', '%7C') AS erole
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + 7 + CASE WHEN before IS DISTINCT FROM role THEN length(erole) + 4 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
