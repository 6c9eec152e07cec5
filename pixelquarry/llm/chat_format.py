"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are the
context, only that reply is trainable. A conversation whose last turn is not an
assistant's gets one more row without a target, so that no turn is lost.

Template: each turn is ``<s>[ROLE] text </s>`` with the role in capitals; other
roles than system, user and assistant keep their own name. Inside roles and
texts ``&``, ``<``, ``[`` and ``]`` become ``&amp;``, ``&lt;``, ``&lb;`` and
``&rb;``, so neither can hold a mark of the template, and unescaping is exact.

Defined results: a null text or role is empty; turns with equal numbers are
ordered by role and text, repeated rows are kept; an empty table gives an empty
table; further columns are ignored; a null conv_id is one conversation. A row
holds the whole context of its target, so the output of a conversation with n
turns grows with n squared, as the method has it; each example is built after
the explode, one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

QUERY = "op9_chat_prefix_target"
OPEN, CLOSE, END = "<s>[", "] ", " </s>"
#: Fixed values of the template's escapes, in the order in which they are applied.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"))


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END))


def prefix_target(turns: DataFrame) -> DataFrame:
    """(conv_id, example, context, target): target is the escaped reply, the only trainable text; null in a closing row.

    ``context`` ends with the opening of the assistant's turn; context + target + END is the example's text.
    """
    t = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n))
    each = whole.select("conv_id", "turns", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("turns", F.col("end"))
    reply = last["role"] == "assistant"
    before = F.slice("turns", F.lit(1), F.when(reply, F.col("end") - 1).otherwise(F.col("end")))
    context = F.concat(F.array_join(F.transform(before, _turn), ""), F.when(reply, F.lit(f"{OPEN}assistant{CLOSE}")).otherwise(""))
    return each.select("conv_id", "example", context.alias("context"), F.when(reply, escape(last["text"])).alias("target"))


def read_back(examples: DataFrame) -> DataFrame:
    """The contract's digests, from the formatted rows alone: turns from each conversation's longest row, losses from all targets."""
    text = F.concat("context", F.coalesce(F.concat("target", F.lit(END)), F.lit("")))
    rows = examples.select(
        "conv_id",
        "example",
        text.alias("formatted"),
        F.struct("example", F.coalesce(unescape(F.col("target")), F.lit("")).alias("text")).alias("loss"),
    )
    per = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    pieces = F.filter(F.split("longest", r"<s>\["), lambda x: x != "")
    turns = F.transform(
        pieces,
        lambda p: F.concat(
            unescape(F.substring_index(p, CLOSE, 1)),
            F.lit("\n"),
            unescape(p.substr(F.char_length(F.substring_index(p, CLOSE, 1)) + F.lit(len(CLOSE) + 1), F.char_length(p) - F.char_length(F.substring_index(p, CLOSE, 1)) - F.lit(len(CLOSE) + len(END)))),
            F.lit("\n"),
        ),
    )
    return per.select(
        "conv_id",
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return read_back(materialize(prefix_target(turns), "chat"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;'))
         + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;')) + 11 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), f AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
