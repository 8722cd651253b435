"""Chat formatting with typed content parts.

A turn is a row (conversation, turn number, role, parts); a part is text, image, audio or document. The visitor walks the
parts in order: text is escaped, every other part becomes one placeholder control string, is recorded as an attachment and
counts for as many tokens as its size asks for. Turns are marked by control strings, each of which begins with ``<`` or
``[``; inside texts and roles every ``<``, ``[`` and ``&`` is written as an entity, whatever follows it, so neighbouring
parts can't join to a control string and the output reads back exactly.

Edge cases: null text or role is empty; null parts are none; an unknown part type is an attachment of type ``document``; a
null conversation id is one conversation; a null turn number comes first; turns with equal numbers follow the order of
role, then of text, and repeated rows stay; an empty table gives no rows; further columns are ignored, whatever their names.
A conversation is one row of output, so its length is bounded by what one string can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkarray.llm.common import WORD, ascii_words, col, table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens for each unit of an attachment: an image's 32 by 32 patches, an audio's seconds, a document's pages.
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 600}
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsb;"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&lsb;"), F.lit("[")), F.lit("&amp;"), F.lit("&"))


def kind(p: Column) -> Column:
    return F.when(p["type"].isin("text", "image", "audio"), p["type"]).otherwise(F.lit("document"))


def visit(p: Column) -> Column:
    """What a part becomes in the formatted text."""
    return F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit("|>")))


def part_tokens(p: Column) -> Column:
    """Text counts its words, an attachment its size."""
    units = F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)).cast("long")
    rate = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    return F.when(p["type"] == "text", F.size(ascii_words(p["text"])).cast("long")).otherwise(units * F.element_at(rate, kind(p)))


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def format_chat(turns: DataFrame, parts: Column, loss_role: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """conv_id, formatted, loss_spans (code points, end exclusive), attachments in order, expanded_tokens.

    One shuffle by conversation serves both the running offsets and the joining.
    """
    own = turns.select(col(conv).alias("conv_id"), col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    seen = own.select(
        "conv_id", "turn", "role",
        F.array_join(F.transform("parts", visit), "").alias("body"),
        F.transform(F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("")) != "text"), lambda p: F.struct(kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("files"),
        F.aggregate(F.transform("parts", part_tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    seen = seen.withColumn("segment", F.concat(head, "body", F.lit(END))).withColumn("head_chars", F.length(head).cast("long"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    placed = seen.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum(F.length("segment").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    start = F.col("upto") - F.length("segment") + F.col("head_chars")
    placed = placed.withColumn("span", F.when(F.col("role") == loss_role, F.struct(start.alias("start"), (start + F.length("body")).alias("end"))))
    rows = F.sort_array(F.collect_list(F.struct("nth", "segment", "span", "files")))
    out = placed.groupBy("conv_id").agg(rows.alias("t"), F.sum("tokens").alias("expanded_tokens"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
        "expanded_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds: array of (role, text); placeholders are not text."""
    lines = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    strip = lambda x: F.regexp_replace(x, r"<\|(image|audio|document)\|>", "")
    return F.transform(
        lines,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring_index(x, TURN, -1), BODY, 1)).alias("role"),
            unescape(strip(F.substring_index(x, BODY, -1))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


PROBE = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = format_chat(turns.unionByName(probe), text_parts(F.col("text")))
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "")
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), "attachments", "expanded_tokens")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


QUERIES = {"op6_chat": op6_chat}

_ESC = r"(length({x}) + 4 * len(regexp_extract_all({x}, '[&\[]')) + 3 * len(regexp_extract_all({x}, '<')))"
ORACLE = {
    "op6_chat": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + BODY + END)} + {_ESC.format(x='r')} + {_ESC.format(x='x')}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments,
  CAST(sum(len(regexp_extract_all(x, '{WORD}'))) AS BIGINT) AS expanded_tokens
FROM t GROUP BY conv_id"""
}
