"""Chat formatting: relational, Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role merged by an array fold, and
written as one string. A turn reads ``<s>[INST]role[/INST]text</s>``; texts merged into one turn are set apart by
``<sep>``. Control strings inside a role or a text get a backslash after their first character and every backslash is
doubled before that, so that reading back is exact.

Defined results: null text, role or turn count as '' or first in order; a conversation with null id is one conversation;
equal turn numbers are ordered by role, then text; repeated rows are repeated turns; an empty table gives no rows; other
columns are ignored. One conversation is one output value, so its turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, HEAD, BODY, END, SEP = "<s>", "[INST]", "[/INST]", "</s>", "<sep>"
CONTROL = (START, HEAD, BODY, END, SEP)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    for mark in CONTROL:
        text = F.replace(text, F.lit(f"{mark[0]}\\{mark[1:]}"), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_chats(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start, length>>: 0-based code points of each trained text."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # in order of the texts as they are, then escaped
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(ordered.alias("turns"))
    empty = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")

    def step(merged: Column, t: Column) -> Column:
        last = F.element_at(merged, -1)
        grown = F.concat(
            F.slice(merged, 1, F.size(merged) - 1),
            F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))),
        )
        new = F.concat(merged, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))))
        return F.when((F.size(merged) > 0) & (F.try_element_at(merged, F.lit(-1))["role"] == t["role"]), grown).otherwise(new)

    merged = chats.select("conv_id", F.aggregate("turns", empty, step).alias("merged"))
    # the pieces of the string in order; pieces that carry loss are marked
    pieces = F.flatten(
        F.transform(
            "merged",
            lambda m: F.concat(
                F.array(F.struct(F.concat(F.lit(START + HEAD), m["role"], F.lit(BODY)).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        m["texts"],
                        lambda x, i: F.array(
                            F.struct(F.when(i > 0, F.lit(SEP)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                            F.struct(x.alias("s"), (m["role"] == F.lit(trained)).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    spans = F.aggregate(
        "pieces",
        F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))"),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).cast("long").alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(p["s"]).cast("long").alias("length")))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return merged.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the original rows, from the formatted string alone."""
    bodies = F.filter(F.split(formatted, F.lit(END)), lambda b: b != F.lit(""))
    return F.flatten(
        F.transform(
            bodies,
            lambda b: F.transform(
                F.split(F.substring_index(b, BODY, -1), F.lit(SEP)),
                lambda x: F.struct(
                    unescape(F.substring(F.substring_index(b, BODY, 1), F.lit(len(START + HEAD) + 1), F.length(b))).alias("role"),
                    unescape(x).alias("text"),
                ),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of conversation -7 whose texts look like markup, read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {odd}), (-7L, 1L, 'assistant', {odd}) AS t(conv_id, turn, role, text)")
    done = format_chats(rows.unionByName(extra))
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)),
    '<s>', '<' || chr(92) || 's>'), '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'),
    '</s>', '<' || chr(92) || '/s>'), '<sep>', '<' || chr(92) || 'sep>') AS esc,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + CASE WHEN before = role THEN 5 ELSE length(role) + 20 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
