r"""Chat formatting with Spark expressions only (operator 9, native).

Turns are collected as structs and sorted, adjacent turns of one role merge into
a block, and the blocks are concatenated:

    <s>ROLE<|text|>TEXT<|next|>TEXT</s><s>ROLE<|text|>TEXT</s>...

A control string inside a role or a text gets a backslash after its first
character, and one that already has n backslashes there gets n + 1, so that no
control string is left and reading back takes exactly one away.

Defined results: null text or role counts as empty; turns sort by (turn, role,
text), nulls first, and repeated rows stay as turns of their own; rows with a
null conv_id form one conversation; a conversation of any number of turns is one
row, whose list of spans is built by appending, in time that grows with the
square of its assistant turns; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, NEXT, CLOSE = "<s>", "<|text|>", "<|next|>", "</s>"
#: What may follow < or [ in a control string, those of common templates included.
REST = r"/?s>|</?SYS>>|\|(?:text|next)\|>|/?INST\]"
ESCAPE = rf"([<\[])(\\*)({REST})"
UNESCAPE = rf"([<\[])\\(\\*)({REST})"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text).

    loss_spans: array of (start, length) in code points of formatted, one for
    each assistant text, in order.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    t = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    t = t.withColumn("t", F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), escape(x["text"]).alias("text"))))  # sorted as they came
    role_at = lambda i: F.get(F.col("t"), i)["role"]
    t = t.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1))))

    def block(s: Column, k: Column) -> Column:
        n = F.coalesce(F.get(F.col("starts"), k + 1), F.size("t")) - s
        own = F.slice(F.col("t"), s + 1, n)
        piece = lambda text, loss: F.struct(text.alias("s"), loss.alias("loss"))
        head = F.array(piece(F.concat(F.lit(OPEN), escape(role_at(s)), F.lit(TEXT)), F.lit(False)))
        body = F.flatten(F.transform(own, lambda x, i: F.array(
            piece(x["text"], x["role"] == LOSS_ROLE),
            piece(F.when(i + 1 < n, F.lit(NEXT)).otherwise(F.lit(CLOSE)), F.lit(False)))))
        return F.concat(head, body)

    t = t.select("conv_id", F.flatten(F.transform("starts", block)).alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(p["s"]).alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return t.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted): what the formatted string and its mask say, unescaped."""
    closed = F.split("formatted", CLOSE)
    blocks = F.slice(closed, 1, F.size(closed) - 1)

    def opened(b: Column) -> Column:
        cut = F.call_function("instr", b, F.lit(TEXT))
        role = unescape(F.substring(b, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN)))
        texts = F.split(F.substring(b, cut + len(TEXT), F.length(b)), r"<\|next\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return chats.select(
        "conv_id", F.flatten(F.transform(blocks, opened)).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss_texts"),
        "formatted",
    )


def digests(read: DataFrame) -> DataFrame:
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
