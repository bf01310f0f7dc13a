"""Chat formatting: one training text for each conversation, its loss mask, and the way back.

Template.  Adjacent turns of one role form a block::

    <|im_start|>ROLE<|im_body|>TEXT<|im_next|>TEXT<|im_end|>\\n

``<|im_next|>`` stands between the texts of merged turns, so that merging loses nothing.  Inside roles and texts each
backslash is doubled, then a backslash is put behind the first character of every control string.  Control strings hold
no backslash, so dropping the first of ``\\\\`` or a single ``\\`` gives the text back exactly.

Defined results: null role or text counts as empty; turns are ordered by turn, then role, then text (null turn first);
repeated rows are turns of their own; rows with a null conversation id form one conversation; an empty table gives no
rows; other columns are ignored.  A conversation is one output value, so its turns do meet in one row: long texts and many
turns need its size in memory a few times over, and time in proportion to it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running

START, BODY, NEXT, END = "<|im_start|>", "<|im_body|>", "<|im_next|>", "<|im_end|>"
#: Strings that this template or a common other one gives a meaning.
CONTROL = [START, BODY, NEXT, END, "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>"]
_ANY = "({})".format("|".join(f"{re.escape(x[0])}(?={re.escape(x[1:])})" for x in CONTROL))


def escape(text: Column) -> Column:
    """Makes control strings inside ``text`` harmless."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(F.regexp_like(doubled, F.lit(_ANY)), F.regexp_replace(doubled, _ANY, "$1\\\\")).otherwise(doubled)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\(\\?)", "$1")).otherwise(text)


def format_chats(conversations: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start,chars>> (code points of learnt texts), n_blocks int."""
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    new = turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
        ),
    )
    blocks = new.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get("turns", s)["role"].alias("role"),
                F.transform(
                    F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ),
    )
    # Every block as pieces (text, learnt): their concatenation is the formatted text, their lengths give the mask.
    pieces = blocks.select(
        "conv_id",
        F.size("blocks").alias("n_blocks"),
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.flatten(
                    F.array(
                        F.array(_piece(F.concat(F.lit(START), escape(b["role"]), F.lit(BODY)), F.lit(False))),
                        F.flatten(
                            F.transform(
                                b["texts"],
                                lambda x, k: F.array(
                                    _piece(F.when(k > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)),
                                    _piece(x, b["role"] == learn_role),
                                ),
                            )
                        ),
                        F.array(_piece(F.lit(END + "\n"), F.lit(False))),
                    )
                ),
            )
        ).alias("pieces"),
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        _spans().alias("loss_spans"),
        "n_blocks",
    )


def _piece(text: Column, learnt: Column) -> Column:
    return F.struct(text.alias("text"), learnt.alias("learnt"))


def _spans() -> Column:
    """The learnt pieces' places, by running sums over the piece lengths."""
    placed = F.arrays_zip("pieces", running(F.col("pieces"), lambda p: F.length(p["text"])).alias("at"))
    return F.transform(
        F.filter(placed, lambda z: z["pieces"]["learnt"]),
        lambda z: F.struct(z["at"].alias("start"), F.length(z["pieces"]["text"]).cast("long").alias("chars")),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role,text>> and learnt array<string>, both read from ``format_chats``' output alone."""
    heads = formatted.withColumn(
        "heads",
        F.transform(
            F.filter(F.split("formatted", re.escape(END + "\n")), lambda b: b != ""),
            lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), re.escape(BODY)),
        ),
    )
    # 32 bits a code point: a span is cut out at once, however long the text is.
    wide = heads.withColumn("wide", F.encode("formatted", "UTF-32"))
    return wide.select(
        "conv_id",
        F.flatten(
            F.transform(
                "heads",
                lambda h: F.transform(
                    F.split(F.get(h, F.lit(1)), re.escape(NEXT)),
                    lambda x: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(x).alias("text")),
                ),
            )
        ).alias("turns"),
        F.transform(
            "loss_spans",
            lambda s: unescape(F.decode(F.substr(F.col("wide"), s["start"].cast("int") * 4 + 1, s["chars"].cast("int") * 4), "UTF-32")),
        ).alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def digest(parsed: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    learnt = F.array_join("learnt", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )
