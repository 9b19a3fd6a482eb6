"""Chat formatting by grammar round trip (DataFrame functions only).

Grammar of a formatted conversation, per turn::

    <|im_start|>ROLE \\n TEXT <|im_end|> \\n

A conversation is rendered plainly first. A deterministic parser reads the rendered string back; where
the recovered turns differ from the source, or the control tokens do not alternate, the conversation is
rendered again with its content escaped, which always reads back:

- text: every ``<``, n backslashes, ``|`` gets one backslash more, so no ``<|`` is left;
- role: ``%``, line feed and ``<`` become ``%25``, ``%0A`` and ``%3C``.

The parser undoes both escapes in every conversation, so it needs no flag to read a string back.

Edge cases: null role or text is empty; a null conversation id is a conversation of its own; equal turns
are ordered by role, then text; repeated rows are repeated turns; an empty table gives an empty result.
All rows of a conversation meet in one row, as the formatted string is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<\|im_(?:start|end)\|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def render(turns: Column, escaped: bool) -> Column:
    def one(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        if escaped:
            role, text = escape_role(role), escape_text(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parse_body(body: Column) -> Column:
    """ROLE, line feed, TEXT."""
    at = F.instr(body, "\n")
    return F.struct(
        unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
        unescape_text(F.substring(body, at + 1, F.length(body))).alias("text"),
        F.substring(body, at + 1, F.length(body)).alias("raw"),
        at.alias("head"),
    )


def parse(df: DataFrame, formatted: str, into: str) -> DataFrame:
    """Adds column `into`: the turns (role, text, and their raw text and header length), or null where `formatted` breaks the grammar."""
    pieces, marks = f"{into}_pieces", f"{into}_marks"
    df = df.withColumn(pieces, F.split(F.col(formatted), CONTROL, -1)).withColumn(marks, F.regexp_extract_all(F.col(formatted), F.lit(f"({CONTROL})"), F.lit(1)))
    p, m = F.col(pieces), F.col(marks)
    alternate = F.forall(F.transform(m, lambda x, i: x == F.when(i % 2 == 0, F.lit(START)).otherwise(F.lit(END))), lambda x: x)
    outside = F.filter(p, lambda x, i: i % 2 == 0)
    framed = F.forall(F.transform(outside, lambda x, i: x == F.when(i == 0, F.lit("")).otherwise(F.lit("\n"))), lambda x: x)
    bodies = F.filter(p, lambda x, i: i % 2 == 1)
    headed = F.forall(bodies, lambda x: F.instr(x, "\n") > 0)
    valid = alternate & framed & headed & (F.size(p) % 2 == 1)
    return df.withColumn(into, F.when(valid, F.transform(bodies, parse_body))).drop(pieces, marks)


def masked_text(formatted: str, mask: str) -> Column:
    """The text under the loss mask of a formatted string, unescaped. The runs are cut out of the string's code points, four
    bytes each, so that a cut does not count from the start; each takes the character before it along, as a text that
    starts with a byte order mark would lose it in decoding."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,chars:int>>").alias("runs"))
    here = lambda a, x: F.when(x["loss"], F.array(F.struct(a["at"].alias("at"), x["chars"].alias("chars")))).otherwise(F.array().cast("array<struct<at:int,chars:int>>"))
    runs = F.aggregate(mask, start, lambda a, x: F.struct((a["at"] + x["chars"]).alias("at"), F.concat(a["runs"], here(a, x)).alias("runs")), lambda a: a["runs"])
    points = F.encode(F.concat(F.lit("\n"), F.col(formatted)), "UTF-32")
    cut = lambda r: F.substring(F.decode(F.substring(points, 4 * r["at"] + 1, 4 * r["chars"] + 4), "UTF-32"), F.lit(2), r["chars"])
    return F.array_join(F.transform(runs, lambda r: unescape_text(cut(r))), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, escaped, turns (as read back from formatted) and mask.

    rows: conv_id, turn, role, text; further columns are ignored. mask: runs (chars, loss) that cover
    formatted from its start in code points; loss marks the texts of assistant turns.
    """
    source = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("source")
    )
    source = source.withColumn("source", F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    plain = parse(source.withColumn("formatted", render(F.col("source"), False)), "formatted", "tried")
    same = F.coalesce(F.transform("tried", pair) == F.col("source"), F.lit(False))
    chosen = plain.withColumn("escaped", ~same).withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("formatted"))).drop("tried")
    read = parse(chosen, "formatted", "turns")
    runs = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct((t["head"] + len(START)).alias("chars"), F.lit(False).alias("loss")),
                F.struct(F.length(t["raw"]).alias("chars"), (t["role"] == "assistant").alias("loss")),
                F.struct(F.lit(len(END) + 1).alias("chars"), F.lit(False).alias("loss")),
            ),
        )
    )
    return read.withColumn("mask", runs).select("conv_id", "formatted", "escaped", F.transform("turns", pair).alias("turns"), "mask")
