"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as one ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.
A deterministic parser reads it back; where the recovered turns differ from the
source, the conversation is rendered again with its content escaped, until they
are identical.  Escaping adds a backslash inside every ``<|`` of a text (``<\\|``,
and ``<\\\\|`` for ``<\\|``), so no control string is left in it, and the parser
takes exactly one backslash away.  A role's line feed is written as ``<n|``.

The loss mask is a run length code over the code points of the formatted text:
``skip`` characters without loss, then ``take`` characters with it, per turn.

Defined cases: null texts and roles are empty; turns are ordered by ``turn``,
then role and text, null turns first; repeated rows are turns of their own; a
null ``conv_id`` is a conversation of its own; an empty table gives no rows.  A
formatted conversation is one row by definition, so its length is bounded by a
row's two gigabytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.llm.shared import text_of
from traceless.plans.workspace import Stored

START = "<|im_start|>"
END = "<|im_end|>"
ASSISTANT = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<(\\*)(n?)\|", r"<\\$1$2|"), F.lit("\n"), F.lit("<n|"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), r"<\\(\\*)(n?)\|", r"<$1$2|")


def render(turns: Column) -> Column:
    """Formatted text of an array of ``role, text``."""
    one = F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n")))
    return F.array_join(one, "")


def parse_raw(formatted: Column) -> Column:
    """Turns ``role, text`` still escaped; a null text marks what the grammar does not allow."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    heads = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        length = F.length(piece) - F.length(role) - 1 - len(END) - 1
        ends = F.locate(END, piece) == F.length(piece) - len(END)
        text = F.when(ends & piece.endswith(f"{END}\n") & (length >= 0), F.substr(piece, F.length(role) + 2, length))
        return F.struct(role.alias("role"), text.alias("text"))

    whole = F.element_at(pieces, 1) == ""
    return F.when(whole, F.transform(heads, turn))


def parse(formatted: Column) -> Column:
    """Turns ``role, text`` as they were before formatting."""
    return F.transform(
        parse_raw(formatted),
        lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape_text(t["text"]).alias("text")),
    )


def format_conversations(rows: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """``conv_id, level, formatted, loss_mask``; ``level`` counts the escapes that were needed."""
    turn = F.struct(F.col("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    open_rows = grouped.select("conv_id", source.alias("source"), source.alias("turns"))
    done: list[Stored] = []
    while True:
        level = len(done)
        tried = open_rows.withColumn("formatted", render(F.col("turns")))
        found = parse(F.col("formatted"))
        tried = Stored(
            tried.withColumn("ok", F.coalesce(found == F.col("source"), F.lit(False))).withColumn(
                "level", F.lit(level)
            ),
            "formatted",
        )
        done.append(tried)
        open_rows = tried.df.where(~F.col("ok"))
        if open_rows.isEmpty():
            break
        escaped = F.transform(
            "turns",
            lambda t: F.struct(escape_role(t["role"]).alias("role"), escape_text(t["text"]).alias("text")),
        )
        if level > 0:
            raise ValueError("an escaped conversation does not read back as its source")
        open_rows = open_rows.select("conv_id", "source", escaped.alias("turns"))
    mask = F.transform(
        F.arrays_zip("source", "turns"),
        lambda p: _runs(p["source"]["role"], p["turns"]["role"], p["turns"]["text"], loss_role),
    )
    parts = [d.df.where("ok").select("conv_id", "level", "formatted", mask.alias("loss_mask")) for d in done]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _runs(role: Column, written_role: Column, text: Column, loss_role: str) -> Column:
    head = F.length(written_role) + len(START) + 1
    take = F.when(role == loss_role, F.length(text)).otherwise(0)
    return F.struct(
        head.cast("long").alias("skip"),
        take.cast("long").alias("take"),
        (F.length(text) - take + len(END) + 1).cast("long").alias("rest"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars`` from formatted text and mask alone."""
    under = F.transform(
        F.arrays_zip(parse_raw(F.col("formatted")).alias("turn"), F.col("loss_mask").alias("run")),
        lambda p: unescape_text(F.substr(p["turn"]["text"], F.lit(1), p["run"]["take"].cast("int"))),
    )
    return formatted.select(
        "conv_id",
        parse(F.col("formatted")).alias("turns"),
        F.array_join(under, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
