"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar:  conversation = "<s>" level "\\n" turn*      level = "0" (plain) or "1" (escaped)
          turn = "[INST]" role "[/INST]" text "</s>"
No role or text may hold a control string (<s>, </s>, [INST], [/INST]); the parser rejects a turn that does. Every
conversation is rendered plainly, parsed, and compared with its source; one that does not come back identical is
rendered with its content escaped, after which no "<" or "[" is left in it, so the parse is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, TURN_END, START = "[INST]", "[/INST]", "</s>", "<s>"
HEADER = len(START) + 2
#: Escapes in order of application; undone in reverse. The backslash comes first, so every later one starts a code.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escape(x: Column) -> Column:
    for plain, code in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def render(turns: Column, level: int) -> Column:
    """The text of an array of (role, text) structs."""
    put = escape if level else (lambda x: x)
    body = F.transform(turns, lambda t: F.concat(F.lit(OPEN), put(t["role"]), F.lit(ROLE_END), put(t["text"]), F.lit(TURN_END)))
    return F.concat(F.lit(f"{START}{level}\n"), F.array_join(body, ""))


def _count(x: Column, what: str) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(what), F.lit("")))) / len(what)


def parse(formatted: Column) -> Column:
    """Turns (role, text, raw_role, raw_text) read from formatted text alone; null where the grammar doesn't hold."""
    escaped = F.substring(formatted, len(START) + 1, 1) == "1"
    parts = F.split(F.substr(formatted, F.lit(HEADER + 1)), TURN_END)
    segments = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(s: Column) -> Column:
        right = s.startswith(OPEN) & (_count(s, OPEN) == 1) & (_count(s, ROLE_END) == 1) & ~s.contains(START)
        raw_role = F.substr(F.substring_index(s, ROLE_END, 1), F.lit(len(OPEN) + 1))
        raw_text = F.substr(s, F.length(raw_role) + len(OPEN) + len(ROLE_END) + 1)
        return F.when(
            right,
            F.struct(
                F.when(escaped, unescape(raw_role)).otherwise(raw_role).alias("role"),
                F.when(escaped, unescape(raw_text)).otherwise(raw_text).alias("text"),
                F.length(raw_role).alias("role_chars"),
                F.length(raw_text).alias("text_chars"),
            ),
        )

    turns = F.transform(segments, turn)
    whole = formatted.startswith(START) & (F.element_at(parts, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, formatted, turns (recovered from it), mask (run lengths: chars, loss).

    Turns come in order of turn, then role, then text (nulls first); repeated rows are repeated turns; null roles
    and texts are empty; rows of a null conversation are one conversation. A conversation that doesn't come back
    identical after escaping raises an error. Other columns are ignored.
    """
    turns = rows.groupBy(F.col(conv)).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                )
            )
        ).alias("_in")
    )
    turns = turns.select(conv, _plain(F.col("_in")).alias("_source"))
    plain = turns.withColumn("_plain", render(F.col("_source"), 0))
    fits = F.coalesce(_plain(parse(F.col("_plain"))) == F.col("_source"), F.lit(False))
    done = plain.withColumn("formatted", F.when(fits, F.col("_plain")).otherwise(render(F.col("_source"), 1)))
    read = done.withColumn("turns", parse(F.col("formatted")))
    identical = F.coalesce(_plain(F.col("turns")) == F.col("_source"), F.lit(False))
    mask = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct((t["role_chars"] + len(OPEN) + len(ROLE_END)).alias("chars"), F.lit(False).alias("loss")),
                F.struct(t["text_chars"].alias("chars"), (t["role"] == "assistant").alias("loss")),
                F.struct(F.lit(len(TURN_END)).alias("chars"), F.lit(False).alias("loss")),
            ),
        )
    )
    return read.select(
        conv,
        F.when(identical, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its format"))).alias("formatted"),
        "turns",
        mask.alias("mask"),
    )


def loss_texts(formatted: DataFrame) -> DataFrame:
    """formatted with loss_texts: what the mask selects from the formatted text, unescaped, one text for each selected run."""
    escaped = F.substring("formatted", len(START) + 1, 1) == "1"
    cut = F.aggregate(
        "mask",
        F.struct(F.lit(HEADER + 1).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, m: F.struct(
            (a["at"] + m["chars"]).alias("at"), F.when(m["loss"], F.concat(a["out"], F.array(F.substr("formatted", a["at"], m["chars"])))).otherwise(a["out"]).alias("out")
        ),
        lambda a: a["out"],
    )
    return formatted.withColumn("loss_texts", F.transform(cut, lambda x: F.when(escaped, unescape(x)).otherwise(x)))


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What is read back from each formatted conversation, as counts and hashes; the loss is cut from the formatted text by its mask.

    A conversation is one row, so it must fit into a task's memory, as a training example must anyway.
    """
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return loss_texts(formatted).select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
