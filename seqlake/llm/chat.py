"""Prefix-target expansion of conversations, in DataFrame functions only.

Each assistant turn becomes an example: all preceding turns formatted as context, and that reply alone as the trainable
target. Turns after the last reply form one example without a target, so that nothing of a conversation is lost.

Template: a user turn is "<s>[INST] text [/INST]", a system turn "<<SYS>> text <</SYS>>", a reply " text </s>"; a turn
of any other role is "<<role>> text <</role>>" with the role escaped too. Escaping: "\" becomes "\\", and a "\" is put
behind the first character of each control string and of each "<<" inside a text, so that no control string of the
template can occur in it. Each "\" is thus followed by the character that it protects, and dropping it from each pair
restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<")


def escape(text: Column) -> Column:
    """Reversible: unescape(escape(x)) = x for every string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, r"<(?=s>|/s>|<)", r"<\\")
    return F.regexp_replace(out, r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """An unusual role's name between its markers: brackets are protected as well."""
    return F.regexp_replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), r"([<>\[\]])", r"\\$1")


def format_turn(role: Column, text: Column) -> Column:
    body = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(" "), body, F.lit(" </s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>> "), body, F.lit(" <</SYS>>")))
        .otherwise(F.concat(F.lit("<<role "), _role(role), F.lit(">> "), body, F.lit(" <</role>>")))
    )


#: An escaped role. Possessive, so that the engine neither recurses nor steps back, however long the role is.
NAME = r"[^<>\[\]\\]*+(?:\\.[^<>\[\]\\]*+)*+"
#: One formatted turn; the groups hold the bodies of user, system, other and assistant turns (escaped).
TURN = (
    r"(?s)<s>\[INST\] (?:.*?) \[/INST\]"
    r"|<<SYS>> (?:.*?) <</SYS>>"
    rf"|<<role {NAME}>> (?:.*?) <</role>>"
    r"| (?:.*?) </s>"
)


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of one formatted turn."""
    named = lambda start, end, role: F.struct(role.alias("role"), unescape(F.substr(turn, F.lit(start + 1), F.length(turn) - (start + end))).alias("text"))
    other = F.regexp_extract(turn, rf"(?s)^<<role ({NAME})>> ", 1)
    body = F.substr(turn, F.length(other) + F.lit(len("<<role >> ") + 1), F.length(turn) - F.length(other) - (len("<<role >> ") + len(" <</role>>")))
    return (
        F.when(F.startswith(turn, F.lit("<s>[INST] ")), named(len("<s>[INST] "), len(" [/INST]"), F.lit("user")))
        .when(F.startswith(turn, F.lit("<<SYS>> ")), named(len("<<SYS>> "), len(" <</SYS>>"), F.lit("system")))
        .when(F.startswith(turn, F.lit("<<role ")), F.struct(unescape(other).alias("role"), unescape(body).alias("text")))
        .otherwise(named(1, len(" </s>"), F.lit("assistant")))
    )


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_context, context, target): one row per assistant turn, in order from 0, and one with an
    empty target for turns after the last reply.

    Trainable is target alone, and of it the reply's text (loss_start characters in, loss_chars long, escaped). Rows are
    ordered by turn, ties by role and text, null turns first; a null text is empty, a null role is the role "". A null
    conv_id is a conversation of its own. Repeated rows are turns like others. An empty table gives no rows. Other
    columns are not read. A conversation and each of its examples are one row: it is meant to fit into memory.
    """
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text"))).alias("turns"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: format_turn(t.role, t.text)).alias("parts"), F.transform("turns", lambda t: t.role == "assistant").alias("reply"))
    n = F.size("parts")
    replies = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("reply", i))
    ends = F.when(F.get("reply", n - 1), replies).otherwise(F.concat(replies, F.array(n)))
    rows = convs.select("conv_id", "parts", F.posexplode(ends).alias("example", "end"))
    target = F.coalesce(F.get("parts", F.col("end")), F.lit(""))
    return rows.select("conv_id", "example", F.col("end").alias("n_context"), F.array_join(F.slice("parts", F.lit(1), F.col("end")), "").alias("context"), target.alias("target"))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, recovered from the formatted examples: the turns of the longest example, the texts
    under the loss mask of all of them, and the characters of all of them."""
    loss = F.when(F.col("target") == "", F.lit("")).otherwise(parse_turn(F.col("target")).getField("text"))
    last = F.max_by(F.concat("context", "target"), "example")
    got = examples.groupBy("conv_id").agg(
        last.alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x.loss), "").alias("loss"),
        F.sum(F.length("context") + F.length("target")).alias("formatted_chars"),
    )
    return got.select("conv_id", F.transform(F.regexp_extract_all("whole", F.lit(TURN), F.lit(0)), parse_turn).alias("turns"), "loss", "formatted_chars")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: see read_back()."""
    back = read_back(expand(conversations))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
