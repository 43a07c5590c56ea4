"""Chat formatting: a finite-state machine over roles and text segments with loss flags, from a declarative template.

Native: DataFrame functions only. A conversation's turns meet in one array (it is one training example); nothing else is
gathered. Control strings inside texts are escaped reversibly: each opening or closing character of a marker, and the
escape character itself, becomes a two-character code, so no marker can arise from a text.

Cases: a null text or role is the empty string; turns are ordered by turn (nulls first), then role and text; repeated rows
are repeated turns; a null conv_id is one conversation; roles that the machine does not know, or out of order, are formatted all
the same and marked not valid; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers around each turn, the codes that keep texts free of them, the roles with a loss, and the machine.

    A turn is open_role + role + close_role + text + end_turn. states[state][role] is the next state.
    """

    start: str = "<s>"
    open_role: str = "[INST "
    close_role: str = "]"
    end_turn: str = "</s>"
    codes: tuple[tuple[str, str], ...] = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
    loss_roles: tuple[str, ...] = ("assistant",)
    first_state: str = "start"
    last_states: tuple[str, ...] = ("answered",)
    states: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {"start": {"system": "instructed", "user": "asked"}, "instructed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})


def escape(text: Column, template: Template) -> Column:
    for plain, code in template.codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    for plain, code in reversed(template.codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def final_state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles; null once a role does not fit."""
    moves = F.create_map(*(F.lit(x) for state, to in template.states.items() for role, after in to.items() for x in (f"{state}>{role}", after)))
    return F.aggregate(roles, F.lit(template.first_state), lambda state, role: F.try_element_at(moves, F.concat(state, F.lit(">"), role)))


def format_conversations(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, n_turns, valid, segments (text, loss), formatted, and loss_spans (start, length) in characters.

    A turn's start is a running sum over its conversation, so work is linear in turns; the sum and the gathering share one exchange.
    """
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("head", F.concat(F.lit(template.open_role), escape(F.col("role"), template), F.lit(template.close_role))).withColumn("body", escape(F.col("text"), template))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    width = F.char_length("head") + F.char_length("body") + F.lit(len(template.end_turn))
    own = own.withColumn("start", F.lit(len(template.start)) + F.coalesce(F.sum(width).over(before), F.lit(0)))
    turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "role", "head", "body"))).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    spoken = lambda t: t.role.isin(*template.loss_roles)
    parts = F.flatten(F.transform("turns", lambda t: F.array(segment(t.head, off), segment(t.body, spoken(t)), segment(F.lit(template.end_turn), off))))
    state = final_state(F.transform("turns", lambda t: t.role), template)
    whole = F.concat(F.lit(template.start), F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(template.end_turn))), ""))
    spans = F.transform(F.filter("turns", spoken), lambda t: F.struct((t.start + F.char_length(t["head"])).cast("int").alias("start"), F.char_length(t.body).alias("length")))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.coalesce(state.isin(*template.last_states), off).alias("valid"), F.concat(F.array(segment(F.lit(template.start), off)), parts).alias("segments"), whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds, from the formatted text and its loss spans alone: turns (role, text) and loss_text."""
    quote = lambda s: "\\Q" + s + "\\E"
    body = F.substring("formatted", F.lit(len(template.start) + 1), F.char_length("formatted"))
    pieces = F.split(body, quote(template.end_turn), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(template.open_role) + 1), F.char_length(piece))
        cut = F.instr(inner, template.close_role)
        return F.struct(unescape(F.substring(inner, F.lit(1), cut - 1), template).alias("role"), unescape(F.substring(inner, cut + len(template.close_role), F.char_length(inner)), template).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length), template)), "")
    return formatted.withColumn("turns", F.transform(pieces, parse)).withColumn("loss_text", loss)


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of what was read back."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
