"""Chat formatting by a finite-state machine over roles and a declarative template, with DataFrame operations only.

One row for each conversation: the formatted string, its segments with a loss flag each, and what the machine found.
A conversation that breaks the turn order is formatted all the same and marked, with the first turn that broke it.

Control strings begin with `<|`. In a text, `<` + backslashes + `|` gets one backslash more, so no text holds a
control string, and taking one away again restores it. Roles also escape line ends, since one ends the role.

Null text counts as empty, a null role as the empty role, which no transition knows. Turns go by number, nulls first,
then by role and text; repeated rows are repeated turns. Rows of a null conversation form one conversation. A
conversation is one training example and so one row, as its hash needs it whole. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Stands for a line end inside a role.
LINE_END = "<|nl|>"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are learned, and which role may follow which."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; a role is also the state it leads to
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A line end becomes a control string of its own; an escaped role holds no other."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE_END))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE_END), F.lit("\n")))


def format_chats(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, valid, broken_turn (null if none), segments array<struct<text, loss>>, formatted."""
    t = template or Template()
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = df.groupBy(conv).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for s, roles in t.follows.items() for r in roles for x in (f"{s}>{r}", r)])

    def step(state: Column, x: Column) -> Column:
        to = F.element_at(moves, F.concat(state["at"], F.lit(">"), x["role"]))
        broken = F.when(state["broken"].isNull() & to.isNull(), state["n"]).otherwise(state["broken"])
        return F.struct(F.coalesce(to, F.lit("broken")).alias("at"), (state["n"] + 1).alias("n"), broken.alias("broken"))

    begin = F.struct(F.lit(t.start).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("broken"))
    ran = F.aggregate("turns", begin, step)

    def segment(x: Column) -> Column:
        quiet = F.lit(False).alias("loss")
        return F.array(
            F.struct(F.concat(F.lit(t.before_role), escape_role(x["role"]), F.lit(t.after_role)).alias("text"), quiet),
            F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.after_text).alias("text"), quiet),
        )

    return chats.select(
        conv,
        (ran["broken"].isNull() & ran["at"].isin(*t.final)).alias("valid"),
        ran["broken"].alias("broken_turn"),
        F.flatten(F.transform("turns", segment)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted string again: array<struct<role, text>>."""
    t = template or Template()
    quoted = rf"\Q{t.before_role}\E"
    parts = F.split(formatted, quoted)
    tail = len(t.after_text)

    def turn(part: Column) -> Column:
        at = F.instr(part, t.after_role)
        return F.struct(
            unescape_role(F.substring(part, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(part, at + len(t.after_role), F.char_length(part) - at - len(t.after_role) + 1 - tail)).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
