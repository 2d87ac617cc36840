"""Chat formatting: a state machine over roles, a declarative template, segments with loss flags.

Built-in functions only. Turns become segments of text and flag before they meet; what meets in one
row is one conversation, as the formatted text is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a role and a text, roles whose text is learned, and allowed role changes.

    `open` and `close` must begin with "<|"; texts and roles cannot hold that, as "<|" in them is
    written "<\\|" and "\\" is written "\\\\". A line break in a role is written "\\n".
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    changes: tuple[tuple[str, str, str], ...] = field(
        default=(  # state, role, next state; whatever is not listed is an error, from which no way leads back
            ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
            ("user", "assistant", "assistant"), ("assistant", "user", "user"),
            ("assistant", "tool", "tool"), ("tool", "assistant", "assistant"),
        )
    )
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # "\n" stands for a line break only where its backslash is not itself a written "\\"
    parts = F.split(role, r"\\\\", -1)
    parts = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(parts, "\\")


def end_state(roles: Column, template: Template) -> Column:
    """The state in which a conversation's roles leave the machine; 'error' once a change is not allowed."""
    steps = F.create_map(*[F.lit(x) for s, r, n in template.changes for x in (f"{s}\n{r}", n)])
    return F.aggregate(
        roles, F.lit(template.start),
        lambda state, role: F.coalesce(F.element_at(steps, F.concat(state, F.lit("\n"), role)), F.lit("error")),
    )


def format_conversations(
    turns: DataFrame, template: Template = Template(), conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """One row per conversation: id, valid, formatted and segments (text, loss), whose texts joined are formatted.

    Turns are taken in the order of turn, role, text; nulls come first. Null text or role: empty.
    Rows with a null conversation id are one conversation of that id. Repeated rows are turns of
    their own. valid: the state machine accepts the roles. Empty table: no rows. Other columns are
    ignored, whatever their names.
    """
    role, text = F.coalesce(F.col(role_column), F.lit("")), F.coalesce(F.col(text_column), F.lit(""))
    learned = role.isin(*template.learned)
    segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    segments = F.array(
        segment(F.concat(F.lit(template.open), escape_role(role), F.lit("\n")), F.lit(False)),
        segment(escape(text), learned),
        segment(F.lit(template.close + "\n"), F.lit(False)),
    )
    rows = turns.select(
        F.col(conv_column).alias("conv"),
        F.struct(F.col(turn_column).alias("turn"), role.alias("role"), text.alias("text"), segments.alias("segments")).alias("row"),
    )
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    whole = whole.select(
        "conv", end_state(F.transform("rows", lambda x: x["role"]), template).isin(*template.final).alias("valid"),
        F.flatten(F.transform("rows", lambda x: x["segments"])).alias("segments"),
    )
    return whole.select(
        F.col("conv").alias(conv_column), "valid",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "segments",
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, F.lit("\\Q" + template.open + "\\E"), -1), lambda x: x != "")
    close = template.close + "\n"
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(close))).alias("text"),
        ),
    )
