"""Chat formatting from a declarative template, in Spark SQL expressions alone.

A finite-state machine over roles says whether the turns of a conversation come
in a permitted order. The template gives each role a prefix, a suffix and a
loss flag; a turn becomes three segments, of which only an assistant's text is
under the loss mask. Control strings inside texts are escaped so that reading
back restores them: a backslash is doubled, and ``\\.`` goes behind the first
character of a control string.

Defined results: null texts and roles are empty ones; unknown roles get a
generic marker, carry no loss and make the order invalid; turns are ordered by
turn, then role, then text, so that ties and repeated rows have one result;
columns beside the four never matter; rows with a null conversation id form one conversation; a conversation must fit
a row, as its output is one text; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers by role; every control string that a text could imitate."""

    open: str = "<|"
    close: str = "|>\n"
    end: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


#: The machine: after a state, the roles that may follow and the state each leads to. "" is the start.
TURNS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def valid_order(roles: Column, turns: dict[str, tuple[str, ...]] = TURNS) -> Column:
    """Whether the machine accepts an array of roles: one fold over states, null once it fails."""

    def step(state: Column, role: Column) -> Column:
        allowed = F.lit(False)
        for before, after in turns.items():
            allowed = allowed | ((state == before) & role.isin(*after))
        return F.when(allowed, role)

    return F.aggregate(roles, F.lit("").cast("string"), step).isNotNull()


def escaped(text: Column, template: Template) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    heads = "|".join(f"{re.escape(c[0])}(?={_java(c[1:])})" for c in template.control)
    return F.regexp_replace(doubled, f"({heads})", r"$1\\.")


def _java(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in text)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def format_chats(rows: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, formatted, segments (start, length, loss, over ``formatted``), valid."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss_roles = F.array(*[F.lit(r) for r in template.loss_roles])

    def three(t: Column) -> Column:
        prefix = F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.close))
        return F.array(
            F.struct(prefix.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), F.array_contains(loss_roles, t["role"]).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    parts = chats.select("id", F.flatten(F.transform("turns", three)).alias("parts"), valid_order(F.transform("turns", lambda t: t["role"])).alias("valid"))
    sized = parts.withColumn("lengths", F.transform("parts", lambda p: F.length(p["text"])))
    laid = F.transform(
        F.arrays_zip(running_starts(F.col("lengths")).alias("start"), F.col("parts").alias("part")),
        lambda z: F.struct(z["start"].alias("start"), F.length(z["part"]["text"]).alias("length"), z["part"]["loss"].alias("loss")),
    )
    return sized.select(F.col("id").alias(id_col), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), laid.alias("segments"), "valid")


def running_starts(lengths: Column) -> Column:
    """Where each of consecutive pieces begins, from 1 on.

    Sums run inside blocks of about the square root of the array's size, then
    over the blocks, as a fold copies what it has gathered at every step.
    """
    n = F.size(lengths)
    block = F.ceil(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), block), lambda i: F.slice(lengths, i + 1, block))
    inside = F.transform(blocks, lambda b: F.aggregate(b, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))))
    first = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("starts"))

    def shifted(done: Column, sums: Column) -> Column:
        own = F.transform(F.slice(sums, 1, F.size(sums) - 1), lambda x: x + done["at"])
        return F.struct((done["at"] + F.element_at(sums, -1)).alias("at"), F.concat(done["starts"], F.array(own)).alias("starts"))

    return F.aggregate(inside, first, shifted, lambda done: F.flatten(done["starts"]))


def masked(text: Column, segments: Column) -> Column:
    """What the segments with loss cut out of the text, in their order.

    Cut in two steps, as finding a place counts from the beginning: the stretch
    of about as many segments as the root of their number, then each in its own.
    """
    wanted = F.filter(segments, lambda s: s["loss"])
    n = F.size(wanted)
    block = F.ceil(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), block), lambda i: F.slice(wanted, i + 1, block))

    def cut(part: Column) -> Column:
        first = F.array_min(F.transform(part, lambda s: s["start"]))
        end = F.array_max(F.transform(part, lambda s: s["start"] + s["length"]))
        both = F.array(F.struct(F.substring(text, first, end - first).alias("text"), first.alias("first")))
        return F.flatten(F.transform(both, lambda b: F.transform(part, lambda s: F.substring(b["text"], s["start"] - b["first"] + 1, s["length"]))))

    return F.flatten(F.transform(blocks, cut))


def read_back(chats: DataFrame, template: Template = Template(), id_col: str = "conv_id") -> DataFrame:
    """Turns and loss text recovered from ``formatted`` and ``segments``: adds turns (role, text) and loss_text.

    Turns are parsed from the markers; the loss text is what the mask cuts out.
    """
    pattern = f"(?s){_java(template.open)}(.*?){_java(template.close)}(.*?){_java(template.end)}"
    roles = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))
    loss = F.array_join(F.transform(masked(F.col("formatted"), F.col("segments")), unescaped), "")
    return chats.withColumn("turns", turns).withColumn("loss_text", loss)
