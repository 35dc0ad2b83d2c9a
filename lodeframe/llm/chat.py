"""Chat formatting by a finite-state machine over roles and a declarative template, with DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, strings that must not occur in a text, and the allowed turn orders.

    Each control string starts with ``<`` or ``[``, has neither of them further on and holds no backslash; so occurrences can't overlap, and a backslash after the first character hides one. ``moves`` maps ``state>role`` to the next state; ``trained`` lists the roles whose text counts for the loss.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, str] = field(default_factory=lambda: {"start>system": "told", "start>user": "asked", "told>user": "asked", "asked>assistant": "answered", "answered>user": "asked", "answered>tool": "asked"})
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        for c in self.controls:
            if not re.fullmatch(r"[<\[][^<\[\\\n]+", c):
                raise ValueError(f"control string {c!r} must start with its only < or [ and hold no backslash")
        if self.open not in self.controls or self.close not in self.controls:
            raise ValueError("the marks must be control strings")

    @property
    def tails(self) -> str:
        return "|".join(re.escape(c[1:]) for c in sorted(self.controls))


def escape(text: Column, template: Template) -> Column:
    """One more backslash after the first character of whatever looks like a control string, hidden or not."""
    return F.regexp_replace(text, rf"(?<=[<\[])(?=\\*(?:{template.tails}))", r"\\")


def unescape(text: Column, template: Template) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(text, rf"(?<=[<\[])\\(?=\\*(?:{template.tails}))", "")


def escape_role(role: Column, template: Template) -> Column:
    """A role stands on one line."""
    return F.replace(F.replace(escape(role, template), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column, template: Template) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")), template)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (array of text, loss), valid, fault_turn; the segments joined are the formatted conversation.

    rows: conv_id, turn, role, text in any order; ties of a turn stand in the order of role and text, repeated rows stay. Null roles and texts read as empty, null turns come first, a null conv_id is one more conversation. A conversation whose turn order the machine refuses is formatted all the same, with valid false and the place (from 0) of the first turn refused, or the number of turns if it ends too early, in fault_turn. An empty table gives no rows.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        segment = lambda s, on: F.struct(s.alias("text"), on.alias("loss"))
        return F.array(
            segment(F.concat(F.lit(template.open), escape_role(t["role"], template), F.lit("\n")), F.lit(False)),
            segment(escape(t["text"], template), t["role"].isin(*template.trained)),
            segment(F.lit(template.close + "\n"), F.lit(False)),
        )

    moves = F.create_map(*[F.lit(x) for pair in sorted(template.moves.items()) for x in pair])

    def step(state: Column, t: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(state["at"], F.lit(">"), t["role"])), F.lit("refused"))
        return F.struct(to.alias("at"), (state["n"] + (to != "refused").cast("int")).alias("n"))

    machine = F.aggregate("turns", F.struct(F.lit("start").alias("at"), F.lit(0).alias("n")), step)
    run = whole.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), machine.alias("run"))
    valid = F.col("run.at").isin(*template.final)
    return run.select("conv_id", "segments", valid.alias("valid"), F.when(~valid, F.col("run.n").cast("long")).alias("fault_turn"))


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, as an array of role and text, in their order, repeated ones too; null for null, and no turns for an empty text."""

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(template.open) + 1), F.char_length(piece))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.char_length(role) + 2, F.char_length(body))
        return F.struct(unescape_role(role, template).alias("role"), unescape(text, template).alias("text"))

    pieces = F.split(formatted, re.escape(template.close) + "\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def op5_chat(spark, sf_dir):
    """Digests of all conversations and of one that quotes control strings, read back from the formatted text and its loss mask."""
    template = Template()
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_conversations(rows.unionByName(quoting), template).withColumn("formatted", joined(F.col("segments")))
    read = done.withColumn("back", parse(F.col("formatted"), template)).withColumn("learned", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)))
    loss = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    regexp_replace(text, '([<\[])(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]))', '\1\\\2', 'g') AS hidden
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(hidden) + 10 + 1)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END, '' ORDER BY k), 's?ua([ut]a)*') AS valid
FROM e GROUP BY conv_id
"""
