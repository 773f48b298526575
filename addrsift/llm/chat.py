"""Conversations as one training text with a loss mask, in Spark expressions.

The rows of a conversation are collected as structs and sorted; adjacent turns
of one role become one block; blocks are concatenated with control strings.
Control strings inside texts are escaped, so that the output can be read back.

With the default template, two user texts and an answer read

    [INST]user[/INST]first<s>second</s>[INST]assistant[/INST]answer</s>
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + body starts a block, joint stands between its texts, close
    ends it.  Each control string starts with one of < and [ and has neither
    further on, so none can form across a seam.  trained: roles under the loss
    mask."""

    open: str = "[INST]"
    body: str = "[/INST]"
    joint: str = "<s>"
    close: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if len(set(self.controls)) != 4 or not all(re.fullmatch(r"[<\[][^<\[\\]+", c) for c in self.controls):
            raise ValueError("control strings must differ, start with < or [, and have neither of them nor \\ further on")

    @property
    def controls(self) -> tuple[str, str, str, str]:
        return (self.open, self.body, self.joint, self.close)


def _tails(template: Template) -> str:
    return "|".join(re.escape(c[1:]) for c in template.controls)


def escaped(text: Column, template: Template = Template()) -> Column:
    r"""Control strings get a \ after their first character; so do strings that
    look like an escaped one, one more each time."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_tails(template)})", r"$1\\$2")


def unescaped(text: Column, template: Template = Template()) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_tails(template)})", "$1$2")


def _running_starts(sizes: Column, block: int = 1000) -> Column:
    """The sum of the elements before each one.  In two levels, so that long
    arrays don't cost the square of their length."""
    def starts(of: Column, first: Column) -> Column:
        return F.aggregate(
            of, F.struct(first.alias("next"), F.array().cast("array<bigint>").alias("all")),
            lambda acc, x: F.struct((acc.next + x).alias("next"), F.concat(acc["all"], F.array(acc.next)).alias("all")),
            lambda acc: acc["all"],
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))),
        lambda i: F.slice(sizes, i * block + 1, block),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(blocks, starts(sums, F.lit(0).cast("bigint")), starts))


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask.

    ``rows`` has conv_id, turn, role and text.  ``mask`` holds (start, bytes)
    of each trained text in the UTF-8 of ``formatted``, in order; joints and
    other control strings are outside.

    Rows go by turn, nulls first, ties by role and text.  A null role or text
    counts as empty; repeated rows are turns of their own; a null conv_id is a
    conversation like others.  No rows give no conversations.  Other columns
    are ignored.  A conversation is one row whatever its length, as its format
    is one text: a very long one must fit a row (2 GB).
    """
    t = template
    sorted_turns = rows.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
        ).alias("turns")
    )
    turns, n = F.col("turns"), F.size("turns")
    # where a block of one role begins
    heads = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, F.greatest(i - 2, F.lit(0)))["role"]))
    blocks = sorted_turns.select("conv_id", "turns", heads.alias("heads")).select(
        "conv_id",
        F.transform(
            "heads",
            lambda at, k: F.slice(turns, at, F.coalesce(F.get("heads", k + 1), n + 1) - at),
        ).alias("blocks"),
    )
    # each text with what stands before and after it
    def pieces(block: Column) -> Column:
        role = F.get(block, F.lit(0))["role"]
        head = F.concat(F.lit(t.open), escaped(role, t), F.lit(t.body))
        return F.transform(
            block,
            lambda x, i: F.struct(
                F.when(i == 0, head).otherwise(F.lit(t.joint)).alias("before"),
                escaped(x["text"], t).alias("text"),
                F.when(i == F.size(block) - 1, F.lit(t.close)).otherwise(F.lit("")).alias("after"),
                role.isin(*t.trained).alias("trained"),
            ),
        )

    spelt = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    sizes = F.transform("pieces", lambda p: (F.octet_length(p["before"]) + F.octet_length(p["text"]) + F.octet_length(p["after"])).cast("bigint"))
    placed = spelt.withColumn("starts", _running_starts(sizes))
    spans = F.zip_with(
        "pieces", "starts",
        lambda p, s: F.struct(
            p["trained"].alias("trained"), (s + F.octet_length(p["before"])).alias("start"), F.octet_length(p["text"]).cast("bigint").alias("bytes")
        ),
    )
    return placed.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["bytes"].alias("bytes"))).alias("mask"),
    )


def read_back(formatted: str | Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    t = template

    def parts(of: Column, control: str) -> Column:
        return F.split(of, re.escape(control), -1)

    def turns(block: Column) -> Column:
        role_and_body = parts(block, t.body)
        role = unescaped(F.substr(F.get(role_and_body, F.lit(0)), F.lit(len(t.open) + 1)), t)
        return F.transform(
            parts(F.get(role_and_body, F.lit(1)), t.joint), lambda x: F.struct(role.alias("role"), unescaped(x, t).alias("text"))
        )

    blocks = parts(text, t.close)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def under_mask(formatted: str | Column, mask: str | Column, template: Template = Template()) -> Column:
    """The trained texts, unescaped, one after the other."""
    raw = F.encode(F.col(formatted) if isinstance(formatted, str) else formatted, "UTF-8")
    spans = F.col(mask) if isinstance(mask, str) else mask
    cut = F.transform(spans, lambda s: F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))
    return F.array_join(F.transform(cut, lambda x: unescaped(x, template)), "")
