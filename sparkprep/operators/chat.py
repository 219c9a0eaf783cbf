"""Chat records: normal form, the older rendering with headers, labels and speakers, and which of its tokens are learnt from.

A conversation is array<struct<from, value, label>> with a system text, a type and a mask of speakers; ``tokenize`` makes a
column of token arrays from a column of texts, so any tokenizer serves that can be said as one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkprep.functions.arrays import IGNORE, find_array

#: The types of a conversation: a label behind the text that it describes, or before the text made for it.
TEXT_TO_VALUE, VALUE_TO_TEXT = "TEXT_TO_VALUE", "VALUE_TO_TEXT"


@dataclass(frozen=True)
class Marks:
    """What stands around the parts of a rendered conversation."""

    system_start: str = "<extra_id_0>"
    turn_start: str = "<extra_id_1>"
    label_start: str = "<extra_id_2>"
    name_end: str = "\n"
    turn_end: str = "\n"
    system_name: str = "System"


def normal_messages(conversations: Column, system: Column | None = None) -> Column:
    """array<struct<role, content>>: speakers in lower case as roles; a system text that isn't empty comes first."""
    turns = F.transform(conversations, lambda x: F.struct(F.lower(x["from"]).alias("role"), x["value"].alias("content")))
    if system is None:
        return turns
    first = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.when(F.length(system) > 0, F.concat(first, turns)).otherwise(turns)


def known_kind(kind: Column) -> Column:
    """The type of a conversation; one that isn't known is an error."""
    return F.when(kind.isNull() | kind.isin(TEXT_TO_VALUE, VALUE_TO_TEXT), kind).otherwise(F.raise_error(F.concat(F.lit("no such type: "), kind)))


def header(system: Column, marks: Marks = Marks()) -> Column:
    """The system turn that a rendered conversation begins with."""
    return F.concat(F.lit(marks.system_start + marks.system_name + marks.name_end), F.coalesce(system, F.lit("")), F.lit(marks.turn_end))


def formatted_label(label: Column, marks: Marks = Marks()) -> Column:
    """A label between its marks; none without one."""
    return F.coalesce(F.concat(F.lit(marks.label_start), label, F.lit(marks.name_end)), F.lit(""))


def turn_texts(conversations: Column, kind: Column, marks: Marks = Marks()) -> Column:
    """Each turn with its speaker, marks, and its label before (VALUE_TO_TEXT) or behind it (TEXT_TO_VALUE)."""

    def turn(x: Column) -> Column:
        label = formatted_label(x["label"], marks)
        before = F.when(kind == VALUE_TO_TEXT, label).otherwise(F.lit(""))
        behind = F.when(kind == TEXT_TO_VALUE, label).otherwise(F.lit(""))
        return F.concat(F.lit(marks.turn_start), x["from"], F.lit(marks.name_end), before, F.coalesce(x["value"], F.lit("")), F.lit(marks.turn_end), behind)

    return F.transform(conversations, turn)


def masked(speaker: Column, mask: Column) -> Column:
    """Whether a speaker's name stands in the mask."""
    return F.contains(mask, speaker)


def rendered(system: Column, conversations: Column, kind: Column, mask: Column, marks: Marks = Marks()) -> Column:
    """The whole conversation; if the last speaker isn't masked, a turn's start mark ends it. The mask defaults to User."""
    last = F.element_at(conversations, -1)["from"]
    closing = F.when(masked(last, F.coalesce(mask, F.lit("User"))), F.lit("")).otherwise(F.lit(marks.turn_start))
    return F.concat(header(system, marks), F.array_join(turn_texts(conversations, known_kind(kind), marks), ""), closing)


def learnt(header_size: Column, turns: Column, kind: Column, size: Column) -> Column:
    """array<long> of 0 and 1 over ``size`` tokens: which are learnt from.

    ``turns`` is array<struct<n, name, start, label, labelled, masked>>: a turn's tokens, those of its name part, those of a turn's start mark, where its
    label begins (-1 without one), tokens from there to the label's end, and whether its speaker is masked.
    """

    def hidden(x: Column, i: Column) -> Column:
        """(from, to) of the places of a turn that aren't learnt from."""
        whole = F.struct(F.lit(0).cast("long").alias("a"), x["n"].alias("b"))
        but_start = F.struct(x["start"].alias("a"), x["n"].alias("b"))
        skip = F.when((x["label"] >= 0) & (kind == VALUE_TO_TEXT), x["name"] + x["labelled"]).when((x["label"] >= 0) & (kind == TEXT_TO_VALUE), x["label"] + x["labelled"]).otherwise(x["name"])
        name = F.struct(F.lit(0).cast("long").alias("a"), skip.alias("b"))
        partial = (x["label"] >= 0) & (kind == VALUE_TO_TEXT) & (x["labelled"] < 0)  # the label has no end: nothing of the turn is learnt
        opening = (i == 0) & (kind.isNull() | (kind == VALUE_TO_TEXT))
        late = (i > 1) | ((i == 1) & (kind == TEXT_TO_VALUE))
        return F.when(partial | opening, whole).when(x["masked"] & late, but_start).when(x["masked"], whole).otherwise(name)

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a: bigint, b: bigint>>").alias("spans"))
    spans = F.transform(F.array(F.transform(turns, lambda x, i: F.struct(x["n"].alias("n"), hidden(x, i).alias("h")))), lambda ts: F.aggregate(ts, zero, lambda s, t: F.struct((s["at"] + t["n"]).alias("at"), F.concat(s["spans"], F.array(F.struct((s["at"] + t["h"]["a"]).alias("a"), (s["at"] + F.least(t["h"]["b"], t["n"])).alias("b")))).alias("spans")), lambda s: s["spans"]))[0]
    places = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    seen = lambda held: F.transform(places, lambda i: (~((i < header_size) | F.exists(held, lambda s: (i - header_size >= s["a"]) & (i - header_size < s["b"])))).cast("long"))
    return F.transform(F.array(spans), seen)[0]


def preprocessed(system: Column, conversations: Column, kind: Column, mask: Column, tokenize: Callable[[Column], Column], marks: Marks = Marks()) -> dict[str, Column]:
    """input_ids, labels (-100 where nothing is learnt), loss_mask, context_size (behind the last -100) of a conversation.

    A conversation that nothing is learnt from, or whose mask names no speaker of its, is an error. ``tokenize`` is called on
    the whole text, the header and each turn, so it should be an expression.
    """
    who = F.coalesce(mask, F.lit("User"))
    texts = turn_texts(conversations, known_kind(kind), marks)
    label_start, name_end = tokenize(F.lit(marks.label_start)), tokenize(F.lit(marks.name_end))

    def turn(text: Column, i: Column) -> Column:
        speaker = F.get(conversations, i)["from"]
        tokens, name = tokenize(text), F.size(tokenize(F.concat(F.lit(marks.turn_start), speaker, F.lit(marks.name_end)))).cast("long")
        at = find_array(label_start, tokens)
        end = find_array(name_end, F.slice(tokens, (name + 1).cast("int"), F.size(tokens)))
        labelled = F.when(kind == VALUE_TO_TEXT, F.when(end < 0, F.lit(-1)).otherwise(end + F.size(name_end))).otherwise(F.size(label_start)).cast("long")
        start = F.size(tokenize(F.lit(marks.turn_start))).cast("long")
        return F.struct(F.size(tokens).cast("long").alias("n"), name.alias("name"), start.alias("start"), at.alias("label"), labelled.alias("labelled"), masked(speaker, who).alias("masked"))

    ids = tokenize(rendered(system, conversations, kind, mask, marks))
    loss = learnt(F.size(tokenize(header(system, marks))).cast("long"), F.transform(texts, turn), kind, F.size(ids))
    speakers = F.transform(conversations, lambda x: x["from"])
    known = F.forall(F.split(who, ","), lambda s: F.array_contains(speakers, s))
    checked = F.when(known & F.exists(loss, lambda x: x == 1), loss).otherwise(F.raise_error("nothing is learnt from a conversation, or its mask names no speaker of it").cast("array<bigint>"))
    return {
        "input_ids": ids,
        "labels": F.zip_with(ids, checked, lambda x, m: F.when(m == 1, x.cast("long")).otherwise(F.lit(IGNORE).cast("long"))),
        "loss_mask": checked,
        "context_size": F.coalesce(F.array_max(F.transform(checked, lambda m, i: F.when(m == 0, i + 1))), F.lit(0)).cast("long"),
    }
