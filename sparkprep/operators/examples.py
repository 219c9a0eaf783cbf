"""Makers of training examples: question answering, mathematics, receipts, conversations with media, masks for turns."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.arrays import stands_at, upto
from sparkprep.functions.text import before_last, closed_box_from, final_answer, unboxed


def question_answering(context: Column, question: Column, answers: Column) -> dict[str, Column]:
    """input, output (the first answer) and all answers."""
    return {
        "input": F.concat(F.lit("Context: "), context, F.lit(" Question: "), question, F.lit(" Answer:")),
        "output": F.try_element_at(answers, F.lit(1)),
        "original_answers": answers,
    }


def mathematics(question: Column, answer: Column) -> dict[str, Column]:
    """input, output (the whole solution) and the final answer."""
    return {"input": F.concat(F.lit("Question: "), question, F.lit(" Answer:")), "output": answer, "original_answers": F.array(final_answer(answer))}


def solution(problem: Column, generated: Column, expected: Column) -> dict[str, Column]:
    """input, output (the whole solution) and the expected answer."""
    return {"input": F.concat(F.lit("Problem: "), problem, F.lit(" Solution:")), "output": generated, "original_answers": F.array(expected)}


def thinking_and_final(generated: Column, expected: Column) -> Column:
    """array<struct<role, thinking, content>> of the assistant's turn.

    Thinking is what stands before the last box, without a dollar sign at its end, or all of a solution without a closed box;
    boxes within it are opened. The content is the expected answer behind four hashes.
    """
    mark = "\\boxed{"
    before = before_last(generated, mark)
    from_box = F.substring(generated, F.length(before) + len(mark), F.length(generated))
    closed = F.contains(generated, F.lit(mark)) & closed_box_from(from_box)
    stripped = lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")
    thinking = stripped(F.when(closed, F.regexp_replace(before, r"(?U)\$?\s*\z", "")).otherwise(generated))
    return F.array(F.struct(F.lit("assistant").alias("role"), unboxed(thinking).alias("thinking"), F.concat(F.lit("#### "), expected).alias("content")))


def receipt(ground_truth: Column, key: Column, seed: int = 0) -> Column:
    """The tagged text of one parse of a receipt's JSON: of gt_parses one by a keyed draw, or else gt_parse."""
    kind = "gt_parses array<variant>, gt_parse variant"
    read = F.from_json(ground_truth, kind)
    parses = F.coalesce(read["gt_parses"], F.array(read["gt_parse"]))
    drawn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.size(parses)).cast("int")
    return tagged_json(F.get(parses, drawn).cast("string"))


def tagged_text(value: object) -> str:
    """A value of JSON as tagged text: keys in falling order, items of a list apart by <sep/>; a lone text_sequence as it is."""
    if isinstance(value, dict):
        if list(value) == ["text_sequence"]:
            return value["text_sequence"]
        return "".join(f"<s_{k}>{tagged_text(value[k])}</s_{k}>" for k in sorted(value, reverse=True))
    return "<sep/>".join(map(tagged_text, value)) if isinstance(value, list) else str(value)


@F.arrow_udf(T.StringType())
def tagged_json(records: pa.Array) -> pa.Array:
    """JSON text as tagged text; keys differ from row to row and nest, so this needs a Python function. Null stays null."""
    return pa.array([x if x is None else tagged_text(json.loads(x)) for x in records.to_pylist()], pa.string())


def tagged(value: Column, kind: T.DataType) -> Column:
    """A typed value as tagged text, like ``tagged_text`` but within the JVM: structs, arrays and scalars; null is None."""
    if isinstance(kind, T.StructType):
        names = kind.names
        if names == ["text_sequence"]:
            return value["text_sequence"]
        return F.concat(*(F.concat(F.lit(f"<s_{n}>"), tagged(value[n], kind[n].dataType), F.lit(f"</s_{n}>")) for n in sorted(names, reverse=True)))
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: tagged(x, kind.elementType)), "<sep/>")
    text = F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value.cast("string")
    return F.coalesce(text, F.lit("None"))


def first_turn_media(messages: Column, media: Column, role: str = "user") -> Column:
    """The turns, with the media in the first turn of ``role`` alone; turns without text go."""
    said = F.filter(messages, lambda x: F.length(F.trim(F.coalesce(x["content"], F.lit("")))) > 0)
    first = F.array_position(F.transform(said, lambda x: x["role"] == role), True)
    return F.transform(said, lambda x, i: F.struct(x["role"].alias("role"), F.when(i + 1 == first, media).alias("media"), x["content"].alias("content")))


def turn_mask(messages: Column, masked_role: str = "user", start_tokens: int = 1) -> Column:
    """Labels of a chat's words: -100 for the first turn and for turns of ``masked_role`` but for their first
    ``start_tokens`` words where the turn isn't the first; lengths of words elsewhere."""
    return F.flatten(
        F.transform(
            messages,
            lambda x, i: F.transform(
                F.split(F.coalesce(x["content"], F.lit("")), " ", -1),
                lambda w, k: F.when((i == 0) | ((x["role"] == masked_role) & (k >= start_tokens)), F.lit(-100)).otherwise(F.length(w)).cast("long"),
            ),
        )
    )


def searched_mask(ids: Column, answers: Column) -> Column:
    """1 where an answer's tokens stand: each answer is looked for behind the one found before; one that isn't found is left out."""
    empty = F.array().cast("array<struct<a: bigint, b: bigint>>")

    def step(state: Column, answer: Column) -> Column:
        n = F.size(answer)
        hits = F.filter(upto(F.size(ids) - n + 1), lambda p: (p > state["at"]) & stands_at(answer, ids, p))
        place = F.try_element_at(hits, F.lit(1)).cast("long")
        found = place.isNotNull() & (n > 0)
        span = F.array(F.struct(place.alias("a"), (place + n - 1).alias("b")))
        return F.struct(F.when(found, place + n - 1).otherwise(state["at"]).alias("at"), F.when(found, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(answers, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.transform(F.array(spans), lambda held: F.transform(ids, lambda _, i: F.exists(held, lambda s: (i + 1 >= s["a"]) & (i + 1 <= s["b"])).cast("long")))[0]


def searched_mask_of_variants(ids: Column, answers: Column, skipped: list[int] | None = None) -> Column:
    """As ``searched_mask``, where each answer is array<array<long>> of the ways its text may be tokenized: the first that is found counts.

    Places that hold one of the ``skipped`` tokens are 0.
    """
    empty = F.array().cast("array<struct<a: bigint, b: bigint>>")

    def place(v: Column, at: Column) -> Column:
        n = F.size(v)
        return F.when(n > 0, F.try_element_at(F.filter(upto(F.size(ids) - n + 1), lambda p: (p > at) & stands_at(v, ids, p)), F.lit(1)).cast("long"))

    def step(state: Column, variants: Column) -> Column:
        found = F.filter(F.transform(variants, lambda v: F.struct(place(v, state["at"]).alias("a"), F.size(v).cast("long").alias("n"))), lambda x: x["a"].isNotNull())
        hit = F.try_element_at(found, F.lit(1))
        end = hit["a"] + hit["n"] - 1
        return F.struct(F.coalesce(end, state["at"]).alias("at"), F.when(hit.isNotNull(), F.concat(state["spans"], F.array(F.struct(hit["a"].alias("a"), end.alias("b"))))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(answers, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    kept = lambda x: ~x.isin(*skipped) if skipped else F.lit(True)
    return F.transform(F.array(spans), lambda held: F.transform(ids, lambda x, i: (F.exists(held, lambda s: (i + 1 >= s["a"]) & (i + 1 <= s["b"])) & kept(x)).cast("long")))[0]


def included_module(name: Column, prefix: Column, patterns: list[str], excluded: list[str] | None = None, wanted: Column | None = None) -> Column:
    """struct<pattern, full_name> of the first pattern that is a module's name or fits its full name; null without one.

    Without patterns, modules that are ``wanted`` and that nothing excluded fits, under their own names.
    """
    if patterns and excluded:
        raise ValueError("either patterns to include or patterns to exclude")
    full = F.when(F.length(prefix) > 0, F.concat(prefix, F.lit("."), name)).otherwise(name)
    fits = lambda p: (name == p) | full.rlike("^" + re.escape(p).replace(r"\*", "(.*)") + "$")
    out = F.lit(None).cast("string")
    if patterns:
        for p in reversed(patterns):
            out = F.when(fits(p), F.lit(p)).otherwise(out)
    else:
        free = F.lit(True)
        for p in excluded or []:
            free = free & ~fits(p)
        out = F.when(free & (wanted if wanted is not None else F.lit(True)), name)
    return F.when(out.isNotNull(), F.struct(out.alias("pattern"), full.alias("full_name")))


def unmatched_patterns(names: DataFrame, name: str, prefix: str, patterns: list[str]) -> list[str]:
    """Patterns that no module fits, in their order: what a caller should be warned of. As many values as there are patterns reach the driver."""
    seen = names.select(*(F.max(included_module(F.col(name), F.col(prefix), [p]).isNotNull()).alias(f"p{i}") for i, p in enumerate(patterns))).first()
    return [p for p, hit in zip(patterns, seen) if not hit]


def chosen_option(options: Column, index: Column, fallback: Column) -> Column:
    """The option with a 0-based index, or else the fallback."""
    return F.coalesce(F.try_element_at(options, (index + 1).cast("int")), fallback)


def included(name: Column, patterns: list[str], excluded: list[str] | None = None) -> Column:
    """The first pattern that a dotted name fits, null without one; * stands for anything. Only one of the two lists may be given.

    With ``excluded``, names that fit none of it get an empty string.
    """
    if patterns and excluded:
        raise ValueError("either patterns to include or patterns to exclude")
    out = None
    for p in patterns or excluded or []:
        fits = name.rlike("^" + p.replace("*", "(.*)") + "$")
        value = F.lit(p) if patterns else F.lit(None).cast("string")
        out = F.when(fits, value) if out is None else out.when(fits, value)
    rest = F.lit(None).cast("string") if patterns else F.lit("")
    return out.otherwise(rest) if out is not None else rest


def subsets(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of several subsets, with the subset's name; columns by name, those that one lacks are null."""
    first, *rest = (df.withColumn("subset", F.lit(name)) for name, df in parts.items())
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
