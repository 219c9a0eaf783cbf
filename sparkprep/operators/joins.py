"""Joins and lookups over records, rules and keys. Which side is broadcast is left to the planner, who knows the sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_manifest(records: DataFrame, manifest: DataFrame, key: str, order: str) -> DataFrame:
    """Records with their manifest entries; of entries with one key the last by ``order`` counts. Records without one go."""
    names = [c for c in manifest.columns if c != key]
    last = manifest.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("last")).select(key, "last.*")
    return records.join(last, key)


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that ``present`` lacks."""
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def key_plan(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, state): both, missing (wanted alone) or placeholder (present alone)."""
    a = wanted.select(key).distinct().withColumn("a", F.lit(True))
    b = present.select(key).distinct().withColumn("b", F.lit(True))
    state = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "missing").otherwise("placeholder")
    return a.join(b, key, "full").select(key, state.alias("state"))


def first_rule(name: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule number, target) of the first rule that fits a name; null without one.

    A pattern's * stands for digits and ** for anything; the target's stars take what they stood for. Rules are few and
    given by the caller, so they become one expression and no join is needed.
    """
    number = target = None
    for i, (pattern, replaced) in enumerate(rules):
        regex = "^" + "".join({"**": "(.*)", "*": r"(\d+)"}.get(x, re.escape(x)) for x in re.split(r"(\*\*|\*)", pattern)) + "$"
        k, parts = 0, []
        for x in re.split(r"(\*\*|\*)", replaced):
            if x in ("*", "**"):
                k += 1
                parts.append(F.regexp_extract(name, regex, k))
            elif x:
                parts.append(F.lit(x))
        fits = name.rlike(regex)
        number = F.when(fits, F.lit(i)) if number is None else number.when(fits, F.lit(i))
        target = F.when(fits, F.concat(*parts)) if target is None else target.when(fits, F.concat(*parts))
    return number.cast("long"), target


def first_rule_of_many(name: Column, rules: list[tuple[list[str], str]]) -> tuple[Column, Column]:
    """As ``first_rule``, where a rule has several patterns: the number is the rule's."""
    pairs = [(p, target, i) for i, (patterns, target) in enumerate(rules) for p in patterns]
    number, target = first_rule(name, [(p, t) for p, t, _ in pairs])
    owner = F.element_at(F.array(*(F.lit(i).cast("long") for *_, i in pairs)), (number + 1).cast("int"))
    return F.when(number.isNotNull(), owner), target


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole name: * for anything, ? for a character, [..] and [!..] for sets."""
    out = ""
    for part in re.split(r"(\*|\?|\[!?\]?[^\]]*\])", pattern):
        if part.startswith("[") and part.endswith("]") and len(part) > 2:
            body = part[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
        else:
            out += {"*": ".*", "?": "."}.get(part, re.escape(part))
    return f"(?s)\\A{out}\\z"


def matching_names(names: DataFrame, column: str, pattern: str | re.Pattern, required: bool = False) -> DataFrame:
    """Names that a pattern selects: a compiled regular expression is searched anywhere, a text with any of *?[ is a glob, and any other text is
    one name. ``required`` makes it an error that nothing matches, which takes a look at the data."""
    if isinstance(pattern, re.Pattern):
        found = names.where(F.col(column).rlike(pattern.pattern))
    elif re.search(r"[*?\[]", pattern):
        found = names.where(F.col(column).rlike(glob_regex(pattern)))
    else:
        found = names.where(F.col(column) == pattern)
    if required and found.isEmpty():
        raise KeyError(f"no name matches {pattern}")
    return found


def any_match(names: DataFrame, column: str, pattern: str | re.Pattern) -> bool:
    """Whether a pattern selects a name; the scan ends with the first."""
    return not matching_names(names, column, pattern).isEmpty()


def require_present(wanted: DataFrame, present: DataFrame, key: str, most: int = 20) -> DataFrame:
    """``wanted``; keys that ``present`` lacks are an error that names the first ``most`` of them."""
    missing = [r[0] for r in missing_keys(wanted, present, key).orderBy(key).limit(most).collect()]
    if missing:
        raise KeyError(f"missing: {missing}")
    return wanted


def against_golden(golden: DataFrame, current: DataFrame, step: str, value: str) -> DataFrame:
    """(step, golden, current): every golden step with its current value, NaN where it is missing."""
    return golden.select(step, F.col(value).alias("golden")).join(current.select(step, F.col(value).alias("current")), step, "left").withColumn("current", F.coalesce("current", F.lit(float("nan"))))


def keys_by_file(places: DataFrame, file: str, key: str) -> DataFrame:
    """(file, keys): the keys of each file in order. A file has as many as its index lists, so the lists are bounded by files."""
    return places.groupBy(file).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def through_indexes(records: DataFrame, *indexes: tuple[DataFrame, str]) -> DataFrame:
    """Records with the columns of every index that they have an entry in by its key; records that one lacks go."""
    for index, key in indexes:
        records = records.join(index, key)
    return records
