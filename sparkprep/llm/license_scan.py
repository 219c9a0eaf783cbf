"""License scans by diagonal voting.

Every word k-gram of a text is hashed and joined to the positions where license templates hold it. A match at text position
p and template position t votes for the diagonal p - t. A template without changes fills one diagonal; words put in or left
out shift the rest to a neighbouring one, so diagonals within ``SHIFT`` of each other are merged. Where the merged votes hold
enough of a template's k-grams to leave room for no more than the edits that its length allows, the span is verified on the
words of the text: by the least number of words put in, left out or replaced, at either end too.

Short templates get shorter k-grams, so that an edit in their middle leaves votes. Two rules keep similar licenses apart: a
span must hold the words that set its template apart from another label's (such as the version), and of overlapping spans of
different labels one with fewer edits wins. Phrases count exactly where their words stand; hashes find them, words confirm.

Texts without words or matches return with no labels. A null text is empty. Each row of ``docs`` is scanned by itself, also where
rows are equal, whole however long. An empty table gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import arrow_rows, materialise, text_bytes

#: Words of a gram, and of those of templates so short that one edit could hit all of theirs.
K, SHORT_K, SHORT = 3, 2, 5
#: Words for each edit that a span may differ from its template by; one edit is always allowed.
WORDS_PER_EDIT = 10
#: Diagonals next to each other in order and further apart than this many words aren't merged.
SHIFT = 4

#: Phrases that count wherever their words stand one after the other: (label, words).
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Notices of public licenses: (label, text).
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD license"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: A to Z become lower case, other ASCII that is neither letter nor digit a space; the rest of UTF-8 stays.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Grams:
    """Hashes of word k-grams; the hashes of words are kept, up to a bound. Grams of different k differ."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.factors = np.random.default_rng(11).integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        out = np.array([known[w] for w in words], np.uint64)
        if len(known) > 500_000:
            known.clear()
        return out

    def of(self, hashes: np.ndarray, k: int) -> np.ndarray:
        n = len(hashes) - k + 1
        if n < 1:
            return np.zeros(0, np.int64)
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) + hashes[i : i + n] * self.factors[i]
        return out.view(np.int64)


class Template(NamedTuple):
    number: int
    label: str
    base: bool  # a phrase, which must stand as it is
    words: list[bytes]

    @property
    def k(self) -> int:
        """A base phrase of fewer than K words is one gram."""
        return min(len(self.words), K if self.base or len(self.words) > SHORT else SHORT_K)

    @property
    def edits(self) -> int:
        return 0 if self.base else max(1, len(self.words) // WORDS_PER_EDIT)

    @property
    def needed(self) -> int:
        """Different grams that votes must hold: an edit takes k of them at most."""
        return max(1, len(self.words) - self.k + 1 - self.k * self.edits)


def templates(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> list[Template]:
    return [t for i, (label, text) in enumerate([*phrases, *notices]) if (t := Template(i, label, i < len(phrases), words_of(text.encode()))).words]


def nearest(words: list[bytes], template: list[bytes]) -> tuple[int, int, int]:
    """(edits, first, last): where in ``words`` the template stands with the fewest edits, by words put in, left out or replaced."""
    n = len(template)
    cost, start = list(range(n + 1)), [0] * (n + 1)
    best = (n, 0, -1)
    for at, word in enumerate(words):
        diagonal, begun = 0, at
        cost[0], start[0] = 0, at + 1
        for j in range(1, n + 1):
            changed = diagonal + (word != template[j - 1])
            diagonal, before = cost[j], start[j]
            if changed <= cost[j] + 1 and changed <= cost[j - 1] + 1:
                cost[j], start[j] = changed, begun
            elif cost[j] <= cost[j - 1]:
                cost[j] += 1
            else:
                cost[j], start[j] = cost[j - 1] + 1, start[j - 1]
            begun = before
        if cost[n] <= best[0]:  # of equally good spans the last, which holds a word put in before the template's last
            best = (cost[n], start[n], at)
    return best


def telling(held: list[Template]) -> dict[int, frozenset[bytes]]:
    """For each notice the words that set it apart from another label's template within reach of its edits."""
    out = {}
    for t in held:
        words: set[bytes] = set()
        for other in held:
            if other.label != t.label and not t.base:
                edits, first, last = nearest(other.words, t.words)
                if edits <= t.edits:
                    words |= set(t.words) - set(other.words[first : last + 1])
        out[t.number] = frozenset(words)
    return out


def template_grams(spark: SparkSession, held: list[Template]) -> DataFrame:
    """(gram, template, place): a few thousand rows at most, as the templates are a parameter."""
    grams = Grams()
    rows = [(int(h), t.number, place) for t in held for place, h in enumerate(grams.of(grams.hashes(t.words), t.k))]
    return spark.createDataFrame(rows, "gram long, template int, place int")


#: The gram that each row ends with; it joins to a template that isn't one, so that every row is heard of.
PRESENT, NO_TEMPLATE = 0, -1


def text_grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, doc_id, mark, n_words, k, grams): for each k of ``sizes`` the hashes of all k-grams of each whole text; with the first, PRESENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, row = Grams(), TaskContext.get().partitionId() << 36
        for batch in arrow_rows(batches):
            counts, found = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                hashes = grams.hashes(words)
                found.append([np.append(grams.of(hashes, k), np.full(int(i == 0), PRESENT)) for i, k in enumerate(sizes)])
            rows = np.arange(row, row + len(counts))
            for i, k in enumerate(sizes):
                held = [x[i] for x in found]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held)))
                yield pa.RecordBatch.from_arrays([pa.array(rows), *batch.columns[:2], pa.array(counts, pa.int64()), lists], ["row", "doc_id", "mark", "n_words", "grams"])
            row += len(counts)

    mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    return docs.select(F.col("doc_id").cast("long"), mark, text_bytes()).mapInArrow(run, "row long, doc_id long, mark long, n_words long, grams array<long>")


def matches(docs: DataFrame, held: list[Template]) -> DataFrame:
    """(row, doc_id, mark, n_words, position, template, place): all grams joined to the templates, and one NO_TEMPLATE for each row."""
    spark = docs.sparkSession
    known = template_grams(spark, held).unionByName(spark.createDataFrame([(PRESENT, NO_TEMPLATE, 0)], "gram long, template int, place int"))
    found = text_grams(docs, sorted({t.k for t in held}, reverse=True) or [K])
    return found.select("row", "doc_id", "mark", "n_words", F.posexplode("grams").alias("position", "gram")).join(F.broadcast(known), "gram").drop("gram")


def candidates(votes: DataFrame, held: list[Template]) -> DataFrame:
    """(doc_id, mark, spans): array<struct<template, low, high>> of the least and greatest diagonals that neighbours merge to."""
    of = lambda name: F.element_at(docs_map({t.number: getattr(t, name) for t in held}), F.col("template"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(of("base"), 0).otherwise(SHIFT), F.lit(True))
    lines = votes.where(F.col("template") != NO_TEMPLATE).groupBy("row", "doc_id", "mark", "template", (F.col("position") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    # A diagonal has one place for each gram of its template at most; so has a span, after its places are made distinct.
    spans = lines.withColumn("span", F.sum(apart.cast("long")).over(order)).groupBy("row", "doc_id", "mark", "template", "span").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n")
    )
    likely = spans.where(F.col("n") >= of("needed")).select("doc_id", "mark", F.struct("template", "low", "high").alias("span")).distinct()
    return likely.groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans"))


def verified(texts: DataFrame, held: list[Template]) -> DataFrame:
    """(doc_id, mark, n_base, first_word, last_word, base_labels, labels, score) of texts (doc_id, mark, text, spans), on their words."""
    by_number, guards = {t.number: t for t in held}, telling(held)

    def judge(text: bytes, spans: list[dict]) -> tuple:
        words = words_of(text)
        starts, base, found = [], set(), []
        for span in sorted({(s["template"], s["low"], s["high"]) for s in spans}):
            t = by_number[span[0]]
            if t.base:
                if words[span[1] : span[1] + len(t.words)] == t.words:
                    starts.append(span[1])
                    base.add(t.label)
                continue
            begin = max(0, span[1] - SHIFT)
            edits, first, last = nearest(words[begin : span[2] + len(t.words) + SHIFT], t.words)
            # The words that tell may stand just outside of one of several equally good spans.
            near = words[max(0, begin + first - t.edits) : begin + last + 1 + t.edits]
            if edits <= t.edits and guards[t.number] <= set(near):
                found.append((t.label, begin + first, begin + last, edits, 1 - edits / len(t.words)))
        good = [x for x in found if not any(y[0] != x[0] and y[3] < x[3] and y[1] <= x[2] and x[1] <= y[2] for y in found)]
        score = 1.0 if starts else max((x[4] for x in good), default=0.0)
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | {x[0] for x in good}), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]
        for batch in arrow_rows(batches):
            rows = [judge(*x) for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "mark", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return texts.select("doc_id", "mark", text_bytes(), "spans").mapInArrow(run, "doc_id long, mark long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double").distinct()


def docs_map(values: dict[int, object]) -> F.Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def license_scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row for each row of ``docs``.

    n_base counts the places of base phrases, first_word and last_word are their least and greatest start (else null). labels
    are those of base phrases and verified notices; score is the greatest share of a template's words that no edit touches, 1 for a base phrase.
    """
    held = templates(phrases, notices)
    found = materialise(matches(docs, held), "votes")
    likely = materialise(candidates(found, held), "candidates")
    rows = found.where(F.col("template") == NO_TEMPLATE).select("doc_id", "mark", "n_words")
    same = lambda x, y: x["doc_id"].eqNullSafe(y["id"]) & (x["mark"] == y["of"])
    keyed = lambda x: x.withColumnsRenamed({"doc_id": "id", "mark": "of"})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    spans = keyed(likely)
    judged = keyed(materialise(verified(texts.join(spans, same(texts, spans)), held), "judged"))
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.coalesce(c, none), ",").alias(c)
    return rows.join(judged, same(rows, judged), "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", joined("base_labels"), joined("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
