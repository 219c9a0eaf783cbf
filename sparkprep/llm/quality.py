"""Quality rules whose thresholds adapt to each language and source.

Base measures come from the whole text in one Arrow pass. The thresholds of the further rules come from mergeable quantile
sketches: a sketch is a histogram over logarithmic buckets with 64 steps for each power of two (relative error under 1/64),
so merging is adding counts. It is built by a partial aggregation for each (lang, source), merged upwards to each lang and
to the whole, and a group of fewer than ``MIN_ROWS`` rows takes its parent's sketch. Its size is bounded by the buckets, not
by the rows. Rows that fail the base rules take no part in it.

A rule's limit is ``q75 + spreads * max(q75 - q25, one)``: quartiles of the group's rates, so junk in up to a quarter of a group
can't raise its own limit, and ``one``, the rate that one occurrence makes in the group's median document. The latter keeps
the spread of a rate that most documents don't show at all from being 0; it follows the sizes of the group's documents.

Null texts have no words. Null languages and sources are groups of their own. Rows that repeat a doc_id are judged one by one.
Very long texts are measured whole. An empty table gives no rows; other columns are not read, or pass through in ``good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import arrow_rows, materialise, text_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 0.5
#: A group's own sketch is used from so many rows.
MIN_ROWS = 100
#: A rule's rate is a count in 10,000 of a size; an occurrence changes the count by so much at least; spreads of a limit. Lines are few
#: in a document, so a line is much of a rate, and fewer spreads are far.
RULES = {"symbol_rate": ("n_symbols", "n_words", 1, 16), "bang_rate": ("n_bangs", "n_words", 1, 16), "upper_rate": ("n_upper", "word_chars", 1, 16), "dup_line_rate": ("n_dup_lines", "n_lines", 1, 5), "repeat_rate": ("n_repeat_words", "n_words", 6, 16)}
SIZES = ["n_words", "word_chars", "n_lines"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COLUMNS = [*BASE, "n_lines", "n_upper", "n_bangs"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice among ``words``."""
    if len(words) < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) == len(words):
        return 0
    a = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    if len(ids) < 1 << 21:
        keys = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    else:  # more distinct words than 63 bits hold three of
        keys = np.unique(np.stack([a[:-2], a[1:-1], a[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return 0
    at = np.flatnonzero(again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The ``COLUMNS`` of a text in UTF-8."""
    words = text.split()
    solid = b"".join(words)
    lines = text.split(b"\n")
    worded = [x for x in lines if x.strip()]
    return (
        len(words),
        len(solid.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(worded) - len(set(worded)),
        repeated_words(words),
        len(worded),
        len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count(b"!"),
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row, as k0, k1, ..., with its lang, source and ``COLUMNS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            texts = (batch.column(batch.num_columns - 1)).to_pylist()
            found = np.array([measure(x) for x in texts], np.int64).reshape(-1, len(COLUMNS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, i]) for i in range(len(COLUMNS)))], names)

    held = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_bytes())
    schema = T.StructType([*held.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COLUMNS)])
    names = schema.names
    return held.mapInArrow(run, schema)


def failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))


def rates() -> dict[str, F.Column]:
    """The adaptive rules' measures as whole parts of 10,000."""
    return {name: F.floor(F.lit(10_000) * F.col(a) / F.greatest(F.col(b), F.lit(1))) for name, (a, b, *_) in RULES.items()}


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, level, metric, bucket, n): level 0 for a language and source, 1 for a language, 2 for all rows."""
    values = rates() | {c: F.col(c) for c in SIZES}
    cells = rows.select("lang", "source", F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))).alias("metric", "value"))
    shift = F.greatest(F.length(F.bin("value")) - 7, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, s), s)")
    fine = cells.withColumn("s", shift).groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    level = lambda k, lang, source: fine.groupBy(lang.alias("lang"), source.alias("source"), "metric", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(k))
    none = F.lit(None).cast("string")
    return level(0, F.col("lang"), F.col("source")).unionByName(level(1, F.col("lang"), none)).unionByName(level(2, none, none))


def limits(rows: DataFrame) -> DataFrame:
    """(lang, source, level, rows, and a limit for each adaptive rule) from the sketches of ``rows`` (``COLUMNS``)."""
    group = ["lang", "source", "level", "metric"]
    # A group's histogram has at most a few hundred buckets, as a rate is bounded by the bytes of a text.
    held = sketches(rows).groupBy(group).agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("histogram"))
    rank = lambda q: F.expr(
        f"aggregate(histogram, named_struct('seen', 0L, 'at', cast(null as long)), (s, x) -> named_struct('seen', s.seen + x.n, 'at', if(s.at is null and (s.seen + x.n) * 100 >= rows * {q}, x.bucket, s.at)), s -> s.at)"
    )
    quartiles = held.select(*group, "rows", *(rank(q).alias(f"q{q}") for q in (25, 50, 75)))
    of = lambda metric, q: F.max(F.when(F.col("metric") == metric, F.col(f"q{q}")))
    limit = {}
    for name, (_, size, least, spreads) in RULES.items():
        one = F.floor(F.lit(10_000 * least) / F.greatest(of(size, 50), F.lit(1)))
        limit[f"{name}_limit"] = of(name, 75) + spreads * F.greatest(of(name, 75) - of(name, 25), one)
    return quartiles.groupBy("lang", "source", "level").agg(F.max("rows").alias("rows"), *(x.cast("long").alias(name) for name, x in limit.items()))


def judged(docs: DataFrame, keep: list[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """``measured`` with ``base_failed``, the adaptive rates, their limits and ``kept``; it is written once, then read by the sketches and the filter."""
    rows = materialise(measured(docs, keep).withColumn("base_failed", failed()), "measures")
    found = materialise(limits(rows.where("not base_failed")), "limits")
    names = [f"{m}_limit" for m in RULES]
    own = found.where("level = 0").select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("rows").alias("own_rows"), *(F.col(c).alias(f"own_{c}") for c in names))
    mid = found.where("level = 1").select(F.col("lang").alias("ml"), F.col("rows").alias("mid_rows"), *(F.col(c).alias(f"mid_{c}") for c in names))
    top = found.where("level = 2").first()  # one row: the limits of the whole
    own = own.join(mid, F.col("l").eqNullSafe(F.col("ml")), "left").drop("ml")
    chosen = lambda c: F.when(F.col("own_rows") >= min_rows, F.col(f"own_{c}")).when(F.col("mid_rows") >= min_rows, F.col(f"mid_{c}")).otherwise(F.lit(top[c] if top else None)).cast("long").alias(c)
    rules = materialise(own.select("l", "s", *(chosen(c) for c in names)), "rules")
    joined = rows.join(rules, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    over = F.lit(False)
    for metric, rate in rates().items():
        over = over | (rate > F.col(f"{metric}_limit"))
    return joined.withColumns({**rates(), "kept": ~(F.col("base_failed") | F.coalesce(over, F.lit(False)))})


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base measures, base_failed, kept, and the rates with their limits.

    A group all of whose rows fail the base rules has no limits.
    """
    return judged(docs, ["doc_id"]).select(F.col("k0").cast("long").alias("doc_id"), *BASE, "base_failed", "kept", *RULES, *(f"{m}_limit" for m in RULES))


def good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns: rules come to the rows, which aren't shuffled."""
    found = judged(docs, docs.columns).where("kept")
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
