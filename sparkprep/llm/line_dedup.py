"""Line deduplication with DataFrame functions alone.

A line's key is the line without ASCII white space at both ends, with A-Z in lower case. Keys of at least ``min_chars`` code
points found in at least ``min_docs`` documents lose all their lines except in the largest doc_id that holds them.

Lines travel once, as two 64-bit hashes of their keys with document and position. They are range-partitioned by hash and
sorted by (hash, document descending, position), so the occurrences of a line form one run whose first document is the
survivor. A window over that order streams each run: it counts documents at their first occurrences, and all lines but the
survivor's go if there are enough. Ranges are spans of the hash's first bits; a span with more than its share of lines, such as one with a line
that a third of all rows hold, is cut further by document, and the parts of a run that such a cut makes are reconciled by
one row for each part. What returns is a compressed bitmap for each document: words of 64 lines, only those that drop a line.

Null and empty texts are one empty line. Rows that share a doc_id are one document for counts and the choice of the survivor;
each keeps its own text, as bitmaps belong to (doc_id, hash of the text). A null doc_id counts for no document and survives
nowhere. Every row of ``docs`` returns, repeated ones too. An empty table gives none. Texts of any length are read whole;
work is linear in their lines. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import discard, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\u000b\u000c\r"
#: Lines of a span of hashes at most, or a 64th of all lines if that is less; a span with more is cut by document.
SPAN, SPANS = 1_000_000, 64


def lines_of(text: F.Column) -> F.Column:
    return F.split(text, "\n", -1)


def key_of(line: F.Column) -> F.Column:
    """The line trimmed, A-Z in lower case; ``lower`` does the same on ASCII and is much faster than ``translate``."""
    line = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): mark tells rows of one doc_id with different texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def spread(lines: DataFrame, span: int) -> DataFrame:
    """``lines`` with ``range``, a span of the hash's first bits, and ``part``, 0 but where a span of over ``span`` lines is cut by document."""
    n = lines.count()
    span = min(span, max(n // SPANS, 1000))
    bits = min(24, max(1, (4 * n // span).bit_length()))
    ranged = lines.withColumn("range", F.shiftrightunsigned("h1", 64 - bits).cast("int"))
    full = ranged.groupBy("range").count().where(F.col("count") > span).select("range", F.ceil(F.col("count") / span).cast("int").alias("parts"))
    held = ranged.join(materialise(full, "spans"), "range", "left")  # hot spans alone; being written, the planner broadcasts them by their size
    # Rows without an id count for no document, so each of their texts may lie in another part.
    part = F.pmod(F.when(F.col("doc_id").isNull(), F.col("mark")).otherwise(F.xxhash64("doc_id")), F.col("parts"))
    return held.withColumn("part", F.coalesce(part, F.lit(0))).withColumn("cut", F.col("parts").isNotNull()).drop("parts")


def streamed(lines: DataFrame, min_docs: int, span: int) -> DataFrame:
    """The lines (h1, h2, doc_id, mark, position) that go, and all of spans that are cut, with their run's ``docs`` and ``survivor``."""
    key = ["range", "part", "h1", "h2"]
    runs = spread(lines, span).repartitionByRange(*key).sortWithinPartitions(*key, F.col("doc_id").desc(), "position")
    # Range and order are those of the window, so it streams the runs as they lie; no part of a run is longer than a span allows.
    order = Window.partitionBy(*key).orderBy(F.col("doc_id").desc(), "position")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("doc_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(order))
    counted = runs.withColumn("first", first).withColumns({"docs": F.sum(F.col("first").cast("long")).over(whole), "survivor": F.first("doc_id").over(whole), "leads": F.row_number().over(order) == 1})
    return counted.where(f"cut or docs >= {min_docs} and not doc_id <=> survivor").drop("first")


def repeated(lines: DataFrame, min_docs: int, span: int) -> DataFrame:
    """(doc_id, mark, position) of the written lines (h1, h2, doc_id, mark, position) that go; ``lines`` are deleted then."""
    held = materialise(streamed(lines, min_docs, span), "runs")
    discard(lines)
    parts = held.where("cut and leads").groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("survivor").alias("survivor")).where(F.col("n") >= min_docs).drop("n")
    # Written, so that both sides of the join come straight from an exchange and a hot line's partition can be split.
    parts = materialise(parts, "parts")
    cut = held.where("cut").drop("survivor").join(parts, ["h1", "h2"]).where("not doc_id <=> survivor")
    return held.where("not cut").select("doc_id", "mark", "position").unionByName(cut.select("doc_id", "mark", "position"))


def dropped_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, span: int = SPAN) -> DataFrame:
    """(doc_id, mark, dropped): for each text that loses lines, array<struct<word int, bits long>> in the order of words.

    Bit b of word w is set if line 64 w + b goes; words without such a line are left out.
    """
    # Keys of the needed length are hashed in the row; shorter lines stay and travel no further.
    keys = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.cast("int").alias("position"), key_of(x).alias("key")))
    keys = F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(keys, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["position"].alias("position")))
    gone = repeated(materialise(texts(docs).select("doc_id", "mark", F.inline(hashed)), "lines"), min_docs, span)
    words = gone.groupBy("doc_id", "mark", F.shiftright("position", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, position & 63)")).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def kept_text(dropped: str) -> F.Column:
    """The lines of ``text`` that the bitmap in column ``dropped`` lets stay; each word of the bitmap is opened once."""
    set_in = lambda x: F.filter(F.sequence(x["word"] * 64, x["word"] * 64 + 63), lambda p: F.getbit(x["bits"], p.bitwiseAND(F.lit(63))) == 1)
    gone = F.flatten(F.transform(dropped, set_in))
    # The lines are bound once; a lambda that named the split would split again for each line.
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(F.array(lines_of(F.coalesce("text", F.lit("")))), lambda lines: F.array_join(F.transform(left(lines), lambda p: F.get(lines, p)), "\n"))[0]


def with_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``rows`` (doc_id, mark) with ``dropped``, null for those that lose nothing."""
    held = bitmaps.select(F.col("doc_id").alias("of_doc"), F.col("mark").alias("of_mark"), "dropped")
    return rows.join(held, rows["doc_id"].eqNullSafe(held["of_doc"]) & (rows["mark"] == held["of_mark"]), "left").drop("of_doc", "of_mark")


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, mark, n_lines, keep): each row's lines and its compressed keep bitmap.

    ``keep`` holds the 64-line words in which some line goes, with a bit for each line that stays; lines of words that are
    left out all stay.
    """
    lines = texts(docs).select("doc_id", "mark", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"))
    return with_bitmaps(lines, dropped_bitmaps(docs, min_chars, min_docs)).select(
        "doc_id", "mark", "n_lines", F.transform(F.coalesce("dropped", F.array()), lambda x: F.struct(x["word"], F.bitwise_not(x["bits"]).alias("bits"))).alias("keep")
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): one row for each row of ``docs``."""
    rows = with_bitmaps(texts(docs), dropped_bitmaps(docs, min_chars, min_docs))
    counted = F.aggregate("dropped", F.lit(0), lambda n, x: n + F.bit_count(x["bits"]))
    return rows.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(counted, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept_text("dropped")).alias("kept_text"),
    )
