"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions alone.

Rows are range-partitioned and sorted by (doc_id, checksum, size); a row's number is its place in its partition and the counts
of the partitions before. A Feistel network over a grid of a x b cells, the smallest near square that holds all n rows,
permutes the cells; a row that leaves 0..n-1 walks the cycle until it returns. Then ``shard = number mod shards`` and
``slot = number div shards``: both follow from the row number and the seed, shards hold counts at most one apart, and slots
have no gaps. The law is ``rows``. The network's round function is an MD5, which any SQL engine can repeat.

A null text has size 1 and the checksum of no bytes. Rows that are equal in all three sort keys are interchangeable; of other rows
that share a doc_id, or have none, ranges part any number. Null doc_ids come first. Texts of any length count whole. An empty
table gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import materialise

ROUNDS = 6
SEED = 42
#: Rows of a range in the mean, and ranges at most. A range sorts on disk if it has to.
RANGE_ROWS, MAX_RANGES = 50_000, 20_000
#: Cycle walks that are made without looking whether one is needed.
WALKS = 64


def grid(n: int) -> tuple[int, int]:
    """The sides of the smallest near square of at least ``n`` cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def place(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """The shard and slot of a row number: the same as the columns of ``shard_rows``, for one row on the driver."""
    a, b = grid(n)

    def mixed(x: int, r: int) -> int:
        return int(hashlib.md5(f"{x}-{r}-{seed}".encode()).hexdigest()[:13], 16)

    while True:
        left, right = divmod(row, b)
        for r in range(ROUNDS):
            if r % 2:
                right = (right + mixed(left, r) % b) % b
            else:
                left = (left + mixed(right, r) % a) % a
        row = left * b + right
        if row < n:
            return row % shards, row // shards


def permuted(number: str, n: int, seed: int = SEED) -> F.Column:
    """The row number in column ``number`` under the permutation of 0..n-1."""
    a, b = grid(n)
    steps = ", ".join(f"{r}L" for r in range(ROUNDS))

    def mixed(x: str) -> str:
        return f"cast(conv(substring(md5(concat_ws('-', {x}, i, '{seed}')), 1, 13), 16, 10) as bigint)"

    def once(x: str) -> str:
        return (
            f"aggregate(array({steps}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (s, i) -> if(i % 2 = 0, "
            f"named_struct('l', (s.l + {mixed('s.r')} % {a}L) % {a}L, 'r', s.r), "
            f"named_struct('l', s.l, 'r', (s.r + {mixed('s.l')} % {b}L) % {b}L)), s -> s.l * {b}L + s.r)"
        )

    # Fewer than a cells lie outside 0..n-1. No cycle is longer outside than there are such cells, and each step leaves
    # them with a chance of 1 - 1/b or more; a walk that 64 steps don't end is reported, never cut short.
    walks = min(a * b - n, WALKS)
    walked = f"aggregate(sequence(1, {walks}), x, (y, k) -> if(y < {n}L, y, {once('y')}))" if walks else "x"
    first = f"transform(array({once(number)}), x -> if(x < {n}L, x, {walked}))[0]"
    return F.expr(f"transform(array({first}), x -> if(x < {n}L, x, cast(raise_error('a cycle walk did not end') as bigint)))[0]")


def numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``number``, 0 up to their count, in the order of ``keys``; and that count.

    Ranges take in all keys, so rows with one doc_id, or none, spread. The numbers of a partition are written with its rows;
    the counts of the partitions, one for each range, are all that reaches the driver.
    """
    parts = min(MAX_RANGES, rows.count() // RANGE_ROWS + 1)
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The id's high 31 bits number the partition and its low 33 bits the row within it.
    held = materialise(ranged.withColumn("id_", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("id_", 33).cast("int")
    counts = dict(held.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for i in range(max(counts, default=-1) + 1):
        starts.append((i, before))
        before += counts.get(i, 0)
    table = rows.sparkSession.createDataFrame(starts, "part_ int, start_ long")
    placed = held.join(F.broadcast(table), part == F.col("part_"))  # MAX_RANGES rows at most
    return placed.withColumn("number", F.col("start_") + F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))).drop("id_", "part_", "start_"), before


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(materialise(slim, "rows"), ["doc_id", "text_crc32", "size"])
    moved = rows.withColumn("moved", permuted("number", n, seed))
    return moved.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("moved") % shards).cast("int").alias("shard"), F.expr(f"moved div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

