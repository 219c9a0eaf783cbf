"""Sequence packing: length histogram, first fit (decreasing), fill, statistics.

The histogram of lengths is bounded by the longest length, so the packing plan is made from it on the driver and kept in
runs of like bins: its size doesn't grow with the rows. Rows then find their bins by their rank within their length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.arrays import running_sums
from sparkprep.operators.sampling import keyed, keyed_rank


def length_histogram(rows: DataFrame, length: Column, most: int) -> DataFrame:
    """(length, n) for every length from 0 to ``most``, also those without rows. A longer row is an error."""
    spark = rows.sparkSession
    checked = F.when(length > most, F.raise_error("a row is longer than the histogram").cast("long")).otherwise(length.cast("long"))
    held = rows.select(checked.alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(0, most + 1).withColumnRenamed("id", "length").join(held, "length", "left").select("length", F.coalesce("n", F.lit(0)).alias("n"))


def first_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Each length goes to the first bin with room; one over the capacity gets a bin of its own.

    A tree of the largest room left and right of each node finds the bin in logarithmic time.
    """
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)
    bins: list[list[int]] = []
    for n in lengths:
        if n > capacity:
            at = len(bins)
        else:
            at = 1
            while at < size:
                at = 2 * at if room[2 * at] >= n else 2 * at + 1
            at -= size
        if at >= len(bins):
            at = len(bins)
            bins.append([])
        bins[at].append(n)
        node = at + size
        room[node] = max(-1, room[node] - n) if n <= capacity else -1
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def first_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """First fit of all pieces from the longest to the shortest: ([(length, first bin, bins, pieces in each)], number of bins).

    Runs of bins with the same room are kept as one. A length fills the first run that has room, bin after bin, as first
    fit would; the last bin may get fewer pieces, which splits the run.
    """
    runs: list[list[int]] = []  # [first bin, bins, room]
    out: list[tuple[int, int, int, int]] = []
    total = 0
    for n in sorted((n for n, c in counts.items() if c and n > 0), reverse=True):
        left = counts[n]
        nxt: list[list[int]] = []
        for first, bins, room in runs:
            each = room // n
            if not left or not each:
                nxt.append([first, bins, room])
                continue
            full = min(bins, left // each)
            if full:
                out.append((n, first, full, each))
                nxt.append([first, full, room - each * n])
                left -= full * each
            if full < bins:
                if left and left < each:
                    out.append((n, first + full, 1, left))
                    nxt.append([first + full, 1, room - left * n])
                    left, full = 0, full + 1
                if full < bins:
                    nxt.append([first + full, bins - full, room])
        runs = nxt
        if left:
            each = max(1, capacity // n)
            full = left // each
            if full:
                out.append((n, total, full, each))
                runs.append([total, full, max(0, capacity - each * n)])
            if left - full * each:
                out.append((n, total + full, 1, left - full * each))
                runs.append([total + full, 1, capacity - (left - full * each) * n])
            total = max(total + full + (1 if left - full * each else 0), total)
    return out, total


def assign_bins(rows: DataFrame, capacity: int, length: str = "length", key: str = "id") -> DataFrame:
    """Adds ``bin`` by first fit decreasing over column ``length``; rows of one length come in the order of a keyed hash of ``key``.

    Empty rows fit anywhere and go to the first bin. A null length, or one under 0, counts as 0. Other columns don't travel
    with the ranks: they are joined by ``key``, which is unique.
    """
    spark = rows.sparkSession
    size = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    counts = {r[0]: r[1] for r in rows.groupBy(size.alias("n")).count().collect()}  # one row for each different length
    plan, _ = first_fit_decreasing(counts, capacity)
    used: dict[int, int] = {}
    cells = [(0, 0, counts[0], 0, counts[0])] if counts.get(0) else []
    for n, first, bins, each in plan:
        cells.append((n, used.get(n, 0), used.get(n, 0) + bins * each, first, each))
        used[n] = used.get(n, 0) + bins * each
    table = spark.createDataFrame(cells, "size_ long, low_ long, high_ long, first_ long, each_ long")
    slim = keyed_rank(rows.select(F.col(key).alias("key_id_"), size.alias("size_")), "size_", keyed(F.col("key_id_"), "rank"), "key_id_")
    found = slim.join(F.broadcast(table), "size_").where("rank >= low_ and rank < high_")  # bounded by the different lengths
    placed = found.select(F.col("key_id_"), (F.col("first_") + F.expr("(rank - low_) div each_")).alias("bin"))
    return rows.join(placed, F.col(key) == F.col("key_id_")).drop("key_id_")


def first_fit_shuffled(rows: DataFrame, capacity: int, length: str = "length", key: str = "id", seed: int = 0, block: int = 4096) -> DataFrame:
    """(block, bin, key, length): first fit in the order of a keyed shuffle.

    First fit depends on all rows before, so the shuffled order is cut into blocks of ``block`` rows, each packed by itself: no
    task holds more than a block, and a block wastes part of a bin at most for each open bin at its end. With a block of all rows it is
    plain first fit in shuffled order. A null length counts as 0.
    """
    whole = rows.select(F.lit(0).alias("whole"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"))
    placed = keyed_rank(whole, "whole", keyed(F.col("id"), seed, "shuffle"), "id").withColumn("block", F.expr(f"rank div {block}"))
    held = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "id"))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                waiting: dict[int, deque[int]] = {}
                for i, n in zip(ids, lengths):
                    waiting.setdefault(n, deque()).append(i)
                flat = [(number, k, waiting[n].popleft(), n) for k, held_ in enumerate(first_fit(lengths, capacity)) for n in held_]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], ["block", "bin", key, length])

    return held.select("block", F.col("r.id").alias("ids"), F.col("r.n").alias("lengths")).mapInArrow(run, f"block long, bin long, {key} long, {length} long")


def label_mask(mask: Column | None = None, ids: Column | None = None, answer_start: Column | None = None) -> Column:
    """A row's mask as its labels need it: rolled left by one with a 0 behind, or 1 from the token before the answer on."""
    if mask is not None:
        zero = F.slice(F.transform(mask, lambda x: x.cast("boolean").cast("long") * 0), 1, 1)
        return F.concat(F.transform(F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0))), lambda x: x.cast("long")), zero)
    if ids is None or answer_start is None:
        raise ValueError("a row to pack has a loss mask or the place where its answer begins")
    return F.transform(ids, lambda _, i: (i >= answer_start - 1).cast("long"))


def fill(assigned: DataFrame, ids: str = "input_ids", mask: str | None = "loss_mask", key: str = "id", answer_start: str | None = None) -> DataFrame:
    """(bin, input_ids, loss_mask, seq_start_id): the rows of each bin one after the other, longest first, then in the order of a keyed hash.

    The loss mask is that of the labels (``label_mask``), from column ``mask`` or else from ``answer_start``. A bin holds at most
    one capacity of tokens, or one longer row, so the collected lists are bounded.
    """
    has_mask = mask is not None and mask in assigned.columns
    if not has_mask and answer_start is None:
        raise ValueError(f"rows have neither a column {mask} nor the place where their answers begin")
    made = label_mask(F.col(mask)) if has_mask else label_mask(None, F.col(ids), F.col(answer_start))
    row = F.struct((-F.size(ids)).alias("n"), keyed(F.col(key), "rank").alias("h"), F.col(key).alias("k"), F.col(ids).alias("x"), made.alias("m"))
    held = assigned.groupBy("bin").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    sums = running_sums(F.transform("rows", lambda r: F.size(r["x"]).cast("long")))
    bins = held.select("bin", F.flatten(F.transform("rows", lambda r: r["x"])).alias("input_ids"), F.flatten(F.transform("rows", lambda r: r["m"])).alias("loss_mask"), sums.alias("sums"))
    return bins.select("bin", "input_ids", "loss_mask", F.slice("sums", F.lit(1), F.size("sums") - 1).alias("seq_start_id"))


def pack_statistics(assigned: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """(packing_factor, packing_efficiency, max_length, max_per_bin, min_bin_sum) over all bins, in one row."""
    bins = assigned.groupBy("bin").agg(F.sum(length).alias("total"), F.count(F.lit(1)).alias("n"), F.max(length).alias("longest"))
    return bins.agg(
        F.round(F.sum("n") / F.count(F.lit(1)), 2).alias("packing_factor"),
        F.round(F.sum("total") / F.count(F.lit(1)) / capacity * 100, 2).alias("packing_efficiency"),
        F.max("longest").alias("max_length"),
        F.max("n").alias("max_per_bin"),
        F.min("total").alias("min_bin_sum"),
    )


def write_with_metadata(rows: DataFrame, capacity: int, path: str, metadata: str, **columns: str) -> DataFrame:
    """Rows (id, length, tokens, mask) packed and written as Parquet, and a line with the packing's figures added to the folder ``metadata`` of JSON; the figures."""
    assigned = assign_bins(rows, capacity)
    fill(assigned, **columns).drop("bin").write.parquet(path)
    figures = pack_statistics(assigned, capacity).withColumns({"pack_size": F.lit(capacity), "path": F.lit(path)})
    figures.coalesce(1).write.mode("append").json(metadata)
    return figures
