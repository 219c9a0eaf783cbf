"""Batches: gathering samples, packing within a batch, alignment, and cutting over ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.arrays import upto


def gathered(mapping: DataFrame, rows: DataFrame, sample: str = "sample", key: str = "id") -> DataFrame:
    """Rows in the places of a sample mapping; a negative sample is a padding row with null columns and is_padding."""
    return mapping.join(rows.withColumnRenamed(key, sample), sample, "left").withColumn("is_padding", F.col(sample) < 0)


def without_padding(ids: Column, pad: int) -> Column:
    """An array without the padding at its right end."""
    last = F.array_max(F.transform(ids, lambda x, i: F.when(x != pad, i + 1).otherwise(0)))
    return F.slice(ids, F.lit(1), F.coalesce(last, F.lit(0)))


def packed_batches(rows: DataFrame, batch: str, order: str, ids: str, pad: int, multiple: int = 1, continue_positions: bool = False) -> DataFrame:
    """(batch, input_ids, position_ids, cu_seqlens, loss_mask): the rows of a batch one after the other without padding.

    Each row is padded to a multiple of ``multiple`` with ``pad`` and mask 0; there positions restart at 0, or continue.
    Empty rows go. A batch is as large as its caller makes it, a few thousand tokens, so its lists are bounded.
    """
    slim = rows.select(batch, order, without_padding(F.col(ids), pad).alias("x")).where(F.size("x") > 0)
    extra = F.pmod(-F.size("x"), F.lit(multiple))
    padded = F.concat("x", F.array_repeat(F.lit(pad).cast("long"), extra))
    n = F.size("x")
    positions = F.transform(padded, lambda _, i: F.when((i < n) | F.lit(continue_positions), i).otherwise(i - n).cast("long"))
    made = slim.select(batch, F.struct(F.col(order).alias("o"), padded.alias("x"), positions.alias("p"), F.transform(padded, lambda _, i: (i < n).cast("long")).alias("m")).alias("r"))
    held = made.groupBy(batch).agg(F.array_sort(F.collect_list("r")).alias("r"))
    sizes = F.transform("r", lambda r: F.size(r["x"]).cast("long"))
    sums = F.transform(F.sequence(F.lit(0), F.size("r")), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x))
    return held.select(batch, *(F.flatten(F.col(f"r.{k}")).alias(n) for k, n in (("x", "input_ids"), ("p", "position_ids"), ("m", "loss_mask"))), sums.alias("cu_seqlens"))


def alignment(context: int, tensor: int) -> int:
    """The multiple that rows are padded to for context and tensor ranks."""
    return math.lcm(2 * context, context * tensor)


def zigzag_part(ids: Column, rank: int, ranks: int) -> Column:
    """The r-th chunk and its mirror image of 2 ``ranks`` equal chunks."""
    chunk = F.floor(F.size(ids) / (2 * ranks)).cast("int")
    return F.concat(F.slice(ids, chunk * rank + 1, chunk), F.slice(ids, chunk * (2 * ranks - 1 - rank) + 1, chunk))


def rank_slice(ids: Column, rank: int, ranks: int) -> Column:
    """A rank's equal range of an array; an array that doesn't divide is passed on whole."""
    each = F.floor(F.size(ids) / ranks).cast("int")
    return F.when(F.size(ids) % ranks == 0, F.slice(ids, each * rank + 1, each)).otherwise(ids)


def padded_for_packing(ids: Column, multiple: int, most: int, pad: int) -> Column:
    """Padded to one more than a multiple, and cut to ``most``: the shift to labels takes the last one away."""
    want = F.least((F.ceil(F.size(ids) / multiple) * multiple).cast("int"), F.lit(most))
    filled = F.concat(F.slice(ids, F.lit(1), want), F.array_repeat(F.lit(pad).cast("long"), F.greatest(want - F.size(ids) + 1, F.lit(0))))
    return filled


def selected_and_merged(assigned: DataFrame, key: str, values: str, *stacked: str) -> DataFrame:
    """(bin, keys, values, stacked columns): the samples of each bin merged, their keys joined by commas.

    ``values`` are put one after the other, ``stacked`` columns side by side. A bin holds at most one capacity.
    """
    held = assigned.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(values).alias("v"), *(F.col(c).alias(f"s{i}") for i, c in enumerate(stacked))))).alias("r"))
    side_by_side = lambda i: F.transform("r", lambda r: r[f"s{i}"])
    return held.select("bin", F.concat_ws(",", F.transform("r", lambda r: r["k"].cast("string"))).alias("keys"), F.flatten(F.transform("r", lambda r: r["v"])).alias("values"), *(side_by_side(i).alias(c) for i, c in enumerate(stacked)))


def expand_runs(rows: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, with 1 in its place."""
    return rows.withColumn("copy", F.explode(upto(F.col(times).cast("int")))).withColumn(times, F.lit(1).cast("long")).drop("copy")


def collapse_runs(rows: DataFrame, group: str, order: str, *values: str) -> DataFrame:
    """(group, start, count, values): rows one after the other with equal values as one."""
    w = Window.partitionBy(group).orderBy(order)
    value = F.struct(*values)
    changed = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("long"), F.lit(1))
    island = rows.withColumn("changed", changed).withColumn("island", F.sum("changed").over(w))
    return island.groupBy(group, "island").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("count"), *(F.first(v).alias(v) for v in values)).drop("island")


def segments(rows: DataFrame, key: str, ids: str, end: int) -> DataFrame:
    """(key, segment, ids): documents within a sample, cut behind each end token."""
    text = F.transform(ids, lambda x: x)
    ends = F.filter(F.transform(text, lambda x, i: F.when(x == end, i + 1)), lambda i: i.isNotNull())
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(ids))))
    cut = rows.select(key, F.col(ids), bounds.alias("b"))
    return cut.select(key, F.posexplode(F.transform(upto(F.size("b") - 1), lambda i: F.slice(ids, F.element_at("b", i) + 1, F.element_at("b", i + 1) - F.element_at("b", i)))).alias("segment", "ids"))
