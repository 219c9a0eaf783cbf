"""Sampling, sharding and batching as arithmetic over row numbers.

Nothing is drawn: every order is that of a keyed hash, so a plan gives the same samples on any cluster and after a restart.
Plans that only need numbers start from ``spark.range`` and have no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keyed(*parts: Column | int | str) -> Column:
    """The hash that orders samples: MD5 of the parts, so that any engine can repeat it."""
    return F.md5(F.concat_ws("-", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts)))


def keyed_rank(rows: DataFrame, group: str, key: Column, tie: str, digits: int = 3) -> DataFrame:
    """Adds ``rank``: 0-based within ``group`` in the order of a keyed hash, then of ``tie``.

    The hash's first digits cut a group into 16 ** digits even parts that follow one another; each part is ranked by itself
    and the counts of those before it are added, so a group as large as the whole data spreads over the cluster.
    """
    cut = rows.withColumn("key_", key).withColumn("part_", F.substring("key_", 1, digits))
    counts = cut.groupBy(group, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, "part_", F.coalesce(before, F.lit(0)).alias("before_"))
    local = F.row_number().over(Window.partitionBy(group, "part_").orderBy("key_", tie)).cast("long") - 1
    return cut.withColumn("local_", local).join(starts, [group, "part_"]).withColumn("rank", F.col("before_") + F.col("local_")).drop("key_", "part_", "before_", "local_")


def sequential(spark: SparkSession, total: int, consumed: int, micro: int, ranks: int, drop_last: bool = True) -> DataFrame:
    """(idx, step, rank, slot): data-parallel batches in the order of rows, from row ``consumed`` on."""
    batch = micro * ranks
    end = consumed + (total - consumed) // batch * batch if drop_last else total
    i = F.col("idx") - consumed
    return spark.range(consumed, max(end, consumed)).withColumnRenamed("id", "idx").select("idx", F.expr(f"(idx - {consumed}) div {batch}").alias("step"), F.floor(i % batch / micro).cast("long").alias("rank"), (i % micro).alias("slot"))


def global_batches(spark: SparkSession, total: int, consumed: int, global_batch: int, micro: int, ranks: int, tail: str = "drop") -> DataFrame:
    """(idx, step, rank, micro_step, is_padding): batches dealt to ranks in turn; the tail drops, keeps or pads with -1."""
    if global_batch % (micro * ranks):
        raise ValueError("a global batch is a multiple of micro batches times ranks")
    start = consumed % total
    full = (total - start) // global_batch * global_batch
    end = start + (full if tail == "drop" else -(-(total - start) // global_batch) * global_batch if tail == "pad" else total - start)
    j = F.col("id") - start
    rows = spark.range(start, end).select(
        F.when(F.col("id") < total, F.col("id")).otherwise(F.lit(-1)).alias("idx"),
        F.floor(j / global_batch).cast("long").alias("step"),
        (j % global_batch % ranks).alias("rank"),
        F.floor(F.floor(j % global_batch / ranks) / micro).cast("long").alias("micro_step"),
        (F.col("id") >= total).alias("is_padding"),
    )
    return rows


def random_sharded(spark: SparkSession, total: int, consumed: int, micro: int, ranks: int) -> DataFrame:
    """(idx, rank, position): each rank's own range in the epoch's order, from where the consumed samples end."""
    batch = micro * ranks
    active = total - total % batch
    epoch, bucket = consumed // active, total // batch * micro
    offset = consumed % active // ranks
    rows = spark.range(0, bucket * ranks).select(F.col("id").alias("idx"), F.floor(F.col("id") / bucket).cast("long").alias("owner"))
    placed = keyed_rank(rows, "owner", keyed(F.col("idx"), epoch), "idx")
    return placed.select("idx", F.col("owner").alias("rank"), F.col("rank").alias("position")).where(F.col("position") >= offset)


def random_unsharded(spark: SparkSession, total: int, consumed: int, micro: int, ranks: int) -> DataFrame:
    """(idx, rank, nth): one keyed order over all rows of the epoch, dealt to the ranks in turn from where the consumed samples end.

    Whole micro batches take part; a rank's last incomplete one is dropped.
    """
    batch = micro * ranks
    active = total - total % batch
    epoch, offset = consumed // active, consumed % active
    if offset % batch:
        raise ValueError("consumed samples are whole batches of all ranks")
    n = total // micro * micro
    rows = spark.range(0, n).select(F.col("id").alias("idx"), F.lit(0).alias("whole"))
    placed = keyed_rank(rows, "whole", keyed(F.col("idx"), epoch), "idx").where(F.col("rank") >= offset)
    dealt = placed.select("idx", ((F.col("rank") - offset) % ranks).alias("owner"), F.expr(f"(rank - {offset}) div {ranks}").alias("nth"))
    # Rank r gets the places r, r + ranks, ...: so many in all, of which whole micro batches count.
    held = F.floor((F.lit(n - offset - 1) - F.col("owner")) / ranks) + 1
    return dealt.where(F.col("nth") < F.floor(held / micro) * micro).select("idx", F.col("owner").alias("rank"), "nth")


def block_mapping(spark: SparkSession, size: int, number: int, block: int, seed: int, shuffle: bool = True, truncate: bool = False) -> DataFrame:
    """(position, sample) of a mapping of ``number`` samples: blocks in a keyed order, rows within a block in one of their own.

    The blocks cover ``number`` or ``size`` samples, whichever is more, so fewer samples than rows are drawn from all rows. With ``truncate``
    an incomplete last block goes.
    """
    block, need = min(block, size), max(number, size)
    tail = need % block
    if truncate and tail:
        number, need, tail = number - tail if need == number else number, need - tail, 0
    blocks = spark.range(0, -(-need // block)).select(F.col("id").alias("block"), F.lit(0).alias("whole"))
    order = keyed_rank(blocks, "whole", keyed(F.col("block"), seed), "block") if shuffle else blocks.withColumn("rank", F.col("block"))
    # The incomplete block is the last one by number; blocks behind it in the order begin so much earlier.
    last = order.where(F.col("block") == -(-need // block) - 1).select(F.col("rank").alias("last"))
    begins = F.col("rank") * block - F.when(F.col("rank") > F.col("last"), block - tail if tail else 0).otherwise(0)
    starts = order.join(F.broadcast(last)).select("block", F.col("rank").alias("nth"), begins.alias("begins"))  # one row
    rows = spark.range(0, need).select(F.col("id"), F.floor(F.col("id") / block).cast("long").alias("block")).join(starts, "block")
    key = keyed(F.col("id"), F.col("nth") + seed) if shuffle else F.lit("")
    place = F.row_number().over(Window.partitionBy("block").orderBy(key, "id")).cast("long") - 1
    return rows.select((F.col("begins") + place).alias("position"), (F.col("id") % size).alias("sample")).where(F.col("position") < number)


def positions(mapping: DataFrame, number: int, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """The samples of a slice of a mapping of ``number`` samples, by the rules of Python's slices; adds ``nth``, their order."""
    chosen = range(*slice(start, stop, step).indices(number))
    if not len(chosen):
        return mapping.where(F.lit(False)).withColumn("nth", F.lit(0).cast("long"))
    low, high, width = min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1]), abs(chosen.step)
    nth = F.expr(f"(position - {chosen[0]}) div {chosen.step}").cast("long")
    return mapping.where((F.col("position") >= low) & (F.col("position") <= high) & ((F.col("position") - low) % width == 0)).withColumn("nth", nth)


def position(mapping: DataFrame, number: int, index: int) -> int:
    """The sample at one place, counted from the end if it is negative; a place outside of the mapping is an error."""
    if not -number <= index < number:
        raise IndexError("index out of range")
    return mapping.where(F.col("position") == index % number).first()["sample"]


def offline_map(spark: SparkSession, size: int, seed: int, epochs: int | None = None, most: int | None = None) -> DataFrame:
    """(position, sample, epoch): as many passes over the rows as are asked for, or give ``most`` samples, all in one keyed order."""
    if epochs is None and most is None:
        raise ValueError("a map ends by its epochs or by its samples")
    passes = epochs if epochs is not None else -(-most // size)
    n = passes * size if most is None else min(most, passes * size)
    rows = spark.range(0, n).select(F.col("id"), (F.col("id") % size).alias("sample"), F.floor(F.col("id") / size).cast("long").alias("epoch"), F.lit(0).alias("whole"))
    return keyed_rank(rows, "whole", keyed(F.col("id"), seed), "id").select(F.col("rank").alias("position"), "sample", "epoch")


def block_shuffle(spark: SparkSession, size: int, number: int, block: int, seed: int) -> DataFrame:
    """(block, place, sample): blocks in a keyed order, rows within a block in a keyed order, samples modulo the data's size."""
    need = max(number, size)
    blocks = spark.range(0, -(-need // block)).select(F.col("id").alias("block"), keyed(F.col("id"), seed).alias("block_key"))
    rows = spark.range(0, need).select(F.col("id"), F.floor(F.col("id") / block).cast("long").alias("block"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(keyed(F.col("id"), F.col("block") + seed), "id")).cast("long") - 1
    return rows.join(blocks, "block").select("block_key", "block", place.alias("place"), (F.col("id") % size).alias("sample"))


def epoch_shuffle(spark: SparkSession, size: int, most: int, seed: int) -> DataFrame:
    """(position, sample, epoch): as many keyed permutations as give ``most`` samples, one after the other."""
    epochs = -(-most // size)
    rows = spark.range(0, epochs * size).select((F.col("id") % size).alias("sample"), F.floor(F.col("id") / size).cast("long").alias("epoch"))
    placed = keyed_rank(rows, "epoch", keyed(F.col("sample"), F.col("epoch") + seed), "sample")
    return placed.select((F.col("epoch") * size + F.col("rank")).alias("position"), "sample", "epoch").where(F.col("position") < most)


def repeat_modulo(rows: DataFrame, number: Column, size: int, target: int) -> DataFrame:
    """``rows`` numbered 0 to size - 1 by ``number``, repeated in order until ``target`` samples: adds ``position``."""
    times = -(-target // size)
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("position", F.col("epoch") * size + number).where(F.col("position") < target).drop("epoch")


def repeat_shuffled(rows: DataFrame, key: str, size: int, target: int, seed: int = 42) -> DataFrame:
    """``rows`` in a keyed order, over and over until there are ``target``: adds ``position``; the order is the same in each pass."""
    placed = keyed_rank(rows.withColumn("whole_", F.lit(0)), "whole_", keyed(F.col(key), seed), key).drop("whole_")
    return repeat_modulo(placed, F.col("rank"), size, target).drop("rank")


def chunk_shuffle(rows: DataFrame, number: Column, key: Column, chunk: int, seed: int) -> DataFrame:
    """Adds (chunk, chunk_key): sorting by them shuffles rows within chunks of ``chunk`` rows and keeps the chunks' order."""
    return rows.withColumn("chunk", F.floor(number / chunk).cast("long")).withColumn("chunk_key", keyed(key, seed))


def hash_split(rows: DataFrame, key: Column, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``split``: each row's split follows from its key alone. The shares add up to 1."""
    draw, upto, out = keyed(key, seed), 0.0, None
    for name, share in shares.items():
        upto += share
        bound = F.lit(f"{min(int(upto * 2**32), 2**32 - 1):08x}") if upto < 1 - 1e-12 else None
        inside = F.substring(draw, 1, 8) < bound if bound is not None else F.lit(True)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return rows.withColumn("split", out)


def stride_shard(rows: DataFrame, number: Column, shards: int) -> DataFrame:
    """Adds ``shard``: row i goes to shard i mod shards."""
    return rows.withColumn("shard", F.pmod(number, F.lit(shards)).cast("long"))


def contiguous_shard(rows: DataFrame, number: Column, total: int, shards: int) -> DataFrame:
    """Adds ``shard``: equal ranges of rows, the remainder in the last shard."""
    return rows.withColumn("shard", F.least(F.floor(number / max(total // shards, 1)), F.lit(shards - 1)).cast("long"))


def sample_counts(iterations: int, global_batch: int, interval: int, eval_iterations: int, eval_batch: int) -> tuple[int, int, int]:
    """Samples that training, validation and test need."""
    return iterations * global_batch, (iterations // interval + 1) * eval_iterations * eval_batch, eval_iterations * eval_batch


def blended(spark: SparkSession, weights: list[float], total: int) -> DataFrame:
    """(position, dataset): so many samples of each dataset by weight, spread evenly: the k-th of weight w stands at (k + 0.5) / w."""
    whole = sum(weights)
    counts = [int(total * w / whole) for w in weights]
    for i in sorted(range(len(weights)), key=lambda i: counts[i] - total * weights[i] / whole)[: total - sum(counts)]:
        counts[i] += 1
    parts = [spark.range(0, n).select(F.lit(i).cast("long").alias("dataset"), F.col("id").alias("nth"), ((F.col("id") * 2 + 1) / F.lit(2.0 * n)).alias("at")) for i, n in enumerate(counts) if n]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_of_each(rows: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each group; the planner keeps so many before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank_", rank).where(F.col("rank_") <= k).drop("rank_")


def extremes(scores: DataFrame, key: str, score: str, k: int = 3) -> DataFrame:
    """(key, worst, best): the ``k`` lowest and highest scores by two top-k selections, without a sort of all."""
    low = scores.orderBy(score, key).limit(k).select(key, F.lit(True).alias("worst"), F.lit(False).alias("best"))
    high = scores.orderBy(F.desc(score), key).limit(k).select(key, F.lit(False).alias("worst"), F.lit(True).alias("best"))
    return low.unionByName(high).groupBy(key).agg(F.max("worst").alias("worst"), F.max("best").alias("best"))


def parsed_blend(values: list[str]) -> tuple[list[str], list[float] | None]:
    """Paths and weights of a blend given as weight, path, weight, path, or as paths alone (no weights)."""
    if len(values) % 2 == 0:
        try:
            return values[1::2], [float(x) for x in values[::2]]
        except ValueError:
            pass
    return list(values), None


def blends(one: list[str] | None = None, by_split: dict[str, list[str]] | None = None) -> dict[str, tuple[list[str], list[float] | None]]:
    """The blend of all splits under None, or those of each split; both are an error, and neither means invented data."""
    if one and by_split:
        raise ValueError("either one blend or one for each split")
    if by_split:
        return {name: parsed_blend(by_split[name]) for name in ("train", "validation", "test") if by_split.get(name)}
    return {None: parsed_blend(one)} if one else {}
