"""Loaders as plans: which row comes in which step to which rank, for training, validation and test.

A plan is (idx, step, rank, slot, is_padding); joined to the rows by number it is the batches. Plans come from ``spark.range``,
so they have no state: where to go on is a number of consumed samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkprep.operators.sampling import global_batches, random_sharded, random_unsharded, sample_counts, sequential

KINDS = ("single", "cyclic", "batch", "external")
COLUMNS = ["idx", "step", "rank", "slot", "is_padding"]


def loader(spark: SparkSession, kind: str, total: int, consumed: int, micro: int, ranks: int, sharding: bool = True, drop_last: bool = True, global_batch: int | None = None) -> DataFrame | None:
    """The plan of one pass. ``single`` goes through the rows in order, ``cyclic`` in a keyed order for each epoch, ``batch`` by
    global batches, whose tail is dropped or padded; ``external`` leaves it to the caller (None)."""
    if kind not in KINDS:
        raise ValueError(f"no loader {kind}; there are {KINDS}")
    if total <= 0 and kind != "external":
        raise ValueError("there is no sample to consume")
    no = F.lit(False).alias("is_padding")
    if kind == "single":
        return sequential(spark, total, consumed, micro, ranks, drop_last).select("idx", "step", "rank", "slot", no)
    if kind == "cyclic":
        if sharding:
            offset = consumed % (total - total % (micro * ranks)) // ranks
            placed = random_sharded(spark, total, consumed, micro, ranks).withColumn("nth", F.col("position") - offset)
            whole = placed.where(F.col("nth") < (F.lit(total // (micro * ranks) * micro - offset)))
        else:
            whole = random_unsharded(spark, total, consumed, micro, ranks)
        return whole.select("idx", F.expr(f"nth div {micro}").alias("step"), "rank", (F.col("nth") % micro).alias("slot"), no)
    if kind == "batch":
        if global_batch is None:
            raise ValueError("a loader by batches needs the size of a global batch")
        plan = global_batches(spark, total, consumed, global_batch, micro, ranks, "drop" if drop_last else "pad")
        each = global_batch // (micro * ranks)
        return plan.select("idx", (F.col("step") * each + F.col("micro_step")).alias("step"), "rank", F.lit(None).cast("long").alias("slot"), "is_padding")
    return None


def repeated(plan: DataFrame, passes: int) -> DataFrame:
    """The plan over and over: the steps of each pass follow those of the one before; adds ``pass``."""
    steps = plan.agg(F.max("step")).first()[0]
    each = 0 if steps is None else steps + 1
    return plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("step", F.col("step") + F.col("pass") * each)


@dataclass(frozen=True)
class Training:
    """Numbers that decide how many samples each split needs."""

    iterations: int
    global_batch: int
    micro: int = 1
    ranks: int = 1
    eval_interval: int | None = None
    eval_iterations: int = 0
    eval_global_batch: int | None = None
    samples: int | None = None
    kind: str = "single"

    def counts(self) -> tuple[int, int, int]:
        """Samples that training, validation and test need."""
        eval_batch = self.eval_global_batch or self.global_batch
        train, valid, test = sample_counts(self.iterations, self.global_batch, self.eval_interval or 1, self.eval_iterations, eval_batch)
        return self.samples if self.samples is not None else train, valid if self.eval_interval else 0, test


def split_loaders(spark: SparkSession, training: Training, sizes: dict[str, int], consumed: dict[str, int] | None = None) -> dict[str, DataFrame | None]:
    """The plans of the splits that are run at all (others are None); fewer training rows than a global batch are an error."""
    if training.kind != "external" and sizes.get("train", 0) < training.global_batch:
        raise ValueError(f"{sizes.get('train', 0)} training rows are fewer than a global batch of {training.global_batch}")
    runs = {"train": training.iterations > 0, "validation": training.eval_iterations > 0, "test": training.eval_iterations > 0}
    done = consumed or {}
    return {name: loader(spark, training.kind, sizes[name], done.get(name, 0), training.micro, training.ranks, global_batch=training.global_batch) if run and sizes.get(name) else None for name, run in runs.items()}


def iterated(plans: dict[str, DataFrame | None], kind: str, passes: int) -> dict[str, DataFrame | None]:
    """Plans as they are iterated: once for ``single``, over and over for ``cyclic`` and ``batch``."""
    return {name: plan if plan is None or kind == "single" else repeated(plan, passes) for name, plan in plans.items()}


def pulled(rows: DataFrame, plan: DataFrame, number: Column, micro_batches: int) -> DataFrame:
    """The rows of each step with the micro batch that they are in: ranks' slots cut into ``micro_batches`` equal parts."""
    numbered = rows.withColumn("idx", number)
    held = plan.join(numbered, "idx", "left")
    most = plan.agg(F.max("slot")).first()[0]
    each = (most + 1) // micro_batches
    if (most + 1) % micro_batches:
        raise ValueError("a batch divides into its micro batches")
    return held.withColumn("micro_batch", F.floor(F.col("slot") / each).cast("long"))


def shared(df: DataFrame, sinks: list[Callable[[DataFrame], object]]) -> list[object]:
    """Every sink sees the same rows, which are made once and let go at the end."""
    held = df.persist()
    try:
        return [sink(held) for sink in sinks]
    finally:
        held.unpersist()


def sliced(plan: DataFrame, ranks: int) -> DataFrame:
    """A plan made for one rank dealt to several: each takes an equal range of a step's slots, which have to divide."""
    most = plan.agg(F.max("slot")).first()[0]
    if most is not None and (most + 1) % ranks:
        raise ValueError("a batch divides over its ranks")
    each = ((most or 0) + 1) // ranks
    return plan.withColumns({"rank": F.floor(F.col("slot") / each).cast("long"), "slot": F.col("slot") % each})


def saved_state(spark: SparkSession, path: str, consumed: dict[str, int]) -> None:
    """Writes how many samples of each split are consumed: all that a loader goes on from."""
    spark.createDataFrame(list(consumed.items()), "split string, consumed long").coalesce(1).write.mode("overwrite").parquet(path)


def restored_state(spark: SparkSession, path: str) -> dict[str, int]:
    return {r["split"]: r["consumed"] for r in spark.read.parquet(path).collect()}  # a row for each split


def due(step: Column, every: int | None) -> Column:
    """Whether something that is done every so many steps, such as evaluation, is due behind a step."""
    return F.lit(False) if not every else (step > 0) & (step % every == 0)


def tolerant(rows: DataFrame, value: Column, failed: Callable[[Column], Column] = lambda x: x.isNull()) -> DataFrame:
    """Adds ``value`` and ``failed``: what could be made of each row, null where it couldn't; rows and their order stay.

    ``value`` is an expression that gives null on failure, such as those of try_cast, try_element_at or from_json.
    """
    return rows.withColumn("value", value).withColumn("failed", failed(F.col("value")))


def tolerant_map(rows: DataFrame, column: str, made: Callable[[object], object], kind: str) -> DataFrame:
    """Adds ``value`` of type ``kind`` and ``error``: what a Python function makes of a column, or null and what it raised; rows stay as they are.

    For functions that no expression replaces; a batch of rows goes to Python at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for x in batch.column(column).to_pylist():
                try:
                    values.append(made(x))
                    errors.append(None)
                except Exception as error:  # whatever the function raises is the row's result
                    values.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, own), pa.array(errors, pa.string())], names)

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"value {kind}, error string").fields])
    names, own = schema.names, to_arrow_type(schema["value"].dataType)
    return rows.mapInArrow(run, schema)
