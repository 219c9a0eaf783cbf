"""Tables of named tensors in files: which file holds which, loading by name or pattern, and writing whole shards.

A source of tensors has names and loads those that a pattern selects; what a model is made of is the same table whether it
comes from files or from memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.operators.joins import any_match, matching_names
from sparkprep.sources import archives

INDEX = "model.safetensors.index.json"


class TensorSource(Protocol):
    """What tensors are read from."""

    def names(self) -> DataFrame:
        """(name, file), a row for each tensor."""

    def load(self, pattern: str | re.Pattern | list[str]) -> DataFrame:
        """(name, dtype, shape, values) of the tensors that a name, glob, regular expression or list of names selects."""


class TableSource:
    """Tensors (name, dtype, shape, values) that are a table already."""

    def __init__(self, tensors: DataFrame) -> None:
        self.tensors = tensors

    def names(self) -> DataFrame:
        return self.tensors.select("name", F.lit(None).cast("string").alias("file"))

    def load(self, pattern: str | re.Pattern | list[str]) -> DataFrame:
        return chosen(self.tensors, pattern)


class FileSource:
    """Tensors of the safetensors files of a folder. Its index names each tensor's file; without one, files are looked through, and the last by name counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def names(self) -> DataFrame:
        index = archives.binary_files(self.spark, self.path, INDEX).select(F.col("content").cast("string").alias("text"))
        listed = index.select(F.explode(F.from_json("text", "weight_map map<string, string>")["weight_map"]).alias("name", "file"))
        if not listed.isEmpty():
            return listed
        return last_of_each(headers(self.spark, self.path)).select("name", "file")

    def load(self, pattern: str | re.Pattern | list[str]) -> DataFrame:
        found = archives.tensors(self.spark, self.path).withColumn("file", F.substring_index("path", "/", -1)).drop("path")
        return chosen(found.join(self.names(), ["name", "file"]).drop("file"), pattern)

    def has(self, pattern: str | re.Pattern) -> bool:
        """Whether a tensor's name fits; the look ends with the first."""
        return any_match(self.names(), "name", pattern)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(name, file): what the headers of the files list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = int.from_bytes(content[:8], "little")
                held = [k for k in json.loads(content[8 : 8 + size]) if k != "__metadata__"]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([name.rsplit("/", 1)[-1]] * len(held), pa.string())], ["name", "file"])

    return archives.binary_files(spark, path, "*.safetensors").mapInArrow(run, "name string, file string")


def last_of_each(names: DataFrame) -> DataFrame:
    """(name, file, copies): of files that hold one name the last, and how many there are."""
    return names.groupBy("name").agg(F.max("file").alias("file"), F.count(F.lit(1)).alias("copies"))


def chosen(tensors: DataFrame, pattern: str | re.Pattern | list[str]) -> DataFrame:
    """The tensors that a pattern or a list of names selects; nothing, or a missing name of a list, is an error."""
    if not isinstance(pattern, list):
        return matching_names(tensors, "name", pattern, required=True)
    found = tensors.where(F.col("name").isin(pattern))
    missing = sorted(set(pattern) - {r[0] for r in found.select("name").distinct().collect()})  # as many as the caller asked for
    if missing:
        raise KeyError(f"missing: {missing}")
    return found


def whole_shards(tensors: DataFrame, plan: DataFrame, strict: bool = True) -> DataFrame:
    """The tensors (name, ...) with their ``file`` by the plan (name, file), as far as files are written.

    Strict, a name that the plan lacks is an error, and a file is written once all of its tensors are there. Otherwise unknown names go, and
    files are written with what there is.
    """
    if strict:
        extra = [r[0] for r in tensors.select("name").join(plan, "name", "left_anti").orderBy("name").limit(20).collect()]
        if extra:
            raise KeyError(f"not in the plan: {extra}")
    placed = tensors.join(plan, "name")
    if not strict:
        return placed
    short = plan.join(tensors.select("name"), "name", "left_anti").select("file").distinct()
    return placed.join(short, "file", "left_anti")


def unwritten(tensors: DataFrame, plan: DataFrame) -> DataFrame:
    """(file, missing): for each file of the plan that can't be written whole, the tensors that it lacks."""
    return plan.join(tensors.select("name"), "name", "left_anti").groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("missing"))


def written_index(placed: DataFrame) -> str:
    """The index of written shards as JSON: the file of each tensor, and the bytes in all. Names are a model's, some ten thousand."""
    rows = placed.select("name", "file", (F.size("values") * 4).cast("long").alias("bytes")).orderBy("name").collect()
    return json.dumps({"metadata": {"total_size": sum(r["bytes"] for r in rows)}, "weight_map": {r["name"]: r["file"] for r in rows}}, indent=2)


def natural_order(names: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``place``: by layer number, then expert number, -1 without one, then name. Names are a model's, so one task orders them."""
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(name, p, 1), F.lit("")).cast("long"), F.lit(-1))
    grouped = F.regexp_extract(name, r"(?:bias|weight)(\d+)", 1) != ""
    layer, expert = number(r"layers\.(\d+)"), F.when(grouped, number(r"(?:bias|weight)(\d+)")).otherwise(number(r"local_experts\.(\d+)"))
    # Without a layer, an expert's number takes the first place.
    first, second = F.when(layer < 0, expert).otherwise(layer), F.when(layer < 0, F.lit(-1)).otherwise(expert)
    return names.withColumn("place", F.row_number().over(Window.orderBy(first, second, name)).cast("long") - 1)


def without_tied_output(names: DataFrame, tied: bool, name: str = "name") -> DataFrame:
    """Names without those of the output layer where it shares the embedding's weights."""
    return names.where(~F.contains(F.col(name), F.lit("output_layer"))) if tied else names
