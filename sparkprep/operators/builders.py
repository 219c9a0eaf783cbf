"""Whole dataset jobs: configurations that check themselves, choice of a source by its path, and builders of splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.operators.packing import assign_bins, fill
from sparkprep.operators.sampling import hash_split, keyed
from sparkprep.sources import readers

Builder = Callable[[SparkSession, object], dict[str, DataFrame]]
PROVIDERS: dict[type, Builder] = {}


def provider(kind: type) -> Callable[[Builder], Builder]:
    """Registers a function that builds datasets from configurations of exactly this type."""

    def add(f: Builder) -> Builder:
        PROVIDERS[kind] = f
        return f

    return add


def build(spark: SparkSession, config: object) -> dict[str, DataFrame]:
    """The datasets of a configuration, by split."""
    if type(config) not in PROVIDERS:
        raise KeyError(f"nothing builds datasets from {type(config).__name__}")
    return PROVIDERS[type(config)](spark, config)


@dataclass(frozen=True)
class PackingConfig:
    """How rows are packed. size 0 leaves them as they are."""

    size: int = 0
    multiple: int = 1
    pad: int = 0
    packed_path: str | None = None

    def __post_init__(self) -> None:
        if self.size < 0 or self.multiple < 1:
            raise ValueError("a packing size is not negative, and a multiple is at least 1")
        if self.packed_path and not readers.is_packed_path(self.packed_path):
            raise ValueError("packed rows have names that end in .idx.parquet or .idx.pq")


@dataclass(frozen=True)
class TuningData:
    """Rows (id, input_ids, loss_mask) with a filter, shares of the splits, and how they are packed; the test split never is."""

    rows: DataFrame
    keep: Column | None = None
    change: Callable[[DataFrame], DataFrame] | None = None
    shares: dict[str, float] = field(default_factory=lambda: {"train": 0.9, "validation": 0.05, "test": 0.05})
    packing: PackingConfig = PackingConfig()
    seed: int = 0
    most: dict[str, int] = field(default_factory=dict)


@provider(TuningData)
def tuning_data(spark: SparkSession, config: TuningData) -> dict[str, DataFrame]:
    """Filter, change, split, limit, pack: a plan for each split; nothing runs before it is read but the packing's histogram."""
    rows = config.rows if config.keep is None else config.rows.where(config.keep)
    rows = config.change(rows) if config.change else rows
    marked = hash_split(rows, F.col("id"), config.shares, config.seed)
    out = {}
    for name in config.shares:
        part = marked.where(F.col("split") == name).drop("split")
        if name in config.most:
            part = part.orderBy("id").limit(config.most[name])
        if config.packing.size and name != "test":
            part = fill(assign_bins(part.withColumn("length", F.size("input_ids").cast("long")), config.packing.size))
        out[name] = part
    return out


def source_kind(path: str, chat: bool = False) -> str:
    """What a training path holds: packed rows, chat records or plain records."""
    if readers.is_parquet_spec(path):
        return "packed"
    if path.lower().endswith(".npy"):
        raise ValueError("packed arrays in .npy are not read; write packed Parquet")
    return "chat" if chat else "records"


def opened(spark: SparkSession, path: str, schema: str, chat: bool = False) -> DataFrame:
    """The rows of a training path by its kind."""
    return readers.packed_rows(spark, path) if source_kind(path, chat) == "packed" else readers.json_lines(spark, path, schema)


def split_weights(data: list[str] | None, by_split: bool = False) -> str | None:
    """Weights of train, validation and test: equal for invented data, mostly training for one blend, none for a blend for each."""
    if by_split:
        return None
    return "9999,8,2" if data else "1,1,1"


def weighted_split(rows: DataFrame, key: Column, weights: str, seed: int = 0) -> DataFrame:
    """Adds ``split`` by weights such as 9999,8,2."""
    numbers = [float(x) for x in weights.split(",")]
    shares = [x / sum(numbers) for x in numbers]
    return hash_split(rows, key, dict(zip(("train", "validation", "test"), shares)), seed)


def shuffled_order(key: Column, seed: int) -> Column:
    """The order of a keyed shuffle, for first fit in shuffled order: sort by it, then place."""
    return keyed(key, seed, "shuffle")
