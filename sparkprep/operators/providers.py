"""Providers of datasets by the type of their configuration, collators by processor, and encoders of samples and batches.

A provider gives a plan for each split; nothing is read before a plan is run. Invented rows are made from ``spark.range`` by
keyed hashes, so they need no input and are the same everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions import arrays as A
from sparkprep.functions import media
from sparkprep.operators import makers
from sparkprep.operators.builders import provider, weighted_split
from sparkprep.operators.records import split_name
from sparkprep.operators.sampling import hash_split
from sparkprep.sources import readers

SPLITS = ("train", "validation", "test")


def with_validation(splits: dict[str, DataFrame], key: Column, share: float | None, from_train: bool = True, seed: int = 1234) -> dict[str, DataFrame]:
    """The splits train, validation and test of those that there are, by their usual names.

    With a ``share``, validation is drawn from the training rows, and what was validation becomes the test split; or it is drawn
    from the validation rows, whose rest becomes the test split. A test split that there is stays. Without a share splits stay as they are.
    """
    held = dict(splits)
    if "train" not in held:
        raise ValueError("there is no training split")
    if share is None:
        return held
    source = "train" if from_train else "validation"
    if source not in held:
        raise ValueError(f"there is no {source} split to draw from")
    marked = hash_split(held[source], key, {"drawn": share, "left": 1 - share}, seed)
    drawn, left = (marked.where(F.col("split") == name).drop("split") for name in ("drawn", "left"))
    if from_train:
        out = {"train": left, "validation": drawn} | ({"test": held["validation"]} if "validation" in held else {})
    else:
        out = {"train": held["train"], "validation": drawn, "test": left}
    return out | ({"test": held["test"]} if "test" in held else {})


def named_splits(rows: DataFrame, column: str) -> dict[str, DataFrame]:
    """The rows of each usual split of a column that names splits in any of their ways. One name for each split reaches the driver."""
    marked = rows.withColumn("split_", split_name(F.col(column)))
    names = [r[0] for r in marked.select("split_").distinct().limit(100).collect()]
    return {n: marked.where(F.col("split_") == n).drop("split_", column) for n in SPLITS if n in names}


@dataclass(frozen=True)
class Pretraining:
    """Token rows (id, ids), or invented ones; samples are their documents, permuted for infilling if ``infill`` says how."""

    rows: DataFrame | None = None
    weights: str = "9999,8,2"
    invented: int = 0
    length: int = 128
    vocabulary: int = 1000
    infill: Callable[[Column, Column], Column] | None = None
    seed: int = 1234


def invented_tokens(spark: SparkSession, n: int, length: int, vocabulary: int, seed: int) -> DataFrame:
    """(id, ids): rows of tokens by a keyed hash."""
    draw = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(vocabulary))
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), draw).alias("ids"))


@provider(Pretraining)
def pretraining(spark: SparkSession, config: Pretraining) -> dict[str, DataFrame]:
    rows = config.rows if config.rows is not None else invented_tokens(spark, config.invented, config.length, config.vocabulary, config.seed)
    if config.infill:
        rows = rows.withColumn("ids", config.infill(F.col("ids"), F.col("id")))
    split = weighted_split(rows, F.col("id"), config.weights if config.rows is not None else "1,1,1", config.seed)
    return {name: split.where(F.col("split") == name).drop("split") for name in SPLITS}


@dataclass(frozen=True)
class Conversations:
    """Rows of a known dataset for each split, made into conversations by a maker's short name and its columns."""

    rows: dict[str, DataFrame]
    maker: str
    columns: dict[str, str] = field(default_factory=dict)


@provider(Conversations)
def conversations(spark: SparkSession, config: Conversations) -> dict[str, DataFrame]:
    make, out = makers.maker(config.maker), {}
    for name, rows in config.rows.items():
        if config.maker in ("described", "medical"):
            out[name] = rows.withColumn("conversation", make(**{k: F.col(c) for k, c in config.columns.items()}))
        else:
            out[name] = make(rows, **config.columns)
    return out


@dataclass(frozen=True)
class Preloaded:
    """Files of records with messages or conversations and their media, by split; media paths are under ``root``."""

    paths: dict[str, str]
    root: str
    schema: str = "id string, text string, images array<string>, videos array<string>"


@provider(Preloaded)
def preloaded(spark: SparkSession, config: Preloaded) -> dict[str, DataFrame]:
    from sparkprep.functions.text import absolute_path

    paths = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: absolute_path(x, config.root))
    made = lambda df: df.withColumn("content", media.placed_media(F.col("text"), paths(F.col("images")), paths(F.col("videos"))))
    return {name: made(readers.json_lines(spark, path, config.schema)) for name, path in config.paths.items()}


@dataclass(frozen=True)
class InventedConversations:
    """Conversations with invented pictures and answers, ``n`` for each split."""

    n: int = 1000
    images: int = 1
    prompt: str = "Describe this image."
    words: tuple[str, ...] = ("a", "large", "small", "red", "green", "bright", "house", "tree", "moves", "stands", "behind", "the", "river")
    seed: int = 0


@provider(InventedConversations)
def invented_conversations(spark: SparkSession, config: InventedConversations) -> dict[str, DataFrame]:
    words = F.array(*map(F.lit, config.words))

    def one(name: str, offset: int) -> DataFrame:
        draw = lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), i, F.lit(config.seed + offset)), F.lit(len(config.words))) + 1).cast("int"))
        answer = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), draw), " ")
        pictures = [makers.part("image", F.concat_ws("-", F.lit(name), "id", F.lit(k))) for k in range(config.images)]
        return spark.range(config.n).select("id", makers.exchange([*pictures, makers.part("text", F.lit(config.prompt))], answer).alias("conversation"))

    return {name: one(name, k) for k, name in enumerate(SPLITS)}


@dataclass(frozen=True)
class Multimodal:
    """Rows (id, ids) with a column for each modality, or invented ones: placeholders stand for each modality before the text.

    ``placeholders`` names for each modality its token and its number of places. Invented splits draw from seeds far apart.
    """

    placeholders: dict[str, tuple[int, int]]
    room: int
    rows: dict[str, DataFrame] = field(default_factory=dict)
    invented: dict[str, int] = field(default_factory=dict)
    vocabulary: int = 1000
    pad: int = 0
    seed: int = 0


@provider(Multimodal)
def multimodal(spark: SparkSession, config: Multimodal) -> dict[str, DataFrame]:
    rows = config.rows or {name: invented_tokens(spark, n, config.room, config.vocabulary, config.seed + 1_000_000 * SPLITS.index(name)) for name, n in config.invented.items()}
    front = sum(n for _, n in config.placeholders.values())
    if front > config.room:
        raise ValueError(f"{front} placeholders don't fit in {config.room} places")

    def made(df: DataFrame) -> DataFrame:
        places = [F.array_repeat(F.lit(token).cast("long"), n) for token, n in config.placeholders.values()]
        ids, labels = media.media_prefix(F.col("ids"), 0, front, config.room, config.pad)
        own = F.concat(*places, F.slice(ids, front + 1, config.room)) if places else ids
        return df.select("id", own.alias("input_ids"), labels.alias("labels"), F.transform(labels, lambda x: (x != A.IGNORE).cast("long")).alias("loss_mask"), *(c for c in config.placeholders if c in df.columns))

    return {name: made(df) for name, df in rows.items()}


@dataclass(frozen=True)
class Archives:
    """Tar shards of samples for each split, and how a sample's members (key, extension, kind, content) become rows."""

    paths: dict[str, str]
    encode: Callable[[DataFrame], DataFrame]


@provider(Archives)
def archived(spark: SparkSession, config: Archives) -> dict[str, DataFrame]:
    from sparkprep.sources.archives import tar_members

    kinds = lambda df: df.withColumn("kind", media.decoder_kind(F.concat(F.lit("."), "extension")))
    return {name: config.encode(kinds(tar_members(spark, path))) for name, path in config.paths.items()}


#: Collators by the name of the processor whose samples they put together.
COLLATORS: dict[str, Callable[..., DataFrame]] = {}


def collator(*names: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function that puts the samples of a batch together for processors of these names."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for name in names:
            COLLATORS[name] = f
        return f

    return add


def collated(rows: DataFrame, processor: str, batch: str, order: str, **options: int) -> DataFrame:
    """The rows of each batch as one, by the processor's collator or else the default one."""
    return COLLATORS.get(processor, COLLATORS["default"])(rows, batch, order, **options)


def padded_lists(rows: DataFrame, batch: str, order: str, pads: dict[str, int]) -> DataFrame:
    """(batch, columns of ``pads``): arrays of a batch's rows in order, each padded to the longest of the batch.

    A batch is as large as its caller makes it, so the lists are bounded.
    """
    most = F.max(F.greatest(*(F.size(c) for c in pads), F.lit(0)))
    held = rows.groupBy(batch).agg(most.alias("most"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *(F.col(c).cast("array<bigint>").alias(c) for c in pads)))).alias("r"))
    padded = lambda c, p: F.transform("r", lambda r: A.pad_right(r[c], F.col("most"), p)).alias(c)
    return held.select(batch, *(padded(c, p) for c, p in pads.items()))


@collator("default")
def default_collator(rows: DataFrame, batch: str, order: str, pad: int = 0) -> DataFrame:
    """(batch, input_ids, labels, loss_mask): next-token labels of each row, ignored where the next token isn't learnt from."""
    shifted = rows.withColumn("labels", A.masked_labels(A.next_labels(F.col("input_ids").cast("array<bigint>")), A.packed_mask_of(F.col("loss_mask"))))
    return padded_lists(shifted.withColumn("loss_mask", A.packed_mask_of(F.col("loss_mask"))), batch, order, {"input_ids": pad, "labels": A.IGNORE, "loss_mask": 0})


@collator("Qwen2_5_VLProcessor", "Qwen3VLProcessor")
def collator_with_and_without_media(rows: DataFrame, batch: str, order: str, pad: int = 0, media_column: str = "images") -> DataFrame:
    """As the default, with ``n_media``, the media of the rows that have some, in the order of the rows."""
    counted = rows.groupBy(batch).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(media_column, F.array().cast("array<string>")).alias("m")))), lambda r: r["m"])).alias("media"))
    return default_collator(rows, batch, order, pad).join(counted, batch)


@collator("audio")
def collator_after_last_answer(rows: DataFrame, batch: str, order: str, pad: int = 0, answer: str = "answer") -> DataFrame:
    """As the default, where what is learnt from begins with the last place of the answer's tokens; a row without it isn't learnt from."""
    at = A.find_array_last(F.col(answer).cast("array<bigint>"), F.col("input_ids").cast("array<bigint>"))
    masked = rows.withColumn("loss_mask", F.transform("input_ids", lambda _, i: ((at >= 0) & (i >= at)).cast("long")))
    return default_collator(masked, batch, order, pad)


def modalities_collated(rows: DataFrame, batch: str, order: str, ids: list[str], modalities: list[str]) -> DataFrame:
    """(batch, each column of ``ids`` as a list of its rows' arrays, each modality as the list of its rows' values, missing ones left out).

    A modality that no row of a batch has is null.
    """
    held = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *ids, *modalities))).alias("r"))
    every = lambda c: F.transform("r", lambda r: r[c])
    values = lambda c: F.filter(every(c), lambda x: x.isNotNull())
    return held.select(batch, *(every(c).alias(c) for c in ids), *(F.when(F.size(values(c)) > 0, values(c)).alias(c) for c in modalities))


@dataclass(frozen=True)
class Encoder:
    """How samples become batches: each sample encoded, then put together by number, then each batch encoded."""

    sample: Callable[[DataFrame], DataFrame]
    together: Callable[[DataFrame, str], DataFrame]
    batch: Callable[[DataFrame], DataFrame] = lambda df: df

    def run(self, rows: DataFrame, number: Column, size: int) -> DataFrame:
        """Batches of ``size`` samples by their numbers."""
        numbered = self.sample(rows).withColumn("batch", F.floor(number / size).cast("long"))
        return self.batch(self.together(numbered, "batch"))


#: What a dataset type's name stands for: the configuration's class and its settings.
DATASET_TYPES: dict[str, tuple[type, dict]] = {
    "pretrain": (Pretraining, {"weights": "9999,8,2"}),
    "pretrain-mock": (Pretraining, {"invented": 1000}),
    "conversations": (Conversations, {}),
    "conversations-mock": (InventedConversations, {}),
    "preloaded": (Preloaded, {}),
    "multimodal": (Multimodal, {}),
}


def configured(name: str, **settings: object) -> object:
    """The configuration that a dataset type's name stands for, with the caller's settings; an unknown name is an error."""
    if name not in DATASET_TYPES:
        raise ValueError(f"no dataset type {name}; there are {sorted(DATASET_TYPES)}")
    kind, known = DATASET_TYPES[name]
    return kind(**(known | settings))


