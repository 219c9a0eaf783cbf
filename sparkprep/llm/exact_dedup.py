"""Exact deduplication by an extendible-hash index in the shared folder.

1. One pass writes the index entries: (doc_id, hash, sha256) of every text with A-Z in lower case. Hashes with one entry are
   settled; the others are crowded.
2. The directory over the crowded hashes is built from their counts by prefix: it starts with one bucket, and an overfull
   bucket splits, which doubles the directory when the bucket is as deep as the directory. A hash counts once, so a text that
   a third of all rows hold can't overfill a bucket. The prefixes counted are as long as the number of hashes asks for. The
   directory also deals the buckets, in their order, to owner tasks: each owns a range of keys with its share of the hashes.
   It is written beside the entries and joined to the crowded hashes there.
3. Texts are joined to the crowded hashes; where these are few the planner broadcasts them, so only texts with a copy travel.
   A task gathers equal texts in a dictionary (by their bytes, a bounded number of them at a time) into carriers: one text with the ids of its
   copies. Carriers go to the task that owns their bucket, sorted by bucket and hash; it chains the different texts of one hash and compares bytes.
4. Carriers of one chain link are added up, and each carrier hands the result to its rows.

A null text counts as empty; empty texts equal each other. Of equal texts the row with the largest doc_id stays; where rows
repeat that doc_id, just one of them. A null doc_id is less than any other. Texts of any length are compared whole. An empty
table gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.common import arrow_rows, materialise
from sparkprep.llm.line_dedup import LOWER, UPPER

#: The directory's depth at most, and the hashes of a bucket that make it split; more where the depth can't hold them.
MAX_DEPTH, CAPACITY = 20, 200
#: Hashes that an owner task has in the mean, and owners at most.
OWNED, MAX_OWNERS = 500, 20_000
#: Bytes of different texts and ids that a task gathers before it lets its carriers go.
GATHERED = 64 << 20
#: Stands for a null doc_id among the ids of a carrier; it is less than any other.
NO_ID = -(1 << 63)


def lowered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h): each text with A-Z in lower case, and its hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ``lower`` does the same on ASCII and is much faster than ``translate``.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("text")).withColumn("h", F.xxhash64("text"))


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text_sha256) of each row."""
    return lowered(docs).select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))


def directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """The depth of the directory, and for each of its slots the bucket: (prefix, its own depth).

    ``counts``: entries for each prefix of ``max_depth`` bits. A bucket with more than ``capacity`` entries splits as long as
    ``max_depth`` allows; a bucket as deep as the directory doubles it first.
    """
    sums = [np.zeros(1 << max_depth, np.int64)]
    for prefix, n in counts.items():
        sums[0][prefix] = n
    for _ in range(max_depth):
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    sums.reverse()
    depth, slots, full = 0, [(0, 0)], [(0, 0)]
    while full:
        prefix, own = full.pop()
        if own == max_depth or sums[own][prefix] <= capacity:
            continue
        if own == depth:
            slots, depth = [bucket for bucket in slots for _ in range(2)], depth + 1
        for half in (2 * prefix, 2 * prefix + 1):
            span = 1 << (depth - own - 1)
            slots[half * span : (half + 1) * span] = [(half, own + 1)] * span
            full.append((half, own + 1))
    return depth, slots


def build_directory(spark: SparkSession, hashes: DataFrame) -> tuple[DataFrame, int, int]:
    """(slot, bucket, depth, owner): the directory over prefixes of the hashes, in the shared folder; their bits, and the owners."""
    n = hashes.count()
    bits = min(MAX_DEPTH, max(4, (n // CAPACITY).bit_length() + 3))
    capacity = max(CAPACITY, 8 * n >> bits)
    counts = {r[0]: r[1] for r in hashes.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("p")).count().collect()}  # 2 ** MAX_DEPTH rows at most
    depth, slots = directory(counts, capacity, bits)
    first = {bucket: i for i, bucket in reversed(list(enumerate(slots)))}
    owners, before, rows, owner = min(n // OWNED, MAX_OWNERS - 1) + 1, 0, [], {}
    for slot in range(1 << bits):
        bucket = slots[slot >> (bits - depth)]
        # A bucket belongs to the owner in whose share of the hashes it begins.
        own = owner.setdefault(bucket, min(owners - 1, before * owners // max(n, 1)))
        rows.append((slot, first[bucket], bucket[1], own))
        before += counts.get(slot, 0)
    return materialise(spark.createDataFrame(rows, "slot long, bucket int, depth int, owner int"), "directory"), bits, owners


def carriers(texts: DataFrame) -> DataFrame:
    """(owner, bucket, h, text, ids, carrier): texts (doc_id, text, h, bucket, owner) that may have copies, those of one task gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, size = TaskContext.get().partitionId() << 32, 0, 0
        held: dict[bytes, tuple[int, int, int, list[int]]] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal out
            keys = list(held)
            for start in range(0, len(keys), 500):
                texts = keys[start : start + 500]
                owner, bucket, h, ids = zip(*(held[x] for x in texts))
                numbers = list(range(task + out, task + out + len(texts)))
                out += len(texts)
                columns = [pa.array(owner, pa.int32()), pa.array(bucket, pa.int32()), pa.array(h, pa.int64()), pa.array(texts, pa.binary()), pa.array([sorted(x, reverse=True) for x in ids], pa.list_(pa.int64())), pa.array(numbers, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["owner", "bucket", "h", "text", "ids", "carrier"])
            held.clear()

        for batch in arrow_rows(batches):
            for doc_id, text, h, bucket, owner in zip(*(c.to_pylist() for c in batch.columns)):
                if text not in held:
                    held[text] = (owner, bucket, h, [])
                    size += len(text)
                held[text][3].append(NO_ID if doc_id is None else doc_id)
                size += 8
            if size > GATHERED:
                yield from emptied()
                size = 0
        yield from emptied()

    return texts.select("doc_id", F.col("text").cast("binary"), "h", "bucket", "owner").mapInArrow(run, "owner int, bucket int, h long, text binary, ids array<long>, carrier long")


def chained(sorted_carriers: DataFrame) -> DataFrame:
    """(h, link, ids, carrier, text_sha256): link numbers the different texts of one hash. The rows come sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain = None, []
        for batch in batches:
            links, digests = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h != now:
                    now, chain = h, []
                for link, other in enumerate(chain):
                    if other == text:
                        break
                else:
                    link = len(chain)
                    chain.append(text)
                links.append(link)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(links, pa.int32()), batch.column(2), batch.column(3), pa.array(digests, pa.string())], ["h", "link", "ids", "carrier", "text_sha256"])

    return sorted_carriers.select("h", "text", "ids", "carrier").mapInArrow(run, "h long, link int, ids array<long>, carrier long, text_sha256 string")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``."""
    index = materialise(entries(docs), "entries")
    hashes = materialise(index.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h"), "crowded")
    slots, bits, owners = build_directory(docs.sparkSession, hashes)
    found = hashes.join(slots, F.shiftrightunsigned("h", 64 - bits) == slots["slot"]).select("h", "bucket", "owner")
    crowded = materialise(found, "owned")
    owned = carriers(lowered(docs).join(crowded, "h")).repartitionById(owners, "owner").sortWithinPartitions("bucket", "h")
    links = materialise(chained(owned), "chains")
    top = F.struct(F.col("ids")[0].alias("id"), F.col("carrier"))
    sums = links.groupBy("h", "link").agg(F.max(top).alias("top"), F.sum(F.size("ids")).alias("group_size"))
    named = lambda x: F.nullif(x, F.lit(NO_ID))
    copies = links.join(sums, ["h", "link"]).select(F.posexplode("ids").alias("place", "id"), named(F.col("top.id")).alias("keep_id"), "group_size", (F.col("carrier") == F.col("top.carrier")).alias("holds"), "text_sha256")
    copies = copies.select(named(F.col("id")).alias("doc_id"), "keep_id", "group_size", (F.col("holds") & (F.col("place") == 0)).alias("kept"), "text_sha256")
    single = index.join(crowded.select("h"), "h", "left_anti")
    return single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256").unionByName(copies)
