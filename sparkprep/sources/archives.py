"""Archives and tensor files read by the executors: zstd streams, tar shards and safetensors.

A file is a row of Spark's binary source, so one task holds one file's bytes; shards of some hundred MB are the unit that
such formats are made in. Writers put one shard in each task through a folder that all executors share.
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line): the lines of zstd-compressed text files, read as streams in bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[str] = []
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as raw:
                    for line in io.TextIOWrapper(raw, "utf-8", newline="\n"):
                        held.append(line.removesuffix("\n"))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held)], ["path", "line"])
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held)], ["path", "line"])

    return binary_files(spark, path, "*.zst").mapInArrow(run, "path string, line string")


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, extension, offset, content): the members of tar shards; a member's key is its name up to the first dot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile():
                            folder, _, base = member.name.rpartition("/")
                            stem, _, extension = base.partition(".")
                            yield pa.RecordBatch.from_pylist([{"path": name, "key": f"{folder}/{stem}" if folder else stem, "extension": extension, "offset": member.offset, "content": tar.extractfile(member).read()}])

    return binary_files(spark, path, "*.tar").mapInArrow(run, "path string, key string, extension string, offset long, content binary")


def samples(members: DataFrame) -> DataFrame:
    """(path, key, parts): each sample's members by extension."""
    return members.groupBy("path", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extension", "content")))).alias("parts"))


def tar_shards(rows: DataFrame, key: str, shard: str) -> DataFrame:
    """(shard, content): a tar file for each shard, with the members (key, extension, content) in the order of their keys."""

    def run(group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for row in sorted(group.to_pylist(), key=lambda r: (r[key], r["extension"])):
                info = tarfile.TarInfo(f"{row[key]}.{row['extension']}")
                info.size = len(row["content"])
                tar.addfile(info, io.BytesIO(row["content"]))
        return pa.table({"shard": [group.column(shard)[0].as_py()], "content": [out.getvalue()]}, schema=pa.schema([("shard", pa.int64()), ("content", pa.binary())]))

    slim = rows.select(F.col(key).cast("string"), "extension", "content", F.col(shard).cast("long"))
    return slim.groupBy(shard).applyInArrow(run, "shard long, content binary")


def media_shards(rows: DataFrame, number: Column, consistent: Column, shard_size: int) -> DataFrame:
    """The rows that hold together, each with the ``shard`` of at most ``shard_size`` rows that it goes to by its number."""
    return rows.where(consistent).withColumn("shard", F.floor(number / shard_size).cast("long"))


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, values): the tensors of safetensors files; kinds without a NumPy type are left null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from (pa.RecordBatch.from_pylist([{"path": name, **row}], schema=SCHEMA) for row in parsed(content))

    return binary_files(spark, path, "*.safetensors").mapInArrow(run, "path string, name string, dtype string, shape array<long>, values array<double>")


SCHEMA = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])


def parsed(content: bytes) -> Iterator[dict]:
    """The tensors of one file: an 8-byte length, a JSON header with places, and the data."""
    (size,) = struct.unpack("<Q", content[:8])
    for name, about in json.loads(content[8 : 8 + size]).items():
        if name == "__metadata__":
            continue
        begin, end = about["data_offsets"]
        raw = content[8 + size + begin : 8 + size + end]
        if about["dtype"] == "BF16":
            values = (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").astype(float).tolist()
        elif about["dtype"] in KINDS:
            values = np.frombuffer(raw, KINDS[about["dtype"]]).astype(float).tolist()
        else:
            values = None
        yield {"name": name, "dtype": about["dtype"], "shape": about["shape"], "values": values}


def serialised(held: dict[str, np.ndarray]) -> bytes:
    """Tensors of 32-bit floats as the bytes of one safetensors file."""
    header, data = {}, b""
    for name, values in held.items():
        raw = np.ascontiguousarray(values, "<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": list(values.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + data


def tensor_shards(rows: DataFrame, shard: str) -> DataFrame:
    """(shard, content): a safetensors file for each shard of (name, shape, values) rows."""

    def run(group: pa.Table) -> pa.Table:
        held = {r["name"]: np.array(r["values"], "<f4").reshape(r["shape"]) for r in sorted(group.to_pylist(), key=lambda r: r["name"])}
        return pa.table({"shard": [group.column(shard)[0].as_py()], "content": [serialised(held)]}, schema=pa.schema([("shard", pa.string()), ("content", pa.binary())]))

    return rows.select("name", "shape", "values", F.col(shard).cast("string")).groupBy(shard).applyInArrow(run, "shard string, content binary")
