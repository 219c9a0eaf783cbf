"""Archives and tensor files: exact round trips."""

import numpy as np
import zstandard
from pyspark.sql import functions as F

from sparkprep.sources import archives as A


def test_zstd_lines(spark, tmp_path):
    text = "\n".join(f"line {i} é" for i in range(25_000)) + "\n"
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(text[:1000].encode()) + zstandard.compress(text[1000:].encode()))
    found = [r.line for r in A.zstd_lines(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(text.splitlines())


def test_tar_round_trip(spark, tmp_path):
    rows = [(f"s{i}", ext, f"{i}-{ext}".encode()) for i in range(9) for ext in ("txt", "json")]
    df = spark.createDataFrame(rows, "key string, extension string, content binary").withColumn("shard", F.substring("key", 2, 1).cast("long") % 2)
    for row in A.tar_shards(df, "key", "shard").collect():
        (tmp_path / f"{row.shard}.tar").write_bytes(bytes(row.content))
    members = A.tar_members(spark, str(tmp_path))
    assert sorted((r.key, r.extension, bytes(r.content)) for r in members.collect()) == sorted(rows)
    assert {r.key: {k: bytes(v) for k, v in r.parts.items()} for r in A.samples(members).collect()}["s3"] == {"txt": b"3-txt", "json": b"3-json"}


def test_tensor_files_round_trip(spark, tmp_path):
    held = {"a.w": np.arange(12, dtype="<f4").reshape(3, 4), "b": np.array([1.5, -2.0], "<f4")}
    rows = [(n, list(v.shape), v.ravel().tolist(), "one") for n, v in held.items()]
    df = spark.createDataFrame(rows, "name string, shape array<long>, values array<double>, file string")
    content = bytes(A.tensor_shards(df, "file").first().content)
    (tmp_path / "m.safetensors").write_bytes(content)
    found = {r.name: r for r in A.tensors(spark, str(tmp_path)).collect()}
    assert {n: (r.shape, r["values"]) for n, r in found.items()} == {n: (list(v.shape), v.ravel().tolist()) for n, v in held.items()}
