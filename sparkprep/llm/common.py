"""What the corpus operators share: table access and materialisation in the cluster's shared folder."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one process, as in tests, it is set to a local folder; elsewhere that is an error,
    as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/sparkprep-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once all that was made of it is written too."""
    for table in tables:
        spark = table.sparkSession
        folder = posixpath.dirname(table.inputFiles()[0])
        if f"{shared_dir(spark).removeprefix('file:').rstrip('/')}/" not in folder:
            raise ValueError(f"{folder} isn't an intermediate table")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(column: str = "text") -> F.Column:
    """A text as UTF-8 bytes, null as no bytes: what the Arrow functions read."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def arrow_rows(batches: Iterator[pa.RecordBatch], chunk: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``chunk`` bytes, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * chunk / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
