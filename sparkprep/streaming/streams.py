"""Streams: windowed counts with late data, batches that resume, and packing of arriving rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkprep.operators.packing import first_fit
from sparkprep.operators.sampling import keyed


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """(window_start, key, n): events for each tumbling window; those later than ``late`` are dropped by the watermark."""
    held = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return held.groupBy(F.window("at", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def resumed(rows: DataFrame, number: str, consumed: int) -> DataFrame:
    """Rows from the first that isn't consumed."""
    return rows.where(F.col(number) >= consumed)


def shuffled_batches(rows: DataFrame, key: str, seed: int, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch in a keyed order: a shuffle buffer as large as the batch. Writes Parquet, sorted, with batch and order columns."""

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumns({"batch": F.lit(number).cast("long"), "order_key": keyed(F.col(key), seed)})
        marked.sort("order_key", key).write.mode("overwrite").parquet(f"{path}/part={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def packed_buffers(rows: DataFrame, group: str, key: str, length: str, capacity: int) -> DataFrame:
    """(group, buffer, bin, ids, total): first fit decreasing over the rows of each (group, buffer)."""

    def pack(table: pa.Table) -> pa.Table:
        waiting: dict[int, list[int]] = {}
        for k, n in sorted(zip(table.column(key).to_pylist(), table.column(length).to_pylist())):
            waiting.setdefault(n, []).append(k)
        bins = first_fit(sorted((n for n, ks in waiting.items() for _ in ks), reverse=True), capacity)
        ids = [[waiting[n].pop(0) for n in held] for held in bins]
        name, buffer = table.column(group)[0].as_py(), table.column("buffer")[0].as_py()
        schema = pa.schema([table.schema.field(group), ("buffer", pa.int64()), ("bin", pa.int64()), ("ids", pa.list_(pa.int64())), ("total", pa.int64())])
        return pa.Table.from_pydict({group: [name] * len(bins), "buffer": [buffer] * len(bins), "bin": list(range(len(bins))), "ids": ids, "total": [sum(x) for x in bins]}, schema)

    slim = rows.select(group, F.col("buffer").cast("long"), F.col(key).cast("long"), F.col(length).cast("long"))
    return slim.groupBy(group, "buffer").applyInArrow(pack, f"{group} {dict(rows.dtypes)[group]}, buffer long, bin long, ids array<long>, total long")


def packed_stream(rows: DataFrame, group: str, key: str, length: str, capacity: int, buffered: int, path: str, checkpoint: str) -> StreamingQuery:
    """Packs arriving rows by buffers of ``buffered`` rows of a group; ``packed_rows`` reads the bins, those of the tail too.

    A batch packs the buffers that it fills into path/bins and hands the rows left to the next one by path/waiting. Both lie
    under the batch's number, so a batch that runs again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(group, F.col(key).cast("long").alias(key), F.col(length).cast("long").alias(length), F.lit(number).cast("long").alias("arrived"))
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/waiting/batch={number - 1}"))
        w = Window.partitionBy(group)
        placed = rows.withColumns({"nth": F.row_number().over(w.orderBy("arrived", key)) - 1, "n_rows": F.count(F.lit(1)).over(w)})
        marked = placed.withColumn("buffer", F.expr(f"nth div {buffered}")).withColumn("full", (F.col("buffer") + 1) * buffered <= F.col("n_rows"))
        packed_buffers(marked.where("full"), group, key, length, capacity).write.mode("overwrite").parquet(f"{path}/bins/batch={number}")
        marked.where("not full").select(rows.columns).write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def packed_rows(spark: SparkSession, group: str, key: str, length: str, capacity: int, path: str) -> DataFrame:
    """(group, batch, buffer, bin, ids, total) of a stream that has ended: all full buffers, and its tail as batch -1."""
    bins = spark.read.parquet(f"{path}/bins").withColumn("batch", F.col("batch").cast("long"))
    # The last batch may have left no rows, so its number comes from the files.
    number = max(int(re.search(r"batch=(\d+)", f)[1]) for f in spark.read.parquet(f"{path}/waiting").inputFiles())
    last = spark.read.parquet(f"{path}/waiting/batch={number}")
    tail = packed_buffers(last.withColumn("buffer", F.lit(0).cast("long")), group, key, length, capacity).withColumn("batch", F.lit(-1).cast("long"))
    return bins.unionByName(tail)


def drained(query_name: str, rows: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that a stream has to give now, as a table in memory: for results of bounded size, such as counts by window."""
    writer = rows.writeStream.format("memory").queryName(query_name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return rows.sparkSession.table(query_name)
