"""Queries over readers, writers, streams and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.operators import packing as P
from sparkprep.operators import sampling as S
from sparkprep.plans.registry import query, read
from sparkprep.sources import readers as R
from sparkprep.streaming import streams


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared one; where all runs in one process, as in tests, a local one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/sparkprep-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("source_text_lines", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(*) FILTER (line <> '#') AS lines, sum(length(line))::BIGINT AS chars FROM l")
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "lines")
    # A line behind the last one keeps documents that end in line ends from losing them at a file's end.
    docs = read(spark, folder, "documents").select(F.concat("text", F.lit("\n#")).alias("text"))
    docs.write.option("maxRecordsPerFile", 500).text(path)
    return R.text_lines(spark, path).where("line <> '#'").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("source_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "json")
    read(spark, folder, "conversations").write.json(path)
    return R.json_lines(spark, path, "conv_id long, turn long, role string, text string")


@query("source_json_records", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def json_records(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "records")
    rows = read(spark, folder, "supplier")
    held = rows.groupBy((F.col("s_suppkey") % 4).alias("k")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("x"))
    listed = F.to_json("x")
    held.select("k", F.when(F.col("k") == 0, listed).otherwise(F.concat(F.lit('{"records": '), listed, F.lit("}"))).alias("value")).write.partitionBy("k").text(path)
    return R.json_records(spark, path, "id bigint, name string")


@query("source_packed_rows", "SELECT count(*) AS sequences, sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM documents")
def packed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Packed documents written and read back with all rows checked."""
    path = scratch(spark, "packed") + "/rows.idx.parquet"
    words = F.transform(F.split("text", " ", -1), lambda x: F.length(x).cast("int"))
    rows = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), words.alias("input_ids"))
    rows = rows.withColumns({"loss_mask": F.transform("input_ids", lambda _: F.lit(1)), "length": F.size("input_ids").cast("long")})
    R.write_packed(P.fill(P.assign_bins(rows, 2048)), path)
    return R.checked(R.packed_rows(spark, path)).agg(F.sum(F.size("seq_start_id")).alias("sequences"), F.sum(F.size("input_ids")).alias("tokens"))


@query("source_split_folders", "SELECT CASE WHEN substr(md5(doc_id || '-1'), 1, 8) < printf('%08x', CAST(floor(0.9 * 4294967296) AS BIGINT)) THEN 'train' ELSE 'validation' END AS split, count(*) AS n FROM documents GROUP BY 1")
def split_folders(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "splits")
    rows = S.hash_split(read(spark, folder, "documents").select("doc_id", "lang"), F.col("doc_id"), {"train": 0.9, "validation": 0.1}, 1)
    R.write_splits(rows, path)
    return spark.read.json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("source_located_rows", "SELECT source, count(*) AS n, (sum(count(*)) OVER (ORDER BY source) - count(*))::BIGINT AS first, (sum(count(*)) OVER (ORDER BY source) - 1)::BIGINT AS last FROM documents GROUP BY source")
def located(spark: SparkSession, folder: str) -> DataFrame:
    return R.located(read(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n")


@query(
    "source_member_index",
    """WITH m AS (SELECT l_orderkey % 5 AS shard, l_orderkey AS k, l_orderkey * 10 + l_linenumber AS o FROM lineitem), g AS (SELECT shard, k AS key, min(o) AS "offset" FROM m GROUP BY 1, 2), e AS (SELECT shard, max(o + 7) AS e FROM m GROUP BY 1)
    SELECT g.shard, key, "offset", coalesce(lead("offset") OVER (PARTITION BY g.shard ORDER BY "offset"), e) - "offset" AS bytes FROM g JOIN e ON e.shard = g.shard""",
)
def member_index(spark: SparkSession, folder: str) -> DataFrame:
    members = read(spark, folder, "lineitem").select((F.col("l_orderkey") % 5).alias("shard"), F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return R.member_index(members, "shard", F.col("k"), "at", F.lit(7))


@query("source_file_savers", "WITH s AS (SELECT DISTINCT source FROM documents) SELECT source, (row_number() OVER (ORDER BY source) - 1) % 4 AS saver FROM s")
def file_savers(spark: SparkSession, folder: str) -> DataFrame:
    from sparkprep.operators.tensors import shard_files

    return shard_files(read(spark, folder, "documents").select("source").distinct(), "source", 4)


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = scratch(spark, "events")
    events.write.parquet(path)
    counts = streams.windowed_counts(streams.file_stream(spark, path), "ts", "event_type", "1 day", "40 days")
    found = streams.drained(f"counts_{uuid.uuid4().hex}", counts, checkpoint=scratch(spark, "state"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("stream_resumed", "SELECT event_id, user_id FROM events WHERE event_id >= 500")
def resumed(spark: SparkSession, folder: str) -> DataFrame:
    return streams.resumed(read(spark, folder, "events"), "event_id", 500).select("event_id", "user_id")


@query("stream_shuffled_batches", "SELECT event_id, md5(event_id || '-4') AS order_key FROM events")
def shuffled_batches(spark: SparkSession, folder: str) -> DataFrame:
    source, path = scratch(spark, "events"), scratch(spark, "shuffled")
    read(spark, folder, "events").select("event_id").repartition(4, "event_id").write.parquet(source)
    streams.shuffled_batches(streams.file_stream(spark, source, 2), "event_id", 4, path, scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(path).select("event_id", "order_key")


@query("job_fine_tuning_data", "SELECT conv_id, turn, 'user: ' || u || chr(10) || 'assistant: ' || a AS prompt, split FROM (SELECT x.conv_id, x.turn, x.text AS u, y.text AS a, CASE WHEN substr(md5(x.conv_id || '-2'), 1, 8) < printf('%08x', CAST(floor(0.95 * 4294967296) AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user' AND y.role = 'assistant' AND length(y.text) > 20)")
def fine_tuning_data(spark: SparkSession, folder: str) -> DataFrame:
    """Filter, pair, render and split conversations: a whole preparation job as one plan."""
    from sparkprep.functions.text import render
    from sparkprep.operators.records import user_assistant_pairs

    pairs = user_assistant_pairs(read(spark, folder, "conversations")).where(F.length("output") > 20)
    rows = pairs.select("conv_id", "turn", render("user: {input}\nassistant: {output}", {"input": F.col("input"), "output": F.col("output")}, "output").alias("prompt"))
    return S.hash_split(rows, F.col("conv_id"), {"train": 0.95, "test": 0.05}, 2)
