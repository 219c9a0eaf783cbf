"""Queries over whole dataset jobs and further tensor operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions import arrays as A
from sparkprep.operators import batches as B
from sparkprep.operators import builders, packing
from sparkprep.operators import records as R
from sparkprep.operators import tensors as X
from sparkprep.plans.array_queries import D, tokens
from sparkprep.plans.registry import query, read


@query(
    "job_tuning_data",
    """WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n, substr(md5(doc_id || '-6'), 1, 8) AS h FROM documents),
    s AS (SELECT n, CASE WHEN h < printf('%08x', CAST(floor(0.8 * 4294967296) AS BIGINT)) THEN 'train' WHEN h < printf('%08x', CAST(floor(0.9 * 4294967296) AS BIGINT)) THEN 'validation' ELSE 'test' END AS split FROM d) SELECT split, sum(n)::BIGINT AS tokens FROM s GROUP BY split""",
)
def job_tuning_data(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each split after the whole job: split, packed (but for the test split)."""
    rows = tokens(spark, folder).withColumn("input_ids", F.col("ids").cast("array<int>")).withColumn("loss_mask", F.transform("ids", lambda _: F.lit(1)))
    config = builders.TuningData(rows.select("id", "input_ids", "loss_mask"), None, None, {"train": 0.8, "validation": 0.1, "test": 0.1}, builders.PackingConfig(2048), 6)
    parts = builders.build(spark, config)
    first, *rest = (df.agg(F.sum(F.size("input_ids")).alias("tokens")).select(F.lit(name).alias("split"), "tokens") for name, df in parts.items())
    for df in rest:
        first = first.unionByName(df)
    return first


@query("sample_weighted_split", "SELECT o_orderkey, CASE WHEN substr(md5(o_orderkey || '-0'), 1, 8) < printf('%08x', CAST(floor(0.5 * 4294967296) AS BIGINT)) THEN 'train' WHEN substr(md5(o_orderkey || '-0'), 1, 8) < printf('%08x', CAST(floor(0.75 * 4294967296) AS BIGINT)) THEN 'validation' ELSE 'test' END AS split FROM orders")
def weighted_split(spark: SparkSession, folder: str) -> DataFrame:
    return builders.weighted_split(read(spark, folder, "orders").select("o_orderkey"), F.col("o_orderkey"), "2,1,1")


@query("pack_first_fit_shuffled")
def first_fit_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """First fit of all documents in shuffled order, by blocks: no SQL, as tests hold it against a plain loop."""
    rows = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.size(F.split("text", " ", -1)).cast("long").alias("length"))
    return packing.first_fit_shuffled(rows, 8192, seed=3)


@query(
    "record_infilled_segments",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
    h AS (SELECT doc_id, k, t, length(t) AS n, md5(doc_id || '-' || k || '-fim') AS h FROM l), c AS (SELECT *, CAST(('0x' || substr(h, 3, 8)) AS BIGINT) % (n + 1) AS x, CAST(('0x' || substr(h, 11, 8)) AS BIGINT) % (n + 1) AS y FROM h)
    SELECT doc_id, k AS segment, CASE WHEN substr(h, 1, 2) < '40' THEN '<pre><suf>' || substr(t, greatest(x, y) + 1) || '<mid>' || substr(t, 1, least(x, y)) || substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) ELSE t END AS text FROM c""",
)
def infilled_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a document permuted by itself, suffix first."""
    lines = read(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("segment", "line"))
    moved = R.fill_in_the_middle(F.col("line"), F.concat_ws("-", "doc_id", "segment"), "40", "spm")
    return lines.select("doc_id", F.col("segment").cast("long").alias("segment"), moved.alias("text"))


@query("tensor_head_major", "WITH r AS (SELECT unnest(range(48)) AS i) SELECT i, CASE WHEN i < 16 THEN i // 4 * 12 + i % 4 WHEN i < 32 THEN (i - 16) // 4 * 12 + 4 + (i - 16) % 4 ELSE (i - 32) // 4 * 12 + 8 + (i - 32) % 4 END AS place FROM r")
def head_major(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(48).select(F.col("id").alias("i"), X.head_major_place(F.col("id"), 4, [4, 4, 4]).alias("place"))


@query("tensor_component_shards", "WITH r AS (SELECT unnest(range(60)) AS i) SELECT i, CASE WHEN i < 32 THEN i // 8 WHEN i < 48 THEN (i - 32) // 4 ELSE (i - 48) // 3 END AS rank, CASE WHEN i < 32 THEN i % 8 WHEN i < 48 THEN 8 + (i - 32) % 4 ELSE 12 + (i - 48) % 3 END AS own_row FROM r")
def component_shards(spark: SparkSession, folder: str) -> DataFrame:
    rank, own = X.component_shard(F.col("id"), [32, 16, 12], 4)
    return spark.range(60).select(F.col("id").alias("i"), rank.alias("rank"), own.alias("own_row"))


@query("tensor_expert_names", "SELECT s_suppkey, t.n AS name, CAST(s_suppkey % 4 + s_suppkey % 3 * 4 AS BIGINT) AS expert FROM supplier, (SELECT unnest(['a.weight_max', 'a.input_max']) AS n) t")
def expert_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "supplier").select("s_suppkey", F.lit("a.max").alias("name"), X.global_expert(F.col("s_suppkey") % 4, F.col("s_suppkey") % 3, 4).alias("expert"))
    return X.fanned_out(rows, "name", ["weight_max", "input_max"])


@query("tensor_prefixed_adapters", "WITH n AS (SELECT 'l' || s_suppkey % 5 || '.lora_' || s_suppkey || '.w' AS name, s_suppkey % 5 AS p FROM supplier WHERE s_suppkey % 2 = 0) SELECT name, row_number() OVER (PARTITION BY p ORDER BY name) - 1 AS place, 'base.' || name AS full_name FROM n")
def prefixed_adapters(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 2 == 0, ".lora_").otherwise(".other_")
    names = read(spark, folder, "supplier").select(F.concat(F.lit("l"), F.col("s_suppkey") % 5, kind, "s_suppkey", F.lit(".w")).alias("name"))
    return X.prefixed_adapters(names, "name", "base.").select("name", "place", "full_name")


@query("tensor_shared_norm", "WITH h AS (SELECT l_orderkey, l_linenumber % 2 AS g, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT CAST(g AS BIGINT) AS \"group\", round(sqrt(sum(v * v)), 4) AS norm FROM h GROUP BY g")
def shared_norm(spark: SparkSession, folder: str) -> DataFrame:
    found = X.shared_norm(read(spark, folder, "lineitem"), "l_orderkey", (F.col("l_linenumber") % 2).cast("long"), F.col("l_quantity"))
    return found.select("group", F.round("norm", 4).alias("norm"))


@query("tensor_zero_centred", "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) - 1, 6)) AS stored, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS loaded FROM embeddings")
def zero_centred(spark: SparkSession, folder: str) -> DataFrame:
    stored = X.zero_centred(F.transform("embedding", lambda x: x.cast("double")))
    return read(spark, folder, "embeddings").select("vec_id", A.rounded(stored, 6).alias("stored"), A.rounded(X.from_zero_centred(stored), 6).alias("loaded"))


@query("metric_memory_regression", "SELECT l_returnflag, round((max(l_extendedprice) - 90000.0) / 90000.0, 6) AS difference, (max(l_extendedprice) - 90000.0) / 90000.0 <= 0.05 AS passed FROM lineitem GROUP BY 1")
def memory_regression(spark: SparkSession, folder: str) -> DataFrame:
    from sparkprep.operators.metrics import relative_difference

    difference = relative_difference(F.max("l_extendedprice"), F.lit(90000.0))
    return read(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.round(difference, 6).alias("difference"), (difference <= 0.05).alias("passed"))


@query("batch_unpadded", D + "SELECT id, ids[1:coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 2)), 0)] AS x FROM d")
def unpadded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the padding (2) that they end with."""
    return tokens(spark, folder).select("id", B.without_padding(F.col("ids"), 2).alias("x"))
