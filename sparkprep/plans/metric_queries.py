"""Queries over metrics, aggregates, tensors and model costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions import models as C
from sparkprep.operators import metrics as M
from sparkprep.operators import tensors as X
from sparkprep.plans.registry import query, read


def r6(x: F.Column) -> F.Column:
    return F.round(x, 6)


@query("metric_masked_loss", "SELECT l_orderkey % 50 AS step, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS loss_sum, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::BIGINT AS tokens FROM lineitem GROUP BY 1")
def masked_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select((F.col("l_orderkey") % 50).alias("step"), "l_quantity", (F.col("l_returnflag") != "R").cast("int").alias("mask"))
    total, tokens = M.masked_loss(F.col("l_quantity"), F.col("mask"))
    return rows.groupBy("step").agg(total.alias("loss_sum"), tokens.alias("tokens"))


@query("metric_perplexity", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss, round(exp(least(20, sum(l_discount * l_quantity) / sum(l_quantity))), 6) AS perplexity FROM lineitem GROUP BY 1")
def perplexity(spark: SparkSession, folder: str) -> DataFrame:
    loss = F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")
    return read(spark, folder, "lineitem").groupBy("l_returnflag").agg(r6(loss).alias("loss"), r6(M.perplexity(loss)).alias("perplexity"))


@query(
    "metric_by_interval",
    "SELECT o_orderkey // 100 AS \"interval\", round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 4) AS mean_loss, sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END)::BIGINT AS advanced, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS skipped, CAST(0 AS BIGINT) AS nan_steps FROM orders GROUP BY 1",
)
def by_interval(spark: SparkSession, folder: str) -> DataFrame:
    found = M.by_interval(read(spark, folder, "orders"), F.col("o_orderkey"), 100, F.col("o_totalprice"), F.col("o_orderstatus") == "P")
    return found.withColumn("mean_loss", F.round("mean_loss", 4))


@query(
    "metric_throughput_window",
    """WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), p AS (SELECT user_id, event_id, t - lag(t, 4) OVER (PARTITION BY user_id ORDER BY event_id) AS passed FROM s)
    SELECT user_id, event_id, round(4 / passed, 9) AS batches_per_s, round(4 / passed * 8, 9) AS samples_per_s, round(4 / passed * 8 * 1024, 6) AS tokens_per_s, round(4 / passed * 8 * 1024 / 4, 6) AS tokens_per_s_rank FROM p WHERE passed > 0""",
)
def throughput_window(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    found = M.throughput_window(read(spark, folder, "events").select("user_id", "event_id", "ts"), "event_id", seconds, 5, 8, 1024, 4, "user_id")
    return found.select("user_id", "event_id", *(F.round(c, d).alias(c) for c, d in (("batches_per_s", 9), ("samples_per_s", 9), ("tokens_per_s", 6), ("tokens_per_s_rank", 6))))


@query(
    "metric_convergence",
    """WITH p AS (SELECT o_orderkey AS k, o_totalprice / 60000 AS b, o_totalprice / 60000 * (1 + (o_orderkey % 7 - 3) / 50.0) AS a FROM orders), t AS (SELECT corr(a, b) AS correlation, avg(CASE WHEN abs(a - b) / abs(b) > CASE WHEN b > 2 THEN 0.1 WHEN b > 0.5 THEN 0.05 ELSE 0.02 END THEN 1.0 ELSE 0.0 END) AS failed_share, avg(a - b) AS m, stddev_pop(a - b) AS deviation, arg_max(abs(a - b) / b, k) AS final_difference FROM p),
    o AS (SELECT avg(CASE WHEN abs(a - b - m) > 3 * deviation THEN 1.0 ELSE 0.0 END) AS outliers FROM p, t)
    SELECT round(correlation, 6) AS correlation, round(failed_share, 6) AS failed_share, round(final_difference, 6) AS final_difference, round(deviation, 6) AS deviation, round(outliers, 6) AS outliers, correlation >= 0.95 AND failed_share <= 0.1 AND final_difference <= 0.03 AND outliers <= 0.1 AS passed FROM t, o""",
)
def convergence(spark: SparkSession, folder: str) -> DataFrame:
    golden = F.col("o_totalprice") / 60000
    pairs = read(spark, folder, "orders").select("o_orderkey", golden.alias("b"), (golden * (1 + (F.col("o_orderkey") % 7 - 3) / 50.0)).alias("a"))
    found = M.convergence(pairs, "o_orderkey", "a", "b")
    return found.select(*(r6(F.col(c)).alias(c) for c in found.columns if c != "passed"), "passed")


@query("metric_norms", "SELECT label, round(sqrt(sum(v * v)), 4) AS norm FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY ROLLUP (label)")
def norms(spark: SparkSession, folder: str) -> DataFrame:
    values = read(spark, folder, "embeddings").select("label", F.explode("embedding").alias("v"))
    return M.norms(values, "label", F.col("v").cast("double")).select("label", F.round("norm", 4).alias("norm"))


@query("metric_regression", "WITH m AS (SELECT o_orderstatus AS run, avg(o_totalprice) AS v FROM orders WHERE o_orderkey >= 100 GROUP BY 1) SELECT run, round((v - (SELECT v FROM m WHERE run = 'O')) / (SELECT v FROM m WHERE run = 'O'), 6) AS difference, abs((v - (SELECT v FROM m WHERE run = 'O')) / (SELECT v FROM m WHERE run = 'O')) <= 0.05 AS passed FROM m")
def regression(spark: SparkSession, folder: str) -> DataFrame:
    means = read(spark, folder, "orders").where("o_orderkey >= 100").groupBy(F.col("o_orderstatus").alias("run")).agg(F.avg("o_totalprice").alias("v"))
    base = means.where("run = 'O'").first()["v"]  # one row
    difference = M.relative_difference(F.col("v"), F.lit(base))
    return means.select("run", r6(difference).alias("difference"), (F.abs(difference) <= 0.05).alias("passed"))


@query("metric_golden", "SELECT g.o_orderkey, g.o_totalprice AS golden, c.value AS current, c.value IS NULL AS missing FROM orders g LEFT JOIN (SELECT event_id AS o_orderkey, value FROM events) c ON c.o_orderkey = g.o_orderkey")
def golden(spark: SparkSession, folder: str) -> DataFrame:
    from sparkprep.operators.joins import against_golden

    current = read(spark, folder, "events").select(F.col("event_id").alias("o_orderkey"), F.col("value").alias("o_totalprice"))
    found = against_golden(read(spark, folder, "orders"), current, "o_orderkey", "o_totalprice")
    return found.select("o_orderkey", "golden", F.when(~F.isnan("current"), F.col("current")).alias("current"), F.isnan("current").alias("missing"))


@query("metric_log_values", "SELECT s_suppkey, 'loss' AS metric, CAST(s_suppkey AS DOUBLE) / 4 AS value FROM supplier UNION ALL SELECT s_suppkey, 'grad_norm', CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_suppkey % 2 = 0")
def log_values(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.lit("iteration 5 | lm loss: "), F.col("s_suppkey") / 4, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" | grad norm: "), "s_nationkey")).otherwise(F.lit("")))
    return M.log_values(read(spark, folder, "supplier").select("s_suppkey", line.alias("line")), "line", {"loss": r"lm loss: ([\d.]+)", "grad_norm": r"grad norm: ([\d.]+)"}).drop("nth")


@query(
    "metric_islands",
    """WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM events),
    g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m) SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, island""",
)
def islands(spark: SparkSession, folder: str) -> DataFrame:
    found = M.islands(read(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type"))
    return found.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("metric_rank_extents", "SELECT l_returnflag, max(l_quantity) AS largest, bool_and(l_quantity >= 1) AS all_ran, min(l_quantity) AS least, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1")
def rank_extents(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity")
    return M.rank_extents(read(spark, folder, "lineitem"), "l_returnflag", q, q >= 1)


@query("metric_encoded_max", "SELECT l_returnflag, max(CASE WHEN l_linenumber > 3 THEN l_suppkey END) AS largest FROM lineitem GROUP BY 1")
def encoded_max(spark: SparkSession, folder: str) -> DataFrame:
    reported = F.when(F.col("l_linenumber") > 3, F.col("l_suppkey")).otherwise(-1)
    return read(spark, folder, "lineitem").groupBy("l_returnflag").agg(M.encoded_max(reported).alias("largest"))


@query("metric_distinct_per_group", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, list_sort(list(DISTINCT c_mktsegment)) AS names, count(DISTINCT c_mktsegment) > 1 AS mixed FROM customer GROUP BY 1")
def distinct_per_group(spark: SparkSession, folder: str) -> DataFrame:
    n = F.count_distinct("c_mktsegment")
    return read(spark, folder, "customer").groupBy("c_nationkey").agg(n.alias("segments"), F.array_sort(F.collect_set("c_mktsegment")).alias("names"), (n > 1).alias("mixed"))


@query("metric_running_totals", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS steps FROM events")
def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, folder, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("total"), F.count(F.lit(1)).over(w).alias("steps"))


V = "WITH v AS (SELECT vec_id AS r, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(64)) AS c FROM embeddings) "


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as one matrix in long form."""
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


@query("tensor_column_shards", "WITH n AS (SELECT (count(*) + 3) // 4 AS each FROM embeddings) SELECT vec_id AS row, vec_id // each AS rank, vec_id % each AS own_row, vec_id AS back FROM embeddings, n")
def column_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    n = rows.count()
    rank, own = X.column_shard(F.col("vec_id"), n, 4)
    return rows.select(F.col("vec_id").alias("row"), rank.alias("rank"), own.alias("own_row"), X.unshard(rank, own, n, 4).alias("back"))


@query("tensor_row_shards", V + "SELECT r AS row, c // 16 AS rank, round(sum(value), 6) AS total FROM v GROUP BY 1, 2")
def row_shards(spark: SparkSession, folder: str) -> DataFrame:
    rank, _ = X.column_shard(F.col("col"), 64, 4)
    return matrix(spark, folder).groupBy("row", rank.alias("rank")).agg(r6(F.sum("value")).alias("total"))


@query(
    "tensor_qkv_interleave",
    """WITH q AS (SELECT 'q' AS part, unnest(range(64)) AS r), k AS (SELECT 'k' AS part, unnest(range(16)) AS r), w AS (SELECT 'v' AS part, unnest(range(16)) AS r), a AS (SELECT * FROM q UNION ALL SELECT * FROM k UNION ALL SELECT * FROM w)
    SELECT part, r AS own_row, CASE part WHEN 'q' THEN r // 32 * 48 + r % 32 WHEN 'k' THEN r // 8 * 48 + 32 + r % 8 ELSE r // 8 * 48 + 40 + r % 8 END AS place FROM a WHERE part = 'q' OR r < 16""",
)
def qkv_interleave(spark: SparkSession, folder: str) -> DataFrame:
    parts = [spark.range(0, n).select(F.lit(p).alias("part"), F.col("id").alias("own_row"), X.qkv_place(F.col("id"), 8, 2, 8, p).alias("place")) for p, n in (("q", 64), ("k", 16), ("v", 16))]
    placed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    part, own = X.qkv_part(F.col("place"), 8, 2, 8)
    return placed.where((part == F.col("part")) & (own == F.col("own_row")))


@query("tensor_gated_and_interleaved", "WITH r AS (SELECT unnest(range(64)) AS i) SELECT i, i // 16 * 32 + i % 16 AS gate, i // 16 * 32 + 16 + i % 16 AS up, i % 32 // 4 * 8 + i // 32 * 4 + i % 4 AS dealt, i // 8 * 16 + i % 8 AS key_place FROM r")
def gated(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("id")
    return spark.range(0, 64).select(i.alias("i"), X.gate_up_place(i, 64, 4, "gate").alias("gate"), X.gate_up_place(i, 64, 4, "up").alias("up"), X.interleave_place(i, 64, 4).alias("dealt"), X.kv_place(i, 8, "k").alias("key_place"))


@query(
    "tensor_int4_round_trip",
    "WITH s AS (SELECT vec_id, embedding, greatest(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 7, 1e-10) AS scale FROM embeddings) SELECT vec_id, round(scale, 9) AS scale, list_transform(embedding, lambda x: round(greatest(least(round_even(CAST(x AS DOUBLE) / scale, 0), 7), -8) * scale, 6) + 0.0) AS back FROM s",
)
def int4_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    packed = read(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("n"), X.int4_quantise(F.col("embedding")).alias("q"))
    return packed.select("vec_id", F.round("q.scale", 9).alias("scale"), F.transform(X.int4_dequantise(F.col("q.packed"), F.col("q.scale"), F.col("n")), lambda x: F.round(x, 6) + 0.0).alias("back"))


@query(
    "tensor_fp4_values",
    """WITH f AS (SELECT [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, -0.0, -0.5, -1.0, -1.5, -2.0, -3.0, -4.0, -6.0]::DOUBLE[] AS v), b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS bytes FROM embeddings)
    SELECT vec_id, list_transform(flatten(list_transform(bytes, lambda x: [v[x % 16 + 1], v[x // 16 + 1]])), lambda x: x * pow(2, vec_id % 5 - 2) + 0.0) AS value FROM b, f""",
)
def fp4_values(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of all values, made of the embeddings."""
    packed = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("long"))
    rows = read(spark, folder, "embeddings").select("vec_id", packed.alias("p"))
    return rows.select("vec_id", F.transform(X.fp4_dequantise(F.col("p"), F.col("vec_id") % 5 + 125), lambda x: x + 0.0).alias("value"))


@query("tensor_block_scale", V + "SELECT r AS row, c AS col, value * (1 + r // 128 + c // 32) AS value FROM v")
def block_scale(spark: SparkSession, folder: str) -> DataFrame:
    values = matrix(spark, folder).withColumns({"name": F.lit("w"), "row": F.col("row") * 1, "wide": F.col("col") * 4})
    held = values.select("name", F.floor(F.col("row") / 128).cast("long").alias("block_row"), F.floor(F.col("wide") / 128).cast("long").alias("block_col")).distinct()
    scales = held.withColumn("scale", 1 + F.col("block_row") + F.col("block_col"))
    found = X.block_dequantise(values.select("name", "row", F.col("wide").alias("col"), "value"), scales)
    return found.select("row", F.expr("col div 4").alias("col"), "value")


@query(
    "tensor_low_rank_merge",
    V + ", b AS (SELECT r, c, value FROM v WHERE c < 4), a AS (SELECT c AS r, r AS c, value FROM v WHERE r < 64 AND c < 4) SELECT v.r AS row, v.c AS col, round(v.value + 2.0 * sum(b.value * a.value), 6) + 0.0 AS value FROM v JOIN b ON b.r = v.r JOIN a ON a.r = b.c AND a.c = v.c GROUP BY v.r, v.c, v.value",
)
def low_rank_merge(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings as the base, with their first four columns and the transpose of 64 of those rows as the factors of rank 4."""
    m = matrix(spark, folder)
    b = m.where("col < 4")
    merged = X.low_rank_merged(m, b, b.where("row < 64").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), 8.0, 4)
    return merged.select("row", "col", (r6(F.col("value")) + 0.0).alias("value"))


@query("tensor_row_norms", V + "SELECT r AS row, round(sqrt(sum(value * value)), 6) AS norm FROM v GROUP BY r")
def row_norms(spark: SparkSession, folder: str) -> DataFrame:
    return X.row_norms(matrix(spark, folder)).select("row", r6(F.col("norm")).alias("norm"))


@query("tensor_stacked_experts", "SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS \"values\" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3")
def stacked(spark: SparkSession, folder: str) -> DataFrame:
    return X.stacked(read(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 3)


@query(
    "tensor_compared",
    "SELECT a.vec_id, round(CAST(list_max(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS DOUBLE), 6) AS max_difference, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def compared(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    found = X.compared(F.col("embedding"), F.col("other"))
    return vectors.join(other, "vec_id").select("vec_id", r6(found["max_difference"]).alias("max_difference"), r6(found["cosine"]).alias("cosine"))


CONFIG = """WITH c AS (SELECT s_suppkey AS id, CAST(24 + s_suppkey % 3 * 8 AS DOUBLE) AS layers, CAST(2048 AS DOUBLE) AS hidden, CAST(8192 AS DOUBLE) AS ffn, CAST(16 AS DOUBLE) AS heads, CAST(4 AS DOUBLE) AS groups, CAST(128 AS DOUBLE) AS head_dim,
CAST(1 AS DOUBLE) AS experts, s_suppkey % 2 = 0 AS gated, CAST(32000 AS DOUBLE) AS vocab, CAST(2 AS DOUBLE) AS tensor, CAST(1 + s_suppkey % 2 AS DOUBLE) AS pipeline, CAST(8 AS DOUBLE) AS data, CAST(4096 AS DOUBLE) AS seq, CAST(4 AS DOUBLE) AS batch FROM supplier) """


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    cells = {"layers": 24 + k % 3 * 8, "hidden": 2048, "ffn": 8192, "heads": 16, "groups": 4, "head_dim": 128, "experts": 1, "vocab": 32000, "tensor": 2, "pipeline": 1 + k % 2, "data": 8, "seq": 4096, "batch": 4, "micro": 1, "microbatches": 8}
    cols = [(v if isinstance(v, F.Column) else F.lit(v)).cast("double").alias(n) for n, v in cells.items()]
    return read(spark, folder, "supplier").select(k.alias("id"), *cols, (k % 2 == 0).alias("gated"), F.lit(False).alias("tied"), F.lit(True).alias("distributed"))


@query(
    "model_memory",
    CONFIG
    + """SELECT id, round(((2 * layers * hidden * hidden * ((1 + groups / heads) * head_dim * heads / hidden + ffn / hidden * experts * (CASE WHEN gated THEN 1.5 ELSE 1 END) + 2 / hidden + 1 / (layers * hidden)) / pipeline + hidden * vocab) / tensor
    + (CASE WHEN pipeline = 1 THEN hidden * vocab / tensor ELSE 0 END)) * (6 + 12 / data) / 1e6, 3) AS weight_mb,
    round((seq * hidden * (18 + 4 * ffn / hidden) * layers + 8 * seq * pipeline + seq * hidden * pipeline + (CASE WHEN pipeline = 1 THEN seq * hidden * 4 * (1 + vocab / hidden) ELSE 0 END)) / tensor / 1e6, 3) AS activation_mb FROM c""",
)
def model_memory(spark: SparkSession, folder: str) -> DataFrame:
    return configurations(spark, folder).select("id", F.round(C.weight_and_optimizer_bytes() / 1e6, 3).alias("weight_mb"), F.round(C.activation_bytes() / 1e6, 3).alias("activation_mb"))


@query(
    "model_flops",
    CONFIG
    + """SELECT id, round(3 * batch * seq * (layers * (2 * hidden * (2 * heads * head_dim + 2 * groups * head_dim) + 2 * heads * head_dim * seq + 2 * hidden * ffn * (CASE WHEN gated THEN 3 ELSE 2 END)) + 2 * hidden * vocab) / 1e12, 4) AS teraflops,
    round(((8 * hidden * hidden + 4 * hidden * 1024 + 4 * hidden * ffn) * 1024 * layers + 256 * (2 * (hidden * 4) * (hidden * 4) + 2 * hidden * 4 * 4096)) * batch * 3 / 1e12, 4) AS vision_teraflops FROM c""",
)
def model_flops(spark: SparkSession, folder: str) -> DataFrame:
    vision = configurations(spark, folder).withColumns({"patches": F.lit(1024.0), "merge": F.lit(2), "out_hidden": F.lit(4096.0)})
    return vision.select("id", F.round(C.transformer_flops() / 1e12, 4).alias("teraflops"), F.round(C.vision_flops() / 1e12, 4).alias("vision_teraflops"))


@query("model_vocabulary_divisor", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 128 = 0 THEN 128 WHEN o_orderkey % 64 = 0 THEN 64 WHEN o_orderkey % 32 = 0 THEN 32 WHEN o_orderkey % 16 = 0 THEN 16 WHEN o_orderkey % 8 = 0 THEN 8 WHEN o_orderkey % 4 = 0 THEN 4 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS divisor FROM orders")
def vocabulary_divisor(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select("o_orderkey", C.vocabulary_divisor(F.col("o_orderkey")).alias("divisor"))
