"""Queries over loaders, sample mappings, further array, media, metric and tensor operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions import arrays as A
from sparkprep.functions import media as M
from sparkprep.operators import loaders as L
from sparkprep.operators import metrics as Q
from sparkprep.operators import sampling as S
from sparkprep.operators import tensors as X
from sparkprep.plans.array_queries import D, tokens
from sparkprep.plans.registry import query, read
from sparkprep.plans.sampling_queries import N, rows_of
from sparkprep.sources import states


@query(
    "sample_random_unsharded",
    f"""WITH c AS (SELECT {N} // 4 * 4 AS n), r AS (SELECT n, unnest(range(n)) AS idx FROM c), p AS (SELECT n, idx, row_number() OVER (ORDER BY md5(idx || '-0'), idx) - 1 - 64 AS k FROM r),
    d AS (SELECT idx, k % 8 AS rank, k // 8 AS nth, (n - 64 - k % 8 + 7) // 8 AS held FROM p WHERE k >= 0) SELECT idx, rank, nth FROM d WHERE nth < held // 4 * 4""",
)
def random_unsharded(spark: SparkSession, folder: str) -> DataFrame:
    return S.random_unsharded(spark, rows_of(spark, folder), 64, 4, 8)


MAPPING = f"""WITH c AS (SELECT {N} AS size, 2 * {N} + 37 AS number), b AS (SELECT unnest(range((number + 127) // 128)) AS block, number FROM c), o AS (SELECT block, number, row_number() OVER (ORDER BY md5(block || '-3'), block) - 1 AS nth FROM b),
l AS (SELECT nth AS last FROM o WHERE block = (number + 127) // 128 - 1), s AS (SELECT block, nth, nth * 128 - CASE WHEN nth > last AND number % 128 > 0 THEN 128 - number % 128 ELSE 0 END AS begins FROM o, l),
r AS (SELECT size, unnest(range(number)) AS id FROM c), m AS (SELECT begins + row_number() OVER (PARTITION BY s.block ORDER BY md5(id || '-' || (nth + 3)), id) - 1 AS "position", id % size AS sample FROM r JOIN s ON s.block = id // 128) """


@query("sample_block_mapping", MAPPING + 'SELECT "position", sample FROM m')
def block_mapping(spark: SparkSession, folder: str) -> DataFrame:
    n = rows_of(spark, folder)
    return S.block_mapping(spark, n, 2 * n + 37, 128, 3)


@query("sample_mapping_slice", MAPPING + 'SELECT "position", sample, ((SELECT number - 2 FROM c) - "position") // 5 AS nth FROM m WHERE "position" <= (SELECT number - 2 FROM c) AND "position" > 10 AND ((SELECT number - 2 FROM c) - "position") % 5 = 0')
def mapping_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth sample from the last but one down to the twelfth."""
    n = rows_of(spark, folder)
    return S.positions(S.block_mapping(spark, n, 2 * n + 37, 128, 3), 2 * n + 37, -2, 10, -5)


@query("sample_offline_map", f"WITH r AS (SELECT unnest(range({N} + {N} // 3)) AS id) SELECT row_number() OVER (ORDER BY md5(id || '-9'), id) - 1 AS \"position\", id % {N} AS sample, id // {N} AS epoch FROM r")
def offline_map(spark: SparkSession, folder: str) -> DataFrame:
    n = rows_of(spark, folder)
    return S.offline_map(spark, n, 9, most=n + n // 3)


@query(
    "loader_cyclic",
    f"""WITH c AS (SELECT {N} // 32 * 4 AS bucket), r AS (SELECT bucket, unnest(range(bucket * 8)) AS idx FROM c), p AS (SELECT bucket, idx, idx // bucket AS rank, row_number() OVER (PARTITION BY idx // bucket ORDER BY md5(idx || '-0'), idx) - 1 AS k FROM r)
    SELECT e AS pass, idx, k // 4 + e * (bucket // 4) AS step, rank, k % 4 AS slot FROM p, range(2) t(e)""",
)
def cyclic(spark: SparkSession, folder: str) -> DataFrame:
    """Two passes of a loader in keyed order."""
    plan = L.loader(spark, "cyclic", rows_of(spark, folder), 0, 4, 8)
    return L.repeated(plan, 2).select(F.col("pass").cast("long").alias("pass"), "idx", "step", "rank", "slot")


@query(
    "loader_splits",
    "SELECT 'train' AS split, (SELECT count(*) FROM orders) // 64 * 64 AS samples, (SELECT count(*) FROM orders) // 64 * 2 AS steps UNION ALL SELECT 'validation', (SELECT count(*) FROM supplier) // 4 * 4, (SELECT count(*) FROM supplier) // 4 WHERE false",
)
def splits(spark: SparkSession, folder: str) -> DataFrame:
    """The plan of the training split by global batches; validation isn't run."""
    training = L.Training(iterations=10, global_batch=64, micro=8, ranks=4, kind="batch")
    plans = L.split_loaders(spark, training, {"train": rows_of(spark, folder), "validation": 10})
    out = [p.agg(F.count(F.lit(1)).alias("samples"), (F.max("step") + 1).alias("steps")).select(F.lit(n).alias("split"), "samples", "steps") for n, p in plans.items() if p is not None]
    return out[0]


@query("loader_due", "SELECT event_id, event_id > 0 AND event_id % 7 = 0 AS due FROM events")
def due(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", L.due(F.col("event_id"), 7).alias("due"))


@query("loader_tolerant", "SELECT event_id, TRY_CAST(substr(event_type, 1, 1) || event_id % 3 AS BIGINT) AS value, TRY_CAST(substr(event_type, 1, 1) || event_id % 3 AS BIGINT) IS NULL AS failed FROM events")
def tolerant(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").select("event_id", F.concat(F.substring("event_type", 1, 1), F.col("event_id") % 3).alias("text"))
    return L.tolerant(rows, F.expr("try_cast(text as bigint)")).drop("text")


@query(
    "array_sequence_counts",
    D + "SELECT id, [len(ids) // 3 - 1, len(ids) - len(ids) // 3 - 1]::BIGINT[] AS counts, (len(ids) - 2)::BIGINT AS tokens, list_concat(ids[1:len(ids) // 3 - 1], ids[len(ids) // 3 + 1:len(ids) - 1]) AS kept FROM d WHERE len(ids) >= 6",
)
def sequence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of six words at least as two sequences: counts without end tokens, and masks (here the tokens themselves)."""
    third = F.floor(F.size("ids") / 3)
    rows = tokens(spark, folder).where(F.size("ids") >= 6)
    counts, whole = A.sequence_counts(F.array(F.lit(0).cast("long"), third), F.size("ids"))
    kept = A.segment_masks(F.col("ids"), F.col("ids"), F.array(F.lit(0).cast("long"), third, F.size("ids").cast("long")))
    return rows.select("id", counts.alias("counts"), whole.alias("tokens"), kept.alias("kept"))


@query("array_positions_padded", D + "SELECT id, CASE WHEN len(ids) < 64 THEN list_concat(ids, range(len(ids), 64)) WHEN len(ids) > 100 THEN ids[1:100] ELSE ids END AS positions, CAST(ceil(len(ids) / 48.0) * 48 AS BIGINT) AS uniform FROM d")
def positions_padded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).select("id", A.pad_or_cut_positions(F.col("ids"), 64, 100).alias("positions"), A.uniform_size(F.size("ids"), 3, 2, True).alias("uniform"))


@query("array_segment_zigzag", D + ", s AS (SELECT id, len(ids) AS n, len(ids) // 3 AS t, len(ids) // 3 // 4 AS a, (len(ids) - len(ids) // 3) // 4 AS b FROM d) SELECT id, list_concat(list_concat(range(a, 2 * a), range(2 * a, 3 * a)), list_concat(range(t + b, t + 2 * b), range(t + 2 * b, t + 3 * b))) AS places FROM s")
def segment_zigzag(spark: SparkSession, folder: str) -> DataFrame:
    third = F.floor(F.size("ids") / 3)
    return tokens(spark, folder).select("id", A.segment_zigzag(F.array(F.lit(0).cast("long"), third, F.size("ids").cast("long")), 1, 2).alias("places"))


@query("array_find_from", D + "SELECT id, coalesce((SELECT min(p) FROM unnest(range(1, len(ids))) t(p) WHERE p > 5 AND ids[p] = 2 AND ids[p + 1] = 4) - 1, -1)::BIGINT AS begins, coalesce((SELECT min(p) FROM unnest(range(1, len(ids))) t(p) WHERE p > 5 AND ids[p] = 2 AND ids[p + 1] = 4) + 1, -1)::BIGINT AS ends FROM d")
def find_from(spark: SparkSession, folder: str) -> DataFrame:
    found = A.find_array_from(F.array(F.lit(2).cast("long"), F.lit(4).cast("long")), F.col("ids"), F.lit(5))
    return tokens(spark, folder).select("id", found.alias("f")).select("id", F.col("f.begin").alias("begins"), F.col("f.end").alias("ends"))


U = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "media_noise_levels",
    f"WITH u AS (SELECT p_partkey, {U.format(chr(39).join(['p_partkey || ', '-5', '']))} AS u FROM part), m AS (SELECT p_partkey, least(greatest(1 - u - 1.29 * (pow(cos(pi() * u / 2), 2) - 1 + u), 0), 1) AS v FROM u) SELECT p_partkey, round(least(greatest(3 / (3 + 1 / greatest(v, 1e-5) - 1), 0.01), 0.99), 6) AS sigma, round(least(greatest(3 / (3 + 1 / greatest(v, 1e-5) - 1), 0.01), 0.99) * 1000, 3) AS step FROM m",
)
def noise_levels(spark: SparkSession, folder: str) -> DataFrame:
    sigma, step = M.noise_level("mode", F.col("p_partkey"), 5, 3.0, 0.01, 0.99)
    return read(spark, folder, "part").select("p_partkey", F.round(sigma, 6).alias("sigma"), F.round(step, 3).alias("step"))


@query(
    "media_masked_at_random",
    D
    + f""", t AS (SELECT id, ids, 0.999 * ({U.format("id || '-2-t'")}) + 0.001 AS c FROM d), e AS (SELECT id, c, unnest(ids) AS x, unnest(range(len(ids))) AS i FROM t),
    m AS (SELECT id, c, i, x, {U.format("id || '-2-' || i")} < c AND x <> 3 AS hit FROM e)
    SELECT id, list(CASE WHEN hit THEN -1 ELSE x END ORDER BY i) AS input_ids, round(any_value(c), 9) AS chance FROM m GROUP BY id""",
)
def masked_at_random(spark: SparkSession, folder: str) -> DataFrame:
    made = M.masked_at_random(F.col("ids"), F.col("id"), -1, F.transform("ids", lambda x: (x != 3).cast("int")), seed=2)
    return tokens(spark, folder).select("id", made["input_ids"].alias("input_ids"), F.round(made["chance"], 9).alias("chance"))


@query(
    "media_truncation_repaired",
    D
    + """, r AS (SELECT id, ids, list_concat(list_concat(ids, [-9, -9, -9]::BIGINT[]), list_concat([CAST(1 AS BIGINT)], [-9, -9]::BIGINT[])) AS x, len(ids) AS n FROM d)
    SELECT id, list_transform(x[1:100], lambda v, i: CASE WHEN v = -9 AND ((i > n AND i <= n + 3 AND n + 3 > 100) OR (i > n + 4 AND n + 6 > 100)) THEN 0 ELSE v END) AS input_ids, CASE WHEN n + 6 <= 100 THEN 2 WHEN n + 3 <= 100 THEN 1 ELSE 0 END::BIGINT AS complete FROM r""",
)
def truncation_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of media tokens behind each document, all cut to 100 tokens."""
    run = lambda n: F.array_repeat(F.lit(-9).cast("long"), n)
    rows = tokens(spark, folder).select("id", F.concat("ids", run(3), F.array(F.lit(1).cast("long")), run(2)).alias("x"))
    found = M.truncation_repaired(F.col("x"), F.col("x"), F.col("x"), -9, 100, 0)
    return rows.select("id", found["input_ids"].alias("input_ids"), found["complete"].alias("complete"))


@query("media_placed", "SELECT s_suppkey, ['text:a', 'image:i0', 'text:b ', 'video:v0', 'text:c'] AS parts FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, ['text:a', 'image:i0', 'text:b ', 'text:c'] FROM supplier WHERE s_suppkey % 2 = 1")
def placed(spark: SparkSession, folder: str) -> DataFrame:
    """A text with two image marks and one image, and a video mark whose video every second supplier has."""
    videos = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("v0"))).otherwise(F.array().cast("array<string>"))
    found = M.placed_media(F.lit("a<image>b <video><image>c"), F.array(F.lit("i0")), videos)
    return read(spark, folder, "supplier").select("s_suppkey", F.transform(found, lambda p: F.concat_ws(":", p["type"], p["value"])).alias("parts"))


@query("media_decoder_kinds", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'raw' END AS kind FROM nation")
def decoder_kinds(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat("n_name", F.element_at(F.array(*map(F.lit, [".a.JPG", ".mp4", ".wav", ".json"])), (F.col("n_nationkey") % 4 + 1).cast("int")))
    return read(spark, folder, "nation").select("n_nationkey", M.decoder_kind(name).alias("kind"))


@query("metric_steady_regression", "WITH s AS (SELECT o_totalprice AS a, o_totalprice * (1 + o_orderkey % 3 / 100.0) AS b, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders), m AS (SELECT avg(b) AS now, avg(a) AS golden FROM s WHERE n >= (SELECT greatest(1, count(*) // 10) FROM s)) SELECT round((now - golden) / golden, 6) AS difference, abs((now - golden) / golden) <= 0.05 AS passed FROM m")
def steady_regression(spark: SparkSession, folder: str) -> DataFrame:
    series = read(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("golden"), (F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3 / 100.0)).alias("now"))
    return Q.regression(series, "o_orderkey", "now", "golden").select(F.round("difference", 6).alias("difference"), "passed")


@query(
    "metric_packed_averages",
    D
    + """, k AS (SELECT id, len(ids) AS n, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS total FROM d), h AS (SELECT n, n // 3 - 1 AS a, n - n // 3 - 1 AS b FROM k WHERE r <= total // 16 * 16)
    SELECT 2.0::DOUBLE AS sequences_per_row, round(avg(n - 2), 6) AS tokens_per_row, round(sum(a * a + b * b) / (2.0 * count(*)), 4) AS squared_length, round(sum(a * a + b * b) / count(*), 4) AS squares_per_row FROM h""",
)
def packed_averages(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens(spark, folder).withColumn("starts", F.array(F.lit(0).cast("long"), F.floor(F.size("ids") / 3)))
    found = Q.packed_averages(rows, "starts", F.size("ids"), "id", 16)
    return found.select(*(F.round(c, d).alias(c) for c, d in (("sequences_per_row", 6), ("tokens_per_row", 6), ("squared_length", 4), ("squares_per_row", 4))))


@query("metric_adapter_ranks", "SELECT l_orderkey % 400 AS target, CAST(l_orderkey % 400 % 3 * 8 AS BIGINT) AS rank FROM lineitem WHERE l_orderkey % 400 % 3 <> 1 GROUP BY 1, 2")
def adapter_ranks(spark: SparkSession, folder: str) -> DataFrame:
    target = F.col("l_orderkey") % 400
    return Q.adapter_facts(read(spark, folder, "lineitem").select(target.alias("target"), (target % 3 * 8).alias("rank")), "target", "rank", 8)


@query("metric_log_series", "SELECT event_id - 1 AS step, round(value, 2) AS value FROM (SELECT event_id, CAST(event_id % 100 AS DOUBLE) / 4 AS value FROM events)")
def log_series(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.lit(" iteration "), F.col("event_id"), F.lit("/ 99 | lm loss: "), (F.col("event_id") % 100 / 4), F.lit(" | grad norm: nan"))
    found = Q.log_series(read(spark, folder, "events").select("event_id", line.alias("line")), "event_id", "line", "lm loss")
    return found.select("step", F.round("value", 2).alias("value"))


@query("tensor_gated_qkv", "SELECT 'q' AS part, i AS own_row, i // 32 * 80 + i % 32 AS place FROM range(64) t(i) UNION ALL SELECT 'g', i, i // 32 * 80 + 32 + i % 32 FROM range(64) t(i) UNION ALL SELECT 'k', i, i // 8 * 80 + 64 + i % 8 FROM range(16) t(i) UNION ALL SELECT 'v', i, i // 8 * 80 + 72 + i % 8 FROM range(16) t(i)")
def gated_qkv(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for part, n in (("q", 64), ("g", 64), ("k", 16), ("v", 16)):
        one = spark.range(n).select(F.lit(part).alias("part"), F.col("id").alias("own_row"), X.gated_qkv_place(F.col("id"), 8, 2, 8, part).alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


@query("tensor_cut_kinds", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'column' WHEN 1 THEN 'row' ELSE 'replicated' END AS kind, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey % 8 // 2 WHEN 1 THEN s_suppkey % 4 END AS rank FROM supplier")
def cut_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kind = X.cut_kind(F.element_at(F.array(*map(F.lit, ["ColumnParallelLinear", "FastRowParallelLinear", "RMSNorm"])), (F.col("s_suppkey") % 3 + 1).cast("int")))
    rows = read(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), kind.alias("kind"))
    return rows.select("s_suppkey", "kind", X.cut_place(F.col("kind"), F.col("s_suppkey") % 8, F.col("s_suppkey") % 4, 8, 4, 4).alias("rank"))


@query("tensor_unstacked_experts", "SELECT vec_id, unnest(range(64)) AS \"index\", CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def unstacked(spark: SparkSession, folder: str) -> DataFrame:
    return X.unstacked(read(spark, folder, "embeddings"), "vec_id", "embedding").select("vec_id", "index", F.col("value").cast("double").alias("value"))


@query("sort_layer_names", "SELECT 'm.layers.' || p_size || '.experts.weight' || p_partkey AS name, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place FROM part")
def layer_names(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("m.layers."), "p_size", F.lit(".experts.weight"), "p_partkey")
    names = read(spark, folder, "part").select(name.alias("name")).unionByName(spark.createDataFrame([("output_layer.weight",)], "name string"))
    return states.natural_order(states.without_tied_output(names, True))


@query("sample_repeat_shuffled", "WITH c AS (SELECT count(*) AS n FROM supplier), p AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5(s_suppkey || '-42'), s_suppkey) - 1 AS r, n FROM supplier, c) SELECT s_suppkey, r + e * n AS \"position\" FROM p, range(3) t(e) WHERE r + e * n < 2 * n + 3")
def repeat_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    n = rows_of(spark, folder, "supplier")
    return S.repeat_shuffled(read(spark, folder, "supplier").select("s_suppkey"), "s_suppkey", n, 2 * n + 3)


@query("metric_remaining", "SELECT event_id, CASE WHEN event_id > 0 THEN round(event_id * 2.5 / (event_id / 200000.0) * (1 - event_id / 200000.0), 4) END AS seconds FROM events")
def remaining(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", F.round(Q.remaining(F.col("event_id") * 2.5, F.col("event_id") / 200000.0), 4).alias("seconds"))


@query(
    "metric_throughputs",
    """WITH s AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS t FROM events), w AS (SELECT *, t - lag(t) OVER q AS passed, t - first_value(t) OVER q AS since, sum(value) OVER q - first_value(value) OVER q AS done FROM s WINDOW q AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, CASE WHEN passed > 0 THEN round(value / passed, 9) END AS job, CASE WHEN since > 0 THEN round(done / since, 9) END AS cumulative FROM w""",
)
def throughputs(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").select("user_id", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    found = Q.throughputs(rows, "user_id", "event_id", F.col("value"), F.col("t"))
    return found.select("user_id", "event_id", F.round("job", 9).alias("job"), F.round("cumulative", 9).alias("cumulative"))


@query(
    "metric_loss_flags",
    "WITH s AS (SELECT event_id, value, max(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS largest FROM events) SELECT event_id, false AS is_bad, coalesce(value > 1.5 * largest, false) AS is_spike FROM s",
)
def loss_flags(spark: SparkSession, folder: str) -> DataFrame:
    return Q.loss_flags(read(spark, folder, "events").select("event_id", "value"), "event_id", "value", 1.5).select("event_id", "is_bad", "is_spike")


@query(
    "metric_whole_norm",
    """WITH h AS (SELECT CASE WHEN l_linenumber = 1 THEN 'expert' ELSE 'dense' END AS g, l_orderkey, CASE WHEN l_linenumber = 1 THEN l_suppkey END AS r, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
    SELECT g AS "group", sum(v * v) AS squares, round(sqrt(sum(v * v)), 4) AS norm FROM h GROUP BY ROLLUP (g)""",
)
def whole_norm(spark: SparkSession, folder: str) -> DataFrame:
    found = Q.whole_norm(read(spark, folder, "lineitem"), "l_orderkey", F.col("l_quantity"), F.col("l_linenumber") == 1, "l_suppkey")
    return found.select("group", "squares", F.round("norm", 4).alias("norm"))


@query(
    "model_hybrid_flops",
    """WITH c AS (SELECT s_suppkey AS id, 2048.0::DOUBLE AS h, 4096.0::DOUBLE AS s, 4.0 * 4096 AS t, s_suppkey % 3 AS k FROM supplier)
    SELECT id, round(3 * (4 * (4 * t * h * (128.0 * 16 / h) * (h + h * (4.0 / 16) + s / 2)) + 2 * (4 * 4.0 * 1.5 * t * h * h) + 3 * (2 * t * h * (2 * (2 * h) + 2 * 8 * 128 + 64) + 7 * t * (2 * h) * 128 + 2 * t * (2 * h) * h)
    + 2 * (4 * t * (CASE WHEN k = 0 THEN 512 ELSE h END) * 1024 * 6 * 1.5 + CASE WHEN k = 0 THEN 4 * t * h * 512 ELSE 0 END + 4 * t * h * 2048 * 1.5)
    + 1 * (2 * t * (h * (2 * 2048 + 2 * 4096 + 2 * 32) + 4 * (2 * 2048 + 4096) + 32 * 128 * 128 * 4 + h * 4096)) + 2 * t * h * 32000 * (1 + k)) / 1e12, 4) AS teraflops FROM c""",
)
def hybrid_flops(spark: SparkSession, folder: str) -> DataFrame:
    """Models of four attention layers, two MLPs, three state-space, two expert and one delta layer."""
    from sparkprep.functions import models

    k = F.col("s_suppkey") % 3
    cells = {"hidden": 2048, "seq": 4096, "batch": 4, "heads": 16, "groups": 4, "head_dim": 128, "expansion": 4, "vocab": 32000, "expert_ffn": 1024, "shared_ffn": 2048, "topk": 6, "ssm_heads": 64, "ssm_head_dim": 64, "ssm_groups": 8, "ssm_state": 128,
             "delta_qk_dim": 128, "delta_v_dim": 128, "delta_qk_heads": 16, "delta_v_heads": 32, "delta_conv": 4}
    rows = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), *(F.lit(float(v)).alias(n) for n, v in cells.items()), F.lit(True).alias("gated"), k.alias("predicted"), F.when(k == 0, F.lit(512.0)).alias("latent"))
    return rows.select("id", F.round(models.hybrid_flops(F.lit("M*-*EM*-*EMG")) / 1e12, 4).alias("teraflops"))


@query("join_rules_of_many", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS rule, CASE s_suppkey % 3 WHEN 0 THEN 'p.' || s_suppkey WHEN 1 THEN 'p.' || s_suppkey ELSE 'r.c/' || s_suppkey END AS target FROM supplier")
def rules_of_many(spark: SparkSession, folder: str) -> DataFrame:
    from sparkprep.operators.joins import first_rule_of_many

    name = F.concat(F.element_at(F.array(*map(F.lit, ["a.", "b.", "c/"])), (F.col("s_suppkey") % 3 + 1).cast("int")), "s_suppkey")
    rule, target = first_rule_of_many(name, [(["a.*", "b.*"], "p.*"), (["**"], "r.**")])
    return read(spark, folder, "supplier").select("s_suppkey", rule.alias("rule"), target.alias("target"))


@query("example_included_modules", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'fc1' WHEN 1 THEN '*.mlp.*' END AS pattern, CASE p_partkey % 3 WHEN 0 THEN 'l.' || p_size || '.fc1' WHEN 1 THEN 'l.' || p_size || '.mlp.fc2' END AS full_name FROM part")
def included_modules(spark: SparkSession, folder: str) -> DataFrame:
    from sparkprep.operators.examples import included_module

    k = F.col("p_partkey") % 3
    name, prefix = F.when(k == 0, "fc1").when(k == 1, "fc2").otherwise("norm"), F.concat(F.lit("l."), "p_size", F.when(k == 1, ".mlp").otherwise(""))
    found = included_module(name, prefix, ["fc1", "*.mlp.*"])
    return read(spark, folder, "part").select("p_partkey", found["pattern"].alias("pattern"), found["full_name"].alias("full_name"))


@query(
    "example_masks_of_variants",
    D
    + """, a AS (SELECT id, ids, len(ids) AS n, ids[3:5] AS x FROM d), f AS (SELECT *, CASE WHEN len(x) > 0 THEN (SELECT min(p) FROM unnest(range(1, n - len(x) + 2)) t(p) WHERE ids[p:p + len(x) - 1] = x) END AS p1 FROM a)
    SELECT id, list_transform(range(1, n + 1), lambda i: CAST(coalesce(i BETWEEN p1 AND p1 + len(x) - 1, false) AND ids[i] <> 2 AS BIGINT)) AS mask FROM f""",
)
def masks_of_variants(spark: SparkSession, folder: str) -> DataFrame:
    """A piece of each document whose first way isn't there, looked for by its second; twos are skipped."""
    from sparkprep.operators.examples import searched_mask_of_variants

    piece = F.slice("ids", 3, 3)
    ways = F.array(F.array(F.concat(piece, F.array(F.lit(-5).cast("long"))), piece))
    return tokens(spark, folder).select("id", searched_mask_of_variants(F.col("ids"), ways, [2]).alias("mask"))


@query("loader_sliced", "WITH c AS (SELECT count(*) // 8 * 8 AS n FROM supplier) SELECT i AS idx, i // 8 AS step, i % 8 // 2 AS rank, i % 2 AS slot FROM c, range(100000) r(i) WHERE i < n")
def sliced(spark: SparkSession, folder: str) -> DataFrame:
    plan = L.loader(spark, "single", rows_of(spark, folder, "supplier"), 0, 8, 1)
    return L.sliced(plan, 4).select("idx", "step", "rank", "slot")


@query("loader_tolerant_map", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 60 // (event_id % 3) END AS value, event_id % 3 = 0 AS failed FROM events")
def tolerant_map(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").select("event_id", (F.col("event_id") % 3).alias("k"))
    return L.tolerant_map(rows, "k", lambda k: 60 // k, "long").select("event_id", "value", F.col("error").isNotNull().alias("failed"))
