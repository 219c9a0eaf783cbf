"""Queries over batches, media records and diffusion training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions import arrays as A
from sparkprep.functions import media as M
from sparkprep.operators import batches as B
from sparkprep.operators import packing as P
from sparkprep.operators import sampling as S
from sparkprep.plans.array_queries import D, tokens
from sparkprep.plans.packing_sql import first_fit_sql
from sparkprep.plans.registry import query, read

WHOLE = D + ", s AS (SELECT id, id // 4 AS batch, ids AS x FROM d) "


@query("batch_gathered", "WITH c AS (SELECT count(*) AS n FROM documents), m AS (SELECT n, unnest(range((n + 63) // 64 * 64)) AS i FROM c) SELECT i // 64 AS step, CASE WHEN i < n THEN i ELSE -1 END AS sample, d.lang, i >= n AS is_padding FROM m LEFT JOIN documents d ON d.doc_id = i")
def gathered(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    plan = S.global_batches(spark, docs.count(), 0, 64, 8, 4, "pad").select(F.col("idx").alias("sample"), "step")
    return B.gathered(plan, docs).select("step", "sample", "lang", "is_padding")


@query(
    "batch_packed",
    WHOLE
    + """SELECT batch, flatten(list(list_concat(x, list_transform(range((4 - len(x) % 4) % 4), lambda k: CAST(0 AS BIGINT))) ORDER BY id)) AS input_ids,
    flatten(list(list_concat(range(len(x)), range((4 - len(x) % 4) % 4)) ORDER BY id)) AS position_ids,
    flatten(list(list_concat(list_transform(x, lambda k: CAST(1 AS BIGINT)), list_transform(range((4 - len(x) % 4) % 4), lambda k: CAST(0 AS BIGINT))) ORDER BY id)) AS loss_mask,
    list_concat([CAST(0 AS BIGINT)], list_transform(range(1, count(*) + 1), lambda k: CAST(list_sum(list((len(x) + 3) // 4 * 4 ORDER BY id)[1:k]) AS BIGINT))) AS cu_seqlens FROM s GROUP BY batch""",
)
def packed(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens(spark, folder).select("id", F.expr("id div 4").alias("batch"), A.pad_right(F.col("ids"), 12, 0).alias("x"))
    return B.packed_batches(rows, "batch", "id", "x", 0, 4).select("batch", "input_ids", "position_ids", "loss_mask", "cu_seqlens")


@query("batch_zigzag_parts", D + "SELECT id, list_concat(ids[len(ids) // 8 + 1:len(ids) // 8 * 2], ids[len(ids) // 8 * 6 + 1:len(ids) // 8 * 7]) AS part, CASE WHEN len(ids) % 4 = 0 THEN ids[len(ids) // 4 + 1:len(ids) // 4 * 2] ELSE ids END AS slice FROM d")
def zigzag_parts(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.col("ids")
    return tokens(spark, folder).select("id", B.zigzag_part(ids, 1, 4).alias("part"), B.rank_slice(ids, 1, 4).alias("slice"))


@query("batch_padded_for_packing", D + "SELECT id, list_concat(ids[1:least((len(ids) + 15) // 16 * 16, 100)], list_transform(range(greatest(least((len(ids) + 15) // 16 * 16, 100) - len(ids) + 1, 0)), lambda k: CAST(0 AS BIGINT))) AS padded FROM d")
def padded_for_packing(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).select("id", B.padded_for_packing(F.col("ids"), 16, 100, 0).alias("padded"))


@query(
    "batch_selected_and_merged",
    first_fit_sql(256) + """, i AS (SELECT doc_id AS id, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS BIGINT)) AS ids FROM documents)
    SELECT f.bin, array_to_string(list(f.id ORDER BY f.id), ',') AS keys, flatten(list(i.ids ORDER BY f.id)) AS "values" FROM fitted f JOIN i ON i.id = f.id GROUP BY f.bin""",
)
def selected_and_merged(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens(spark, folder).withColumn("length", F.size("ids").cast("long"))
    return B.selected_and_merged(P.assign_bins(rows, 256), "id", "ids")


@query("batch_expanded_runs", "SELECT s_suppkey, CAST(1 AS BIGINT) AS t, s_nationkey AS h FROM supplier, range(1, 4) r(k) WHERE k <= s_suppkey % 4")
def expanded(spark: SparkSession, folder: str) -> DataFrame:
    return B.expand_runs(read(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("t"), F.col("s_nationkey").alias("h")), "t")


@query(
    "batch_collapsed_runs",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag AS f, CASE WHEN l_returnflag = lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS c FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_linenumber, l_returnflag FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    g AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM m) SELECT l_orderkey, min(l_linenumber) AS start, count(*) AS "count", min(f) AS l_returnflag FROM g GROUP BY l_orderkey, i""",
)
def collapsed(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    return B.collapse_runs(read(spark, folder, "lineitem").select("l_orderkey", place.alias("at"), "l_returnflag"), "l_orderkey", "at", "l_returnflag")


@query(
    "batch_segments",
    D
    + """, e AS (SELECT id, unnest(ids) AS t, unnest(range(len(ids))) AS p FROM d), g AS (SELECT *, coalesce(sum(CASE WHEN t = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e)
    SELECT id, CAST(s AS BIGINT) AS segment, list(t ORDER BY p) AS ids FROM g GROUP BY id, s""",
)
def segments(spark: SparkSession, folder: str) -> DataFrame:
    return B.segments(tokens(spark, folder), "id", "ids", 2).select("id", F.col("segment").cast("long").alias("segment"), "ids")


@query("media_grids", "SELECT p_partkey, [p_size // 2, (p_size * 7) // 14, (p_size * 9) // 14] AS grid, CAST(p_size * ((p_size * 7) // 2) * ((p_size * 9) // 2) AS BIGINT) AS tokens FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def grids(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_size").cast("long")
    return read(spark, folder, "part").select("p_partkey", M.grid_size(n, n * 7, n * 9, (2, 14, 14)).alias("grid"), M.placeholder_count(n, n * 7, n * 9, 2).alias("tokens"))


@query(
    "media_adjusted_runs",
    D
    + """, r AS (SELECT id, ids, id % 5 + 1 AS m, id % 9 AS n, len(ids) // 2 AS h FROM d),
    k AS (SELECT *, CASE WHEN n > m + 2 THEN n WHEN n < m + 2 THEN least(n, m) ELSE m END AS kept FROM r)
    SELECT id, list_concat(list_concat(list_concat(ids[1:h], [CAST(-1 AS BIGINT)]), list_transform(range(kept), lambda x: CAST(-9 AS BIGINT))), list_concat([CAST(-2 AS BIGINT)], ids[h + 1:])) AS adjusted,
    list_concat(list_concat(list_concat(list_transform(ids[1:h], lambda x: CAST(1 AS BIGINT)), [CAST(1 AS BIGINT)]), list_transform(range(kept), lambda x: CAST(CASE WHEN x < greatest(n - m, 0) AND n > m + 2 THEN -9 ELSE 1 END AS BIGINT))), list_concat([CAST(1 AS BIGINT)], list_transform(ids[h + 1:], lambda x: CAST(1 AS BIGINT)))) AS mask FROM k""",
)
def adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """A run of id % 5 + 1 media tokens amid each document, made to fit id % 9; the mask follows."""
    mark = lambda x: F.array(F.lit(x).cast("long"))
    half = F.floor(F.size("ids") / 2).cast("int")
    media = F.array_repeat(F.lit(-9).cast("long"), (F.col("id") % 5 + 1).cast("int"))
    rows = tokens(spark, folder).select("id", F.concat(F.slice("ids", F.lit(1), half), mark(-1), media, mark(-2), F.slice("ids", half + 1, F.size("ids"))).alias("x"))
    found, mask = M.adjusted_runs(F.col("x"), F.array(F.col("id") % 9), -1, -2, F.transform("x", lambda _: F.lit(1).cast("long")))
    return rows.select("id", found.alias("adjusted"), mask.alias("mask"))


@query("media_grid_positions", "SELECT s_suppkey, list_transform(range(12), lambda i: [i // 6 + s_suppkey, i // 3 % 2 + s_suppkey, i % 3 + s_suppkey]) AS places FROM supplier")
def grid_positions(spark: SparkSession, folder: str) -> DataFrame:
    found = M.grid_positions(2, 2, 3, F.col("s_suppkey"))
    return read(spark, folder, "supplier").select("s_suppkey", F.transform(found, lambda p: F.array(p["t"], p["h"], p["w"])).alias("places"))


@query("media_mask_positions", WHOLE + ", e AS (SELECT id, unnest(x) AS t, unnest(range(len(x))) AS p FROM s), c AS (SELECT id, p, CAST(sum(CASE WHEN t > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS n FROM e) SELECT id, list(n ORDER BY p) AS positions FROM c GROUP BY id")
def mask_positions(spark: SparkSession, folder: str) -> DataFrame:
    mask = F.transform("ids", lambda x: (x > 2).cast("long"))
    return tokens(spark, folder).select("id", mask.alias("m")).select("id", M.mask_positions(F.col("m")).alias("positions"))


@query(
    "media_fitted_sizes",
    """WITH s AS (SELECT p_partkey, p_size * 37 AS w, p_partkey % 97 + 1 AS h FROM part), a AS (SELECT *, w::DOUBLE / greatest(h, 1) AS r FROM s)
    SELECT p_partkey, CASE WHEN r > 640 / 480::DOUBLE THEN 640 ELSE floor(480 * r)::BIGINT END AS w, CASE WHEN r > 640 / 480::DOUBLE THEN floor(640 / r)::BIGINT ELSE 480 END AS h,
    CASE WHEN r > 640 / 480::DOUBLE THEN floor(480 * r)::BIGINT ELSE 640 END AS fill_w, CASE WHEN r > 640 / 480::DOUBLE THEN 480 ELSE floor(640 / r)::BIGINT END AS fill_h FROM a""",
)
def fitted(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size") * 37, F.col("p_partkey") % 97 + 1
    w, h = M.fitted(*size, 640, 480)
    fill_w, fill_h = M.fitted(*size, 640, 480, True)
    return read(spark, folder, "part").select("p_partkey", w.alias("w"), h.alias("h"), fill_w.alias("fill_w"), fill_h.alias("fill_h"))


@query("media_time_steps", "WITH u AS (SELECT p_partkey, CAST(('0x' || substr(md5(p_partkey || '-3'), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM part) SELECT p_partkey, round(CASE WHEN u > 0 THEN 3.0 / (3.0 + 1 / u - 1) ELSE 0 END, 6) AS sigma FROM u")
def time_steps(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select("p_partkey", F.round(M.time_step(M.uniform(F.col("p_partkey"), 3), 3.0), 6).alias("sigma"))


@query("media_weighted_error", "SELECT vec_id, round(1.5 * list_sum(list_transform(embedding, lambda x: pow(0.25 * CAST(x AS DOUBLE) - 0.25, 2))) / 64, 6) AS error FROM embeddings")
def weighted_error(spark: SparkSession, folder: str) -> DataFrame:
    clean = F.transform("embedding", lambda x: x.cast("double"))
    mixed = M.interpolated(clean, F.transform("embedding", lambda _: F.lit(1.0)), F.lit(0.25))
    return read(spark, folder, "embeddings").select("vec_id", clean.alias("clean"), mixed.alias("mixed")).select("vec_id", F.round(M.weighted_error(F.col("clean"), F.col("mixed"), F.lit(1.5)), 6).alias("error"))


@query(
    "media_block_mask",
    "WITH p AS (SELECT q, k, q % 8 // 2 AS bq, k % 8 // 2 AS bk FROM range(16) a(q), range(16) b(k)) SELECT q, count(*) AS seen, sum(k)::BIGINT AS places FROM p WHERE (q < 8 AND k < 8 AND bq = bk) OR (q < 8 AND k >= 8 AND bk < bq) OR (q >= 8 AND k >= 8 AND k <= q) GROUP BY q",
)
def block_mask(spark: SparkSession, folder: str) -> DataFrame:
    cells = spark.range(256).select(F.expr("id div 16").alias("q"), (F.col("id") % 16).alias("k"))
    return cells.where(M.block_visible(F.col("q"), F.col("k"), 8, 2)).groupBy("q").agg(F.count(F.lit(1)).alias("seen"), F.sum("k").alias("places"))


@query("media_messages", "SELECT doc_id, ['image:' || source || '.jpg', 'text:see this ' || lang] AS parts, doc_id % 2 = 0 AS consistent FROM documents")
def messages(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("<image>")).otherwise(F.lit("<image><image>")), F.lit("see this "), "lang")
    images = F.array(F.concat("source", F.lit(".jpg")))
    parts = F.transform(M.media_message(text, images), lambda x: F.concat_ws(":", x["type"], x["value"]))
    return read(spark, folder, "documents").select("doc_id", parts.alias("parts"), M.consistent_media(text, images).alias("consistent"))


@query(
    "media_prefix",
    D
    + """SELECT id, list_concat(list_concat([CAST(-7 AS BIGINT), -7, -7], ids[1:9]), list_transform(range(9 - len(ids[1:9])), lambda k: CAST(0 AS BIGINT))) AS input_ids,
    list_transform(range(12), lambda i: CASE WHEN i + 1 >= 3 AND i + 1 < 3 + len(ids[1:9]) THEN ids[i - 1] ELSE -100 END) AS labels FROM d""",
)
def prefix(spark: SparkSession, folder: str) -> DataFrame:
    ids, labels = M.media_prefix(F.col("ids"), -7, 3, 12, 0)
    return tokens(spark, folder).select("id", ids.alias("input_ids"), labels.alias("labels"))


@query("media_lettered_options", "SELECT n_nationkey, 'A. ' || n_name || chr(10) || 'B. none' AS options FROM nation")
def lettered(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select("n_nationkey", M.lettered(F.array("n_name", F.lit("none"))).alias("options"))


@query("sort_top_k", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest of each group."""
    return S.top_of_each(read(spark, folder, "customer"), "c_nationkey", 5, F.desc("c_acctbal"), "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal")
