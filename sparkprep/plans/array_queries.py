"""Queries over token arrays: a document's tokens are the lengths of its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions import arrays as A
from sparkprep.plans.registry import query, read

TOKENS = "list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS BIGINT))"


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ids): the lengths of each document's words."""
    words = F.transform(F.split("text", " ", -1), lambda x: F.length(x).cast("long"))
    return read(spark, folder, "documents").select(F.col("doc_id").alias("id"), words.alias("ids"))


D = f"WITH d AS (SELECT doc_id AS id, {TOKENS} AS ids FROM documents) "


@query("array_ceil_multiple", D + "SELECT id, CAST(ceil(len(ids) / 16.0) AS BIGINT) * 16 AS multiple, CAST(pow(2, ceil(log2(len(ids)))) AS BIGINT) AS power FROM d")
def ceil_multiple(spark: SparkSession, folder: str) -> DataFrame:
    n = F.size("ids")
    return tokens(spark, folder).select("id", A.ceil_to_multiple(n, 16).alias("multiple"), A.ceil_to_power_of_two(n).alias("power"))


@query("array_pad_right", D + "SELECT id, list_concat(ids, list_transform(range(greatest(64 - len(ids), 0)), lambda x: CAST(0 AS BIGINT))) AS padded FROM d")
def pad_right(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).select("id", A.pad_right(F.col("ids"), 64, 0).alias("padded"))


@query("array_pad_or_cut", D + "SELECT id, list_concat(ids[1:100], list_transform(range(greatest(64 - len(ids), 0)), lambda x: CAST(0 AS BIGINT))) AS padded FROM d")
def pad_or_cut(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).select("id", A.pad_or_cut(F.col("ids"), 64, 0, 100).alias("padded"))


@query("array_truncate", D + "SELECT id, ids[1:32] AS front, ids[greatest(len(ids) - 31, 1):len(ids)] AS back FROM d")
def truncate(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).select("id", A.truncate(F.col("ids"), 32).alias("front"), A.truncate(F.col("ids"), 32, "left").alias("back"))


@query(
    "array_loss_masks",
    D + "SELECT id, list_transform(ids, lambda x, i: CAST(i - 1 >= 5 AS BIGINT)) AS answer, list_transform(ids, lambda x, i: CAST(i - 1 >= 4 AND i < len(ids) AS BIGINT)) AS packed FROM d",
)
def loss_masks(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.col("ids")
    return tokens(spark, folder).select("id", A.answer_mask(ids, F.lit(5)).alias("answer"), A.packed_mask(ids, F.lit(5)).alias("packed"))


@query(
    "array_next_labels",
    D + "SELECT id, list_concat(ids[2:len(ids)], [CAST(-100 AS BIGINT)]) AS labels, list_transform(list_concat(ids[2:len(ids)], [CAST(-100 AS BIGINT)]), lambda x, i: CASE WHEN i - 1 >= 5 THEN x ELSE -100 END) AS masked FROM d",
)
def next_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = A.next_labels(F.col("ids"))
    return tokens(spark, folder).select("id", labels.alias("labels"), A.masked_labels(labels, A.answer_mask(F.col("ids"), F.lit(5))).alias("masked"))


@query(
    "array_find",
    D
    + """SELECT id, coalesce(list_min(list_filter(range(CAST(len(ids) - 1 AS BIGINT)), lambda p: ids[p + 1] = 2 AND ids[p + 2] = 4)), -1) AS first_place,
    coalesce(list_max(list_filter(range(CAST(len(ids) - 1 AS BIGINT)), lambda p: ids[p + 1] = 2 AND ids[p + 2] = 4)), -1) AS last_place FROM d""",
)
def find(spark: SparkSession, folder: str) -> DataFrame:
    needle = F.array(F.lit(2).cast("long"), F.lit(4).cast("long"))
    return tokens(spark, folder).select("id", A.find_array(needle, F.col("ids")).alias("first_place"), A.find_array_last(needle, F.col("ids")).alias("last_place"))


@query(
    "array_boundaries",
    D
    + """, s AS (SELECT id, list_filter(ids, lambda x: x > 0) AS l FROM d WHERE len(list_filter(ids, lambda x: x > 0)) > 0)
    SELECT id, list_transform(range(len(l) + 1), lambda i: CAST(coalesce(list_sum(l[1:i]), 0) AS BIGINT)) AS cu_seqlens, list_max(l) AS max_seqlen,
    flatten(list_transform(l, lambda n: range(n))) AS position_ids FROM s""",
)
def boundaries(spark: SparkSession, folder: str) -> DataFrame:
    lengths = F.filter("ids", lambda x: x > 0)
    sums = tokens(spark, folder).where(F.size(lengths) > 0).select("id", A.running_sums(lengths).alias("cu_seqlens"))
    padded = sums.withColumn("cu_seqlens", A.cut_at_padding(F.concat("cu_seqlens", F.array_repeat(F.lit(-1).cast("long"), 3))))
    return padded.select("id", "cu_seqlens", F.array_max(A.boundary_lengths(F.col("cu_seqlens"))).alias("max_seqlen"), A.positions_by_segment(F.col("cu_seqlens")).alias("position_ids"))


@query("array_zigzag_split", "WITH p AS (SELECT unnest(range(4096)) AS position) SELECT position, CAST(least(position // 512, 7 - position // 512) AS BIGINT) AS rank FROM p")
def zigzag(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(0, 4096).select(F.col("id").alias("position"), A.zigzag_rank(F.col("id"), 4096, 4).alias("rank"))


@query(
    "array_replace_with_copies",
    D
    + """, s AS (SELECT id, ids AS a FROM d)
    SELECT id, flatten(list_transform(a, lambda x, i: CASE WHEN x = 3 THEN list_transform(range(1 + len(list_filter(a[1:i], lambda y: y = 3)) % 3), lambda z: x) ELSE [x] END)) AS expanded FROM s""",
)
def replace_with_copies(spark: SparkSession, folder: str) -> DataFrame:
    counts = F.transform(F.sequence(F.lit(1), F.size("ids")), lambda k: 1 + k % 3)
    return tokens(spark, folder).select("id", A.replace_with_copies(F.col("ids"), 3, counts).alias("expanded"))


@query("array_bad_values", "SELECT vec_id, list_bool_or(list_transform(embedding, lambda x: isnan(x) OR abs(x) > 0.3)) AS bad FROM embeddings")
def bad_values(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select("vec_id", A.has_bad_value(F.col("embedding"), 0.3).alias("bad"))


@query(
    "array_runs",
    D
    + """, e AS (SELECT id, ids AS a, unnest(range(1, 1 + len(ids))) AS i FROM d),
    m AS (SELECT id, i, a[i] AS v, CASE WHEN i = 1 OR a[i] <> a[i - 1] THEN 1 ELSE 0 END AS f FROM e),
    g AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY i) AS r FROM m)
    SELECT id, min(i) - 1 AS run_start, max(i) AS run_end, min(v) AS run_value FROM g GROUP BY id, r""",
)
def runs(spark: SparkSession, folder: str) -> DataFrame:
    found = tokens(spark, folder).select("id", F.explode(A.runs(F.col("ids"))).alias("r"))
    return found.select("id", F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"), F.col("r.value").alias("run_value"))


@query("array_valid_packed_rows", D + "SELECT id, len(ids) > 5 AS valid FROM d")
def valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    starts = F.array(F.lit(0).cast("long"), F.lit(5).cast("long"))
    return tokens(spark, folder).select("id", A.valid_row(F.col("ids"), A.answer_mask(F.col("ids"), F.lit(0)), starts).alias("valid"))


@query(
    "array_random_mask",
    D
    + """, e AS (SELECT id, unnest(ids) AS token, unnest(range(len(ids))) AS place FROM d)
    SELECT id, place, CASE WHEN substr(md5(id || '-' || place || '-7'), 1, 4) < '4000' THEN -1 ELSE token END AS token FROM e""",
)
def random_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens masked with a chance of a quarter, drawn by a keyed hash."""
    rows = tokens(spark, folder).select("id", F.posexplode("ids").alias("place", "token"))
    draw = F.substring(F.md5(F.concat_ws("-", "id", "place", F.lit(7))), 1, 4)
    return rows.select("id", F.col("place").cast("long").alias("place"), F.when(draw < "4000", F.lit(-1).cast("long")).otherwise(F.col("token")).alias("token"))


@query("array_inner_product_compare", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS squares, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS largest FROM embeddings")
def compare(spark: SparkSession, folder: str) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return read(spark, folder, "embeddings").select("vec_id", F.round(squares, 4).alias("squares"), F.array_max(F.transform("embedding", lambda x: F.abs(x))).cast("double").alias("largest"))


@query(
    "array_microbatch_split",
    D + "SELECT id, ids[1:(len(ids) + 1) // 2] AS part_0, ids[(len(ids) + 1) // 2 + 1:] AS part_1 FROM d",
)
def microbatch_split(spark: SparkSession, folder: str) -> DataFrame:
    """Each array in two parts, the first one longer where its length is odd."""
    return tokens(spark, folder).select("id", *(A.micro_part(F.col("ids"), k, 2).alias(f"part_{k}") for k in range(2)))


@query(
    "array_sub_array_positions_with_resets",
    D
    + """, e AS (SELECT id, unnest(ids) AS token, unnest(range(len(ids))) AS place FROM d),
    g AS (SELECT *, coalesce(sum(CASE WHEN token = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM e)
    SELECT id, place, CAST(segment AS BIGINT) AS segment, row_number() OVER (PARTITION BY id, segment ORDER BY place) - 1 AS position_id FROM g""",
)
def positions_with_resets(spark: SparkSession, folder: str) -> DataFrame:
    """Position ids that restart after each end token (2); the segment number blocks attention across it."""
    from pyspark.sql import Window

    rows = tokens(spark, folder).select("id", F.posexplode("ids").alias("place", "token"))
    before = F.sum((F.col("token") == 2).cast("long")).over(Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("segment", F.coalesce(before, F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("id", "segment").orderBy("place")).cast("long") - 1
    return marked.select("id", F.col("place").cast("long").alias("place"), "segment", rank.alias("position_id"))
