"""Queries over sampling, sharding, packing and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.operators import packing as P
from sparkprep.operators import sampling as S
from sparkprep.plans.packing_sql import first_fit_sql
from sparkprep.plans.registry import query, read


def rows_of(spark: SparkSession, folder: str, name: str = "orders") -> int:
    return read(spark, folder, name).count()


N = "(SELECT count(*) FROM orders)"


@query("sample_sequential", f"WITH r AS (SELECT unnest(range(40, {N})) AS idx) SELECT idx, (idx - 40) // 32 AS step, (idx - 40) % 32 // 4 AS rank, (idx - 40) % 4 AS slot FROM r WHERE idx < 40 + ({N} - 40) // 32 * 32")
def sequential(spark: SparkSession, folder: str) -> DataFrame:
    return S.sequential(spark, rows_of(spark, folder), 40, 4, 8)


@query(
    "sample_global_batches",
    f"""WITH c AS (SELECT {N} AS n), r AS (SELECT n, unnest(range(24, 24 + (n - 24 + 63) // 64 * 64)) AS i FROM c)
    SELECT CASE WHEN i < n THEN i ELSE -1 END AS idx, (i - 24) // 64 AS step, (i - 24) % 64 % 4 AS rank, (i - 24) % 64 // 4 // 8 AS micro_step, i >= n AS is_padding FROM r""",
)
def global_batches(spark: SparkSession, folder: str) -> DataFrame:
    return S.global_batches(spark, rows_of(spark, folder), 24, 64, 8, 4, "pad")


@query(
    "sample_random_sharded",
    f"""WITH c AS (SELECT {N} // 32 * 4 AS bucket), r AS (SELECT bucket, unnest(range(bucket * 8)) AS idx FROM c),
    p AS (SELECT idx, idx // bucket AS rank, row_number() OVER (PARTITION BY idx // bucket ORDER BY md5(idx || '-0'), idx) - 1 AS position FROM r)
    SELECT * FROM p WHERE position >= 8""",
)
def random_sharded(spark: SparkSession, folder: str) -> DataFrame:
    return S.random_sharded(spark, rows_of(spark, folder), 64, 4, 8)


@query(
    "sample_block_shuffle",
    f"""WITH r AS (SELECT unnest(range(greatest(2000, {N}))) AS i),
    p AS (SELECT i, i // 128 AS block FROM r)
    SELECT md5(block || '-3') AS block_key, block, row_number() OVER (PARTITION BY block ORDER BY md5(i || '-' || (block + 3)), i) - 1 AS place, i % {N} AS sample FROM p""",
)
def block_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return S.block_shuffle(spark, rows_of(spark, folder), 2000, 128, 3)


@query(
    "sample_epoch_shuffle",
    f"""WITH c AS (SELECT {N} AS n), r AS (SELECT n, unnest(range(n * 2)) AS i FROM c), q AS (SELECT i % n AS sample, i // n AS epoch, n FROM r),
    p AS (SELECT epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY md5(sample || '-' || (epoch + 5)), sample) - 1 AS position, sample, epoch, n FROM q)
    SELECT position, sample, epoch FROM p WHERE position < n + n // 2""",
)
def epoch_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    n = rows_of(spark, folder)
    return S.epoch_shuffle(spark, n, n + n // 2, 5)


@query("sample_repeat_modulo", "WITH c AS (SELECT count(*) AS n FROM documents), e AS (SELECT unnest(range(3)) AS k), r AS (SELECT doc_id, k * n + doc_id AS position, n FROM documents, c, e) SELECT doc_id, position FROM r WHERE position < 2 * n + 17")
def repeat_modulo(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id")
    n = docs.count()
    return S.repeat_modulo(docs, F.col("doc_id"), n, 2 * n + 17)


@query("sample_chunk_shuffle", "SELECT doc_id, doc_id // 100 AS chunk, md5(doc_id || '-9') AS chunk_key FROM documents")
def chunk_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return S.chunk_shuffle(read(spark, folder, "documents").select("doc_id"), F.col("doc_id"), F.col("doc_id"), 100, 9)


@query(
    "sample_hash_split",
    "SELECT o_orderkey, CASE WHEN substr(md5(o_orderkey || '-1'), 1, 8) < printf('%08x', CAST(floor(0.9 * 4294967296) AS BIGINT)) THEN 'train' WHEN substr(md5(o_orderkey || '-1'), 1, 8) < printf('%08x', CAST(floor(0.95 * 4294967296) AS BIGINT)) THEN 'validation' ELSE 'test' END AS split FROM orders",
)
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return S.hash_split(read(spark, folder, "orders").select("o_orderkey"), F.col("o_orderkey"), {"train": 0.9, "validation": 0.05, "test": 0.05}, 1)


@query("sample_shards", f"SELECT doc_id, doc_id % 7 AS stride, least(doc_id // greatest(n // 7, 1), 6) AS range_shard FROM documents, (SELECT count(*) AS n FROM documents)")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id")
    both = S.stride_shard(docs, F.col("doc_id"), 7).withColumnRenamed("shard", "stride")
    return S.contiguous_shard(both, F.col("doc_id"), docs.count(), 7).withColumnRenamed("shard", "range_shard")


@query("sample_counts", "SELECT CAST(1000 * 64 AS BIGINT) AS train, CAST((1000 // 100 + 1) * 10 * 32 AS BIGINT) AS valid, CAST(10 * 32 AS BIGINT) AS test")
def counts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([S.sample_counts(1000, 64, 100, 10, 32)], "train long, valid long, test long")


@query(
    "sample_blend",
    """WITH w AS (SELECT * FROM (VALUES (0, 600), (1, 300), (2, 100)) t(dataset, n)), r AS (SELECT CAST(dataset AS BIGINT) AS dataset, n, unnest(range(n)) AS nth FROM w)
    SELECT dataset, nth, (nth * 2 + 1) / (2.0 * n) AS "at" FROM r""",
)
def blend(spark: SparkSession, folder: str) -> DataFrame:
    return S.blended(spark, [6, 3, 1], 1000)


LENGTHS = "SELECT doc_id AS id, CAST(len(string_split(text, ' ')) AS BIGINT) AS length FROM documents"


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.size(F.split("text", " ", -1)).cast("long").alias("length"))


@query("pack_histogram", f"WITH l AS ({LENGTHS}), h AS (SELECT unnest(range(20001)) AS length) SELECT h.length, count(l.id) AS n FROM h LEFT JOIN l ON h.length = l.length GROUP BY h.length")
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Every length from 0 to 20,000, or to the longest document's where that is longer."""
    rows = lengths(spark, folder)
    return P.length_histogram(rows, F.col("length"), max(20000, rows.agg(F.max("length")).first()[0] or 0))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return P.assign_bins(lengths(spark, folder), 8192)


@query("pack_first_fit_decreasing", first_fit_sql(8192) + " SELECT id, length, bin FROM fitted")
def first_fit_decreasing(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of all documents."""
    return packed(spark, folder).select("id", "length", "bin")


@query("pack_bin_totals", first_fit_sql(8192) + " SELECT bin, sum(length)::BIGINT AS total, count(*) AS n FROM fitted GROUP BY bin")
def bin_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and documents of each bin."""
    return packed(spark, folder).groupBy("bin").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "pack_fill",
    first_fit_sql(2048)
    + """, i AS (SELECT f.*, md5(f.id || '-rank') AS h, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS INTEGER)) AS ids FROM fitted f JOIN documents ON doc_id = f.id),
    m AS (SELECT *, list_transform(range(length), lambda p: CAST(p >= length // 2 - 1 AND p < length - 1 AS BIGINT)) AS mask, coalesce(sum(length) OVER (PARTITION BY bin ORDER BY length DESC, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM i)
    SELECT bin, flatten(list(ids ORDER BY length DESC, h)) AS input_ids, flatten(list(mask ORDER BY length DESC, h)) AS loss_mask, list(start ORDER BY length DESC, h) AS seq_start_id FROM m GROUP BY bin""",
)
def fill(spark: SparkSession, folder: str) -> DataFrame:
    """Packed rows (input_ids, loss_mask, seq_start_id) of all documents, whose second halves are the answers."""
    words = F.transform(F.split("text", " ", -1), lambda x: F.length(x).cast("int"))
    rows = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), words.alias("input_ids"))
    rows = rows.withColumn("loss_mask", F.transform("input_ids", lambda _, i: (i >= F.floor(F.size("input_ids") / 2)).cast("int"))).withColumn("length", F.size("input_ids").cast("long"))
    return P.fill(P.assign_bins(rows, 2048))


@query(
    "pack_statistics",
    first_fit_sql(8192)
    + """, b AS (SELECT sum(length) AS total, count(*) AS n, max(length) AS longest FROM fitted GROUP BY bin)
    SELECT round(sum(n) / count(*), 2) AS packing_factor, round(sum(total) / count(*) / 8192 * 100, 2) AS packing_efficiency, max(longest) AS max_length, max(n) AS max_per_bin, min(total)::BIGINT AS min_bin_sum FROM b""",
)
def statistics(spark: SparkSession, folder: str) -> DataFrame:
    return P.pack_statistics(packed(spark, folder), 8192)


@query(
    "pack_average_lengths",
    f"WITH l AS ({LENGTHS}), r AS (SELECT id // 8 AS pack, count(*) AS n, sum(length) AS total, sum(length * length) AS squares FROM l GROUP BY 1) SELECT round(avg(n), 6) AS sequences_per_pack, round(avg(total), 6) AS tokens_per_pack, round(sum(total) / sum(n), 6) AS tokens_per_sequence, round(avg(squares), 6) AS squares_per_pack FROM r",
)
def average_lengths(spark: SparkSession, folder: str) -> DataFrame:
    packs = lengths(spark, folder).groupBy(F.expr("id div 8").alias("pack")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.sum(F.col("length") * F.col("length")).alias("squares"))
    return packs.agg(
        F.round(F.avg("n"), 6).alias("sequences_per_pack"),
        F.round(F.avg("total"), 6).alias("tokens_per_pack"),
        F.round(F.sum("total") / F.sum("n"), 6).alias("tokens_per_sequence"),
        F.round(F.avg("squares"), 6).alias("squares_per_pack"),
    )


@query("sample_rank_extremes", "WITH r AS (SELECT user_id, sum(value) AS score FROM events GROUP BY user_id), o AS (SELECT *, row_number() OVER (ORDER BY score, user_id) AS low, row_number() OVER (ORDER BY score DESC, user_id) AS high FROM r) SELECT user_id, low <= 3 AS worst, high <= 3 AS best FROM o WHERE low <= 3 OR high <= 3")
def rank_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """The three best and the three worst scores."""
    scores = read(spark, folder, "events").groupBy("user_id").agg(F.sum("value").alias("score"))
    return S.extremes(scores, "user_id", "score")
