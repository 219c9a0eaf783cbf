"""Queries over makers of examples, progress logs and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.operators import examples as E
from sparkprep.operators import joins as J
from sparkprep.operators import records as R
from sparkprep.plans.array_queries import D, tokens
from sparkprep.plans.record_queries import M
from sparkprep.plans.registry import query, read


@query("example_question_answering", "SELECT c_custkey, 'Context: ' || c_name || ' Question: ' || c_mktsegment || ' Answer:' AS input, c_mktsegment AS output, [c_mktsegment, c_name] AS original_answers FROM customer")
def question_answering(spark: SparkSession, folder: str) -> DataFrame:
    made = E.question_answering(F.col("c_name"), F.col("c_mktsegment"), F.array("c_mktsegment", "c_name"))
    return read(spark, folder, "customer").select("c_custkey", *(v.alias(k) for k, v in made.items()))


@query("example_mathematics", "SELECT p_partkey, 'Question: ' || p_name || ' Answer:' AS input, p_brand || ' #### ' || p_size AS output, [CAST(p_size AS VARCHAR)] AS original_answers FROM part")
def mathematics(spark: SparkSession, folder: str) -> DataFrame:
    made = E.mathematics(F.col("p_name"), F.concat("p_brand", F.lit(" #### "), "p_size"))
    return read(spark, folder, "part").select("p_partkey", *(v.alias(k) for k, v in made.items()))


@query(
    "example_solutions",
    "SELECT p_partkey, 'Problem: ' || p_name || ' Solution:' AS input, 'so \\boxed{' || p_size || '} it is $\\boxed{{' || p_size || '}}$' AS output, [p_brand] AS original_answers, 'so ' || p_size || ' it is' AS thinking, '#### ' || p_brand AS content, 'no ' || p_name AS unboxed FROM part",
)
def solutions(spark: SparkSession, folder: str) -> DataFrame:
    generated = F.concat(F.lit("so \\boxed{"), "p_size", F.lit("} it is $\\boxed{{"), "p_size", F.lit("}}$"))
    made = E.solution(F.col("p_name"), generated, F.col("p_brand"))
    spoken, plain = E.thinking_and_final(generated, F.col("p_brand")), E.thinking_and_final(F.concat(F.lit("no "), "p_name", F.lit(" \n")), F.col("p_brand"))
    return read(spark, folder, "part").select("p_partkey", *(v.alias(k) for k, v in made.items()), spoken[0]["thinking"].alias("thinking"), spoken[0]["content"].alias("content"), plain[0]["thinking"].alias("unboxed"))


@query(
    "example_receipts",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 OR CAST('0x' || substr(md5(s_suppkey || '-0'), 1, 8) AS BIGINT) % 2 = 0 THEN '<s_total>' || s_suppkey || '</s_total><s_menu><s_nm>' || s_name || '</s_nm><sep/><s_nm>two</s_nm></s_menu>' ELSE 'plain ' || s_name END AS tags FROM supplier",
)
def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Even suppliers have one parse; odd ones two, of which a keyed draw takes one."""
    parse = F.struct(F.array(F.struct(F.col("s_name").alias("nm")), F.struct(F.lit("two").alias("nm"))).alias("menu"), F.col("s_suppkey").alias("total"))
    other = F.concat(F.lit('{"text_sequence":"plain '), "s_name", F.lit('"}'))
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"gt_parse":'), F.to_json(parse), F.lit("}"))).otherwise(F.concat(F.lit('{"gt_parses":['), F.to_json(parse), F.lit(","), other, F.lit("]}")))
    return read(spark, folder, "supplier").select("s_suppkey", E.receipt(text, F.col("s_suppkey")).alias("tags"))


@query("example_first_turn_media", M + ", k AS (SELECT conv_id, list_filter(messages, lambda x: length(trim(coalesce(x.content, ''))) > 0) AS said FROM m) SELECT conv_id, list_transform(said, lambda x, i: CASE WHEN i = list_position(list_transform(said, lambda y: y.role), 'user') THEN 'clip.mp4' END) AS media FROM k")
def first_turn_media(spark: SparkSession, folder: str) -> DataFrame:
    made = E.first_turn_media(F.col("messages"), F.lit("clip.mp4"))
    return R.conversations(read(spark, folder, "conversations")).select("conv_id", F.transform(made, lambda x: x["media"]).alias("media"))


@query("example_turn_masks", M + "SELECT conv_id, flatten(list_transform(messages, lambda x, i: list_transform(string_split(x.content, ' '), lambda w, k: CAST(CASE WHEN i = 1 OR (x.role = 'user' AND k > 1) THEN -100 ELSE length(w) END AS BIGINT)))) AS labels FROM m")
def turn_masks(spark: SparkSession, folder: str) -> DataFrame:
    return R.conversations(read(spark, folder, "conversations")).select("conv_id", E.turn_mask(F.col("messages")).alias("labels"))


@query(
    "example_searched_masks",
    D
    + """, a AS (SELECT id, ids, len(ids) AS n, ids[5:7] AS x, ids[20:23] AS y FROM d),
    f AS (SELECT *, CASE WHEN len(x) > 0 THEN (SELECT min(p) FROM unnest(range(1, n - len(x) + 2)) t(p) WHERE ids[p:p + len(x) - 1] = x) END AS p1 FROM a),
    g AS (SELECT *, CASE WHEN len(y) > 0 THEN (SELECT min(p) FROM unnest(range(1, n - len(y) + 2)) t(p) WHERE p > coalesce(p1 + len(x) - 1, 0) AND ids[p:p + len(y) - 1] = y) END AS p2 FROM f)
    SELECT id, list_transform(range(1, n + 1), lambda i: CAST(coalesce(i BETWEEN p1 AND p1 + len(x) - 1, false) OR coalesce(i BETWEEN p2 AND p2 + len(y) - 1, false) AS BIGINT)) AS mask FROM g""",
)
def searched_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Two pieces of each document looked for one behind the other."""
    two = F.array(F.slice("ids", 5, 3), F.slice("ids", 20, 4))
    return tokens(spark, folder).select("id", E.searched_mask(F.col("ids"), two).alias("mask"))


@query("example_options", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE n_name END AS answer FROM nation")
def options(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select("n_nationkey", E.chosen_option(F.array(F.lit("a"), F.lit("b")), F.col("n_nationkey") % 4, F.col("n_name")).alias("answer"))


@query("example_included_names", "SELECT c_custkey, CASE WHEN c_name LIKE '%1' THEN '*1' WHEN c_name LIKE '%7%' THEN '*7*' END AS pattern, CASE WHEN c_name LIKE '%3' THEN NULL ELSE '' END AS other FROM customer")
def included_names(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select("c_custkey", E.included(F.col("c_name"), ["*1", "*7*"]).alias("pattern"), E.included(F.col("c_name"), [], ["*3"]).alias("other"))


@query("example_subsets", "SELECT s_suppkey AS id, s_name AS name, NULL AS segment, 'suppliers' AS subset FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'customers' FROM customer")
def subsets(spark: SparkSession, folder: str) -> DataFrame:
    a = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return E.subsets({"suppliers": a, "customers": b}).select("id", "name", "segment", "subset")


@query("join_reverse_rule", "SELECT s_suppkey, 'decoder.layers.' || s_suppkey || '.q' AS source_name FROM supplier")
def reverse_rule(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("model.layers."), "s_suppkey", F.lit(".q.w"))
    rule, target = J.first_rule(name, [("model.layers.*.q.w", "decoder.layers.*.q"), ("rest/**/end", "other.**.x")])
    return read(spark, folder, "supplier").where(rule == 0).select("s_suppkey", target.alias("source_name"))


@query("metric_keys_per_file", "SELECT l_orderkey AS file, count(*) AS keys, list_sort(list(l_partkey)) AS held FROM lineitem GROUP BY 1")
def keys_per_file(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("file"), "l_partkey")
    return J.keys_by_file(rows, "file", "l_partkey").select("file", F.size("keys").cast("long").alias("keys"), F.col("keys").alias("held"))


@query("metric_eta", "SELECT event_id, round((event_id + 1) * 2.5 / ((event_id + 1) / 20000.0) * (1 - (event_id + 1) / 20000.0) / 60, 4) AS minutes_left FROM events")
def eta(spark: SparkSession, folder: str) -> DataFrame:
    done = (F.col("event_id") + 1) / 20000.0
    return read(spark, folder, "events").select("event_id", F.round((F.col("event_id") + 1) * 2.5 / done * (1 - done) / 60, 4).alias("minutes_left"))


@query(
    "metric_progress_log",
    """WITH e AS (SELECT user_id, event_id, event_type, event_id % 97 AS tokens FROM events), m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM m) SELECT user_id, event_id, (sum(tokens) OVER (PARTITION BY user_id, i ORDER BY event_id))::BIGINT AS tokens_since FROM g""",
)
def progress_log(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated progress lines: tokens since the job's world (here the event type) last changed."""
    from sparkprep.operators.metrics import islands

    line = F.concat_ws("\t", F.concat(F.lit("World: "), "event_type"), F.concat(F.lit("Tokens: "), F.col("event_id") % 97))
    parsed = read(spark, folder, "events").select("user_id", "event_id", F.split(line, "\t").alias("f"))
    fields = parsed.select("user_id", "event_id", F.substring_index(F.col("f")[0], ": ", -1).alias("world"), F.substring_index(F.col("f")[1], ": ", -1).cast("long").alias("tokens"))
    held = islands(fields, "user_id", "event_id", F.col("world"))
    w = Window.partitionBy("user_id", "island").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return held.select("user_id", "event_id", F.sum("tokens").over(w).alias("tokens_since"))


@query("source_archives", "SELECT conv_id, turn, text FROM conversations")
def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as members of tar shards and back; the shards stay in the executors' hands."""
    from sparkprep.sources import archives as A

    rows = read(spark, folder, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("key"), F.lit("txt").alias("extension"), F.col("text").cast("binary").alias("content"), (F.col("conv_id") % 3).alias("shard"))
    shards = A.tar_shards(rows, "key", "shard")

    def run(batches):
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(1).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    yield pa.RecordBatch.from_pylist([{"name": m.name, "text": tar.extractfile(m).read().decode()} for m in tar])

    found = shards.mapInArrow(run, "name string, text string")
    part = lambda i: F.regexp_extract("name", r"^(\d+)_(\d+)\.txt$", i).cast("long")
    return found.select(part(1).alias("conv_id"), part(2).alias("turn"), "text")


@query("filter_answer_tokens", D + "SELECT id, len(list_filter(ids, lambda x: x IN (2, 4))) AS special, list_sort(list_distinct(list_filter(ids, lambda x: x IN (2, 4)))) AS kinds FROM d")
def special_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a fixed vocabulary in each document."""
    from sparkprep.functions.arrays import kinds_of

    n, kinds = kinds_of(F.col("ids"), [2, 4])
    return tokens(spark, folder).select("id", n.alias("special"), kinds.alias("kinds"))
