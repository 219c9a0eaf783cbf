"""Queries over chat records, prompts, makers of conversations and collation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.operators import chat as C
from sparkprep.operators import makers as K
from sparkprep.operators import providers as V
from sparkprep.operators import records as R
from sparkprep.plans.array_queries import D, tokens
from sparkprep.plans.registry import query, read

TURNS = "WITH m AS (SELECT conv_id, list(struct_pack(who := role, said := text, turn := turn) ORDER BY turn, role, text) AS ts FROM conversations GROUP BY conv_id) "


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, conversations, kind): turns with their numbers as labels of every second conversation."""
    held = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = read(spark, folder, "conversations").groupBy("conv_id").agg(held.alias("t"))
    said = F.transform("t", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"), F.when(F.col("conv_id") % 2 == 0, x["turn"].cast("string")).alias("label")))
    kind = F.when(F.col("conv_id") % 3 == 0, C.TEXT_TO_VALUE).when(F.col("conv_id") % 3 == 1, C.VALUE_TO_TEXT)
    return rows.select("conv_id", said.alias("conversations"), kind.alias("kind"))


@query("chat_normal_messages", TURNS + "SELECT conv_id, list_concat(CASE WHEN conv_id % 2 = 0 THEN ['system:be kind'] ELSE [] END, list_transform(ts, lambda x: lower(x.who) || ':' || x.said)) AS messages FROM m")
def normal_messages(spark: SparkSession, folder: str) -> DataFrame:
    system = F.when(F.col("conv_id") % 2 == 0, F.lit("be kind")).otherwise(F.lit(""))
    found = C.normal_messages(F.col("conversations"), system)
    return turns(spark, folder).select("conv_id", F.transform(found, lambda x: F.concat_ws(":", x["role"], x["content"])).alias("messages"))


@query(
    "chat_headed_rendering",
    TURNS
    + """, t AS (SELECT conv_id, ts[-1].who AS last, list_transform(ts, lambda x: '<extra_id_1>' || x.who || chr(10) || CASE WHEN conv_id % 3 = 1 AND conv_id % 2 = 0 THEN '<extra_id_2>' || x.turn || chr(10) ELSE '' END || x.said || chr(10) ||
    CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN '<extra_id_2>' || x.turn || chr(10) ELSE '' END) AS parts FROM m)
    SELECT conv_id, '<extra_id_0>System' || chr(10) || 'be kind' || chr(10) || array_to_string(parts, '') || CASE WHEN last = 'user' THEN '' ELSE '<extra_id_1>' END AS rendered FROM t""",
)
def headed(spark: SparkSession, folder: str) -> DataFrame:
    found = C.rendered(F.lit("be kind"), F.col("conversations"), F.col("kind"), F.lit("user"))
    return turns(spark, folder).select("conv_id", found.alias("rendered"))


WORDS = "list_transform(string_split({}, ' '), lambda x: CAST(length(x) AS BIGINT))"


@query(
    "record_truncated_parts",
    """WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n, len(string_split(text, chr(10))) AS m, doc_id % 7 AS a FROM documents), o AS (SELECT *, greatest(n + m + 2 + greatest(a, 4) + 3 - 200, 0) AS over FROM d),
    f AS (SELECT *, least(n, over // 2 + over % 2) AS cn, least(m, over // 2) AS cm FROM o), r AS (SELECT *, CASE WHEN over - cn - cm > 0 THEN over - cn - cm + least(a, 4) ELSE 0 END AS r0 FROM f),
    b AS (SELECT *, least(a, r0) AS ca, r0 - least(a, r0) AS r1 FROM r), c AS (SELECT *, least(m - cm, r1) AS xm, r1 - least(m - cm, r1) AS r2 FROM b), e AS (SELECT *, least(2, r2) AS xl, r2 - least(2, r2) AS r3 FROM c)
    SELECT doc_id, [n - cn - least(n - cn, r3), 2 - xl, m - cm - xm, a - ca]::BIGINT[] AS sizes FROM e""",
)
def truncated_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A text's words, two marks, its lines, and an answer of id % 7 tokens, within 200 tokens."""
    ones = lambda n: F.array_repeat(F.lit(1).cast("long"), n.cast("int"))
    parts = [("words", ones(F.size(F.split("text", " ", -1)))), (None, ones(F.lit(2))), ("lines", ones(F.size(F.split("text", "\n", -1)))), ("answer", ones(F.col("doc_id") % 7))]
    cut = R.truncated_parts(parts, ["words", "lines"], 200, 4, 3)
    return read(spark, folder, "documents").select("doc_id", F.array(*(F.size(x).cast("long") for x in cut)).alias("sizes"))


@query(
    "record_prompt_examples",
    f"""WITH s AS (SELECT doc_id, {WORDS.format("trim(text, ' ')")} AS c, {WORDS.format("lang")} AS a FROM documents), k AS (SELECT *, greatest(len(c) + 2 + len(a) + 4 - 120, 0) AS over FROM s)
    SELECT doc_id, list_concat(list_concat([CAST(-1 AS BIGINT), -3], c[1:len(c) - over]), list_concat(list_concat([CAST(0 AS BIGINT), 7], [CAST(-2 AS BIGINT)]), list_concat(a, [CAST(-3 AS BIGINT)]))) AS input_ids,
    CAST(5 + len(c) - over AS BIGINT) AS answer_start_idx, CAST(6 + len(c) - over + len(a) AS BIGINT) AS token_count FROM k""",
)
def prompt_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Records under a template, words as tokens, one place for a learnt token, in 120 tokens."""
    words = lambda x: F.transform(F.split(x, " ", -1), lambda w: F.length(w).cast("long"))
    rows = read(spark, folder, "documents").select("doc_id", "text", "lang")
    found = R.prompt_examples(rows, "{text} Answer:{lang}", words, 120, ["text"], "lang", -1, -2, -3, 1)
    return found.select("metadata.doc_id", "input_ids", "answer_start_idx", "token_count")


@query("example_image_conversations", "SELECT p_partkey, ['user/image:' || p_partkey || '.jpg', 'user/text:What is ' || p_name || '?', 'assistant/text:' || p_brand] AS parts FROM part")
def image_conversations(spark: SparkSession, folder: str) -> DataFrame:
    made = K.asked_image(F.concat("p_partkey", F.lit(".jpg")), F.concat(F.lit("What is "), "p_name", F.lit("?")), F.col("p_brand"))
    return read(spark, folder, "part").select("p_partkey", spelt(made).alias("parts"))


def spelt(conversation: F.Column) -> F.Column:
    """A conversation's parts as role/type:value."""
    return F.flatten(F.transform(conversation, lambda t: F.transform(t["content"], lambda p: F.concat(t["role"], F.lit("/"), p["type"], F.lit(":"), p["value"]))))


@query(
    "example_several_images",
    "SELECT s_suppkey, list_concat(list_transform(range(s_suppkey % 3), lambda k: 'user/image:' || k), ['user/text:' || s_name, 'assistant/text:' || s_nationkey]) AS parts FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 5 > 0",
)
def several_images(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with up to two images; those without an image or an answer go."""
    images = F.slice(F.array(F.lit("0"), F.lit("1")), F.lit(1), (F.col("s_suppkey") % 3).cast("int"))
    texts = F.array(F.struct(F.col("s_name").alias("user"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey").cast("string")).alias("assistant")))
    rows = read(spark, folder, "supplier").withColumn("images", images).withColumn("texts", texts)
    return K.several_images(rows, "images", "texts").select("s_suppkey", spelt(F.col("conversation")).alias("parts"))


@query("example_transcribed_audio", "SELECT replace(text, ' ', '') AS said, count(*) AS n FROM conversations GROUP BY 1")
def transcribed(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").withColumn("clip", F.array(F.lit(0.0)))
    made = K.transcribed_audio(rows, "clip", "text")
    return made.groupBy(F.col("conversation")[1]["content"][0]["value"].alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "batch_collated",
    D
    + """, k AS (SELECT id, id // 8 AS batch, ids, max(len(ids)) OVER (PARTITION BY id // 8) AS w FROM d),
    r AS (SELECT batch, id, list_concat(ids, list_transform(range(w - len(ids)), lambda x: CAST(0 AS BIGINT))) AS x,
      list_transform(range(w), lambda i: CAST(CASE WHEN i + 1 < len(ids) AND i + 1 >= 3 THEN ids[i + 2] ELSE -100 END AS BIGINT)) AS y FROM k)
    SELECT batch, list(x ORDER BY id) AS input_ids, list(y ORDER BY id) AS labels FROM r GROUP BY batch""",
)
def collated(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of eight documents, learnt from their fourth token on."""
    rows = tokens(spark, folder).select("id", F.expr("id div 8").alias("batch"), F.col("ids").alias("input_ids"), F.transform("ids", lambda _, i: (i >= 3).cast("long")).alias("loss_mask"))
    return V.collated(rows, "some processor", "batch", "id").select("batch", "input_ids", "labels")


@query("batch_modalities", "WITH d AS (SELECT doc_id, doc_id // 4 AS batch, lang, CASE WHEN doc_id % 3 = 0 THEN source END AS picture FROM documents) SELECT batch, list(lang ORDER BY doc_id) AS lang, CASE WHEN count(picture) > 0 THEN list(picture ORDER BY doc_id) FILTER (picture IS NOT NULL) END AS picture FROM d GROUP BY batch")
def modalities(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", F.expr("doc_id div 4").alias("batch"), "lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("picture"))
    return V.modalities_collated(rows, "batch", "doc_id", ["lang"], ["picture"])


@query(
    "job_split_layouts",
    """WITH h AS (SELECT o_orderkey, o_orderstatus, substr(md5(o_orderkey || '-1234'), 1, 8) < printf('%08x', CAST(floor(0.2 * 4294967296) AS BIGINT)) AS drawn FROM orders)
    SELECT 'from_train' AS layout, CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN drawn THEN 'validation' ELSE 'train' END) ELSE 'test' END AS split, count(*) AS n FROM h WHERE o_orderstatus <> 'P' GROUP BY 2
    UNION ALL SELECT 'from_validation', CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN drawn THEN 'validation' ELSE 'test' END, count(*) FROM h WHERE o_orderstatus <> 'P' GROUP BY 2""",
)
def split_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Finished orders as training rows, open ones as those of validation."""
    kind = F.when(F.col("o_orderstatus") == "F", "training").when(F.col("o_orderstatus") == "O", "val")
    splits = V.named_splits(read(spark, folder, "orders").select("o_orderkey", kind.alias("split")), "split")
    out = None
    for layout, from_train in (("from_train", True), ("from_validation", False)):
        for name, df in V.with_validation(splits, F.col("o_orderkey"), 0.2, from_train).items():
            one = df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(layout).alias("layout"), F.lit(name).alias("split"), "n")
            out = one if out is None else out.unionByName(one)
    return out


@query("job_multimodal", "SELECT split, count(*) AS n, 3 * count(*) AS placeholders, 16 * count(*) AS places FROM (VALUES ('train', 40), ('validation', 10), ('test', 5)) v(split, k), range(40) r(i) WHERE i < k GROUP BY split")
def multimodal(spark: SparkSession, folder: str) -> DataFrame:
    """Invented rows of each split: their number, placeholders and places."""
    from sparkprep.operators.builders import build

    parts = build(spark, V.Multimodal({"picture": (-7, 2), "sound": (-8, 1)}, 16, invented={"train": 40, "validation": 10, "test": 5}))
    out = None
    for name, df in parts.items():
        held = F.size(F.filter("input_ids", lambda x: x < 0))
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("placeholders"), F.sum(F.size("input_ids")).alias("places")).select(F.lit(name).alias("split"), "n", "placeholders", "places")
        out = one if out is None else out.unionByName(one)
    return out
