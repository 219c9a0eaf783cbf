"""Operators that SQL can't express, against plain loops; edge cases of the functions."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkprep.functions import arrays as A
from sparkprep.functions import text as T
from sparkprep.operators import packing as P
from sparkprep.operators import sampling as S
from sparkprep.operators import tensors as X
from sparkprep.sources import readers as R
from sparkprep.streaming import streams


def one(spark, expression, **values):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def longs(*values):
    return F.array(*(F.lit(v) for v in values)).cast("array<bigint>")


def slow_first_fit(lengths, capacity):
    bins = []
    for n in lengths:
        for held in bins:
            if sum(held) + n <= capacity:
                held.append(n)
                break
        else:
            bins.append([n])
    return bins


@pytest.mark.parametrize("seed", range(20))
def test_first_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([20, 50, 100])
    lengths = [r.randint(1, capacity + 5 * (seed % 3 == 0)) for _ in range(r.randint(0, 200))]
    assert P.first_fit(lengths, capacity) == slow_first_fit(lengths, capacity)
    plan, n = P.first_fit_decreasing(Counter(lengths), capacity)
    held = {}
    for length, first, bins, each in plan:
        for k in range(first, first + bins):
            held.setdefault(k, []).extend([length] * each)
    assert [sorted(held[k], reverse=True) for k in range(n)] == slow_first_fit(sorted(lengths, reverse=True), capacity)


def test_packing_of_rows(spark):
    r = random.Random(4)
    rows = [(i, n, list(range(n)), [1] * n) for i, n in enumerate(r.choice([3, 7, 7, 7, 12, 30]) for _ in range(300))]
    docs = spark.createDataFrame(rows, "id long, length long, input_ids array<int>, loss_mask array<int>")
    assigned = P.assign_bins(docs, 32).collect()
    bins = {}
    for row in assigned:
        bins.setdefault(row.bin, []).append(row.length)
    want = slow_first_fit(sorted((x[1] for x in rows), reverse=True), 32)
    assert Counter(tuple(sorted(x)) for x in bins.values()) == Counter(tuple(sorted(x)) for x in want)
    filled = P.fill(P.assign_bins(docs, 32))
    assert R.checked(filled).count() == len(want)
    assert P.assign_bins(docs.limit(0), 32).collect() == []
    odd = spark.createDataFrame([(1, 0, "a"), (2, None, "b"), (3, 5, "c"), (4, 9, "d"), (5, 0, None)], "id long, length long, kept string")
    assert {(r.id, r.length, r.kept) for r in P.assign_bins(odd, 10).collect()} == {(1, 0, "a"), (2, None, "b"), (3, 5, "c"), (4, 9, "d"), (5, 0, None)}
    assert {r.id: r.bin for r in P.assign_bins(odd, 10).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    assert {r.bin for r in P.assign_bins(odd.where("length = 0"), 10).collect()} == {0}
    with pytest.raises(Exception, match="longer than the histogram"):
        P.length_histogram(docs, F.col("length"), 20).collect()


def test_fill_rolls_masks_to_labels(spark):
    rows = [(1, [1, 2, 3, 4], [0, 0, 1, 1], 2, 4, 0), (2, [7, 8], [1, 1], 1, 2, 0), (3, [9], [1], 0, 1, 1)]
    held = spark.createDataFrame(rows, "id long, input_ids array<int>, loss_mask array<int>, answer long, length long, bin long")
    found = {r.bin: (r.input_ids, r.loss_mask, r.seq_start_id) for r in P.fill(held).collect()}
    assert found == {0: ([1, 2, 3, 4, 7, 8], [0, 1, 1, 0, 1, 0], [0, 4]), 1: ([9], [0], [0])}
    found = {r.bin: r.loss_mask for r in P.fill(held.drop("loss_mask"), answer_start="answer").collect()}
    assert found == {0: [0, 1, 1, 1, 1, 1], 1: [1]}
    with pytest.raises(ValueError, match="neither"):
        P.fill(held.drop("loss_mask"))


def test_first_fit_in_shuffled_order(spark):
    rows = [(i, 1 + i * 7 % 40) for i in range(500)]
    found = P.first_fit_shuffled(spark.createDataFrame(rows, "id long, length long"), 64, seed=2, block=200).collect()
    order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}-2-shuffle".encode()).hexdigest())
    want = []
    for k in range(0, 500, 200):
        waiting = {}
        for i, n in order[k : k + 200]:
            waiting.setdefault(n, []).append(i)
        want += [(k // 200, b, waiting[n].pop(0), n) for b, held in enumerate(slow_first_fit([n for _, n in order[k : k + 200]], 64)) for n in held]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_array_edges(spark):
    assert one(spark, A.next_labels(longs())) == []
    assert one(spark, A.running_sums(longs())) == [0] and one(spark, A.running_sums(F.lit(None).cast("array<bigint>"))) is None
    sums = spark.range(40).select("id", A.running_sums(F.transform(F.sequence(F.lit(1), F.col("id") % 7 + 1), lambda x: x.cast("long"))).alias("s")).collect()
    assert all(r.s == [k * (k + 1) // 2 for k in range(r.id % 7 + 2)] for r in sums)
    assert one(spark, A.replace_with_copies(longs(1, 9, 9, 2, 9), 9, longs(2, 0, 1))) == [1, 9, 9, 2, 9] and one(spark, A.replace_with_copies(longs(), 9, longs())) == []
    assert one(spark, A.segment_masks(longs(1, 1, 0, 1, 1), longs(5, 6, 7, 8, 2), longs(0, 3, 5), False, 2)) == [1, 1, 1]
    assert one(spark, A.find_array_from(longs(1, 2), longs(1, 2, 1, 2), F.lit(1))) == (2, 4) and one(spark, A.find_array_from(longs(), longs(1), F.lit(0))) == (-1, -1)
    assert one(spark, A.runs(longs())) == []
    assert one(spark, A.truncate(longs(1, 2, 3), 0)) == []
    assert one(spark, A.truncate(longs(1, 2, 3), 2, "left")) == [2, 3]
    assert one(spark, A.find_array(longs(1, 3), longs(2, 3, 1, 3))) == 2
    assert one(spark, A.find_array(longs(3, 2), longs(2, 3, 1, 3))) == -1
    assert one(spark, A.find_array(longs(1, 2, 3), longs(1))) == -1
    assert one(spark, A.find_array_last(longs(3), longs(3, 1, 3))) == 2 and one(spark, A.find_array(longs(), longs(4))) == 0
    assert one(spark, A.cut_at_padding(longs(0, 5, 9, -1, -1))) == [0, 5, 9]
    assert one(spark, A.positions_by_segment(longs(0, 2, 5))) == [0, 1, 0, 1, 2]
    assert [one(spark, A.ceil_to_power_of_two(F.lit(n))) for n in (0, 1, 2, 3, 8, 9)] == [1, 1, 2, 4, 8, 16]
    assert not one(spark, A.valid_row(longs(1, 2), longs(1), longs(0)))
    assert not one(spark, A.valid_row(longs(1, 2), longs(1, 1), longs(0, 2)))
    assert one(spark, A.has_bad_value(F.array(F.lit(1.0), F.lit(float("nan")))))


def test_text_edges(spark):
    assert one(spark, T.unboxed(F.lit(r"a \boxed{x^{2}} b \boxed{{{{{{7}}}}}}"))) == "a x^{2} b {{{{{7}}}}}"
    assert one(spark, T.unboxed(F.lit(r"a \boxed{1} b \boxed{2 c"))) == r"a 1 b \boxed{2 c"
    assert one(spark, T.unboxed(F.lit(r"a \frac{1}{2}"))) == r"a \frac{1}{2}"
    assert one(spark, T.before_last(F.lit("no mark"), "\\boxed")) == ""
    assert one(spark, T.final_answer(F.lit("so 3\n#### 42 "))) == "42"
    assert one(spark, T.clean(F.lit("a &amp;amp;  b\n c &eacute;&#8217; "))) == "a & b c é’"
    assert one(spark, T.metric_key(F.lit("mem@max//rank_1/x:y é/{}"))) == "mem_at_max/rank_1_x:y é___"
    assert one(spark, T.file_stem_key(F.lit("clip1_10.5_20"))) == "clip1_10.5_20" and one(spark, T.file_stem_key(F.lit("clip1_10.5_20.25"))) == "clip1"
    assert [one(spark, T.expert_index(F.lit(x))) for x in ("local_experts.3", "experts.3.weight7", "a.experts.4", "experts.1.bias2")] == [3, 7, 4, 2]
    with pytest.raises(Exception, match="no expert number"):
        one(spark, T.expert_index(F.lit("mlp.w")))
    assert [one(spark, T.absolute_path(F.lit(x), "/r/m")) for x in ("a/../b.jpg", "./x", "/y/../z", "http://h/p", "../../../q")] == ["/r/m/b.jpg", "/r/m/x", "/y/../z", "http://h/p", "/q"]
    for template in ("no field", "{label} and more", "{label}\n"):
        with pytest.raises(ValueError, match="label"):
            T.template_parts(template)
    assert one(spark, T.without_marks(F.lit("<image>\n"), ("<image>",))) == "\n" or one(spark, T.without_marks(F.lit("<image>"), ("<image>",))) is None
    with pytest.raises(KeyError):
        T.render("{a}{label}", {"a": F.lit(1)})
    assert one(spark, T.render("{a} is {b}", {"a": F.lit(1), "b": F.lit(None).cast("string")}, "b")) == "1 is "
    assert T.template_parts("Q: {input} A: {label}") == [("text", "Q:"), ("field", "input"), ("text", " A:"), ("field", "label")]


def test_global_batches_deal_ranks_in_turn(spark):
    rows = S.global_batches(spark, 16, 0, 8, 4, 2).orderBy("idx").collect()
    by = {}
    for r in rows:
        by.setdefault((r.rank, r.step), []).append(r.idx)
    assert by == {(0, 0): [0, 2, 4, 6], (0, 1): [8, 10, 12, 14], (1, 0): [1, 3, 5, 7], (1, 1): [9, 11, 13, 15]}
    padded = S.global_batches(spark, 10, 0, 8, 4, 2, "pad").collect()
    assert len(padded) == 16 and sum(r.is_padding for r in padded) == 6
    with pytest.raises(ValueError, match="multiple"):
        S.global_batches(spark, 10, 0, 6, 4, 2)


def test_blend_follows_weights(spark):
    rows = S.blended(spark, [5, 3, 2], 101).orderBy("at").collect()
    assert len(rows) == 101
    for n in (20, 50, 101):
        got = Counter(r.dataset for r in rows[:n])
        assert all(abs(got[i] - n * w / 10) <= 1.5 for i, w in enumerate([5, 3, 2]))


def test_qkv_round_trip(spark):
    rows = spark.range(96).select(F.col("id"), *(c.alias(n) for c, n in zip(X.qkv_part(F.col("id"), 8, 2, 8), ("part", "own"))))
    back = F.when(F.col("part") == "q", X.qkv_place(F.col("own"), 8, 2, 8, "q")).when(F.col("part") == "k", X.qkv_place(F.col("own"), 8, 2, 8, "k")).otherwise(X.qkv_place(F.col("own"), 8, 2, 8, "v"))
    assert rows.where(back != F.col("id")).count() == 0


def test_packed_reader_checks(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/odd.parquet")
    with pytest.raises(ValueError, match="no columns"):
        R.packed_rows(spark, f"{tmp_path}/odd.parquet")
    bad = spark.createDataFrame([([1, 2], [1], [0])], "input_ids array<int>, loss_mask array<int>, seq_start_id array<int>")
    with pytest.raises(Exception, match="broken"):
        R.checked(bad).collect()
    assert R.is_packed_path("A.IDX.PARQUET") and not R.is_packed_path("a.parquet")


def test_packed_stream_packs_all_rows(spark, tmp_path):
    rows = [(i % 3 and 1, i, 1 + i % 9) for i in range(37)]
    spark.createDataFrame(rows, "g long, k long, n long").repartition(5, "k").write.parquet(f"{tmp_path}/in")
    arriving = streams.file_stream(spark, f"{tmp_path}/in", 2)
    streams.packed_stream(arriving, "g", "k", "n", 16, 8, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = streams.packed_rows(spark, "g", "k", "n", 16, f"{tmp_path}/out").collect()
    size, group = {k: n for _, k, n in rows}, {k: g for g, k, _ in rows}
    assert sorted(k for r in found for k in r.ids) == list(range(37))
    assert all(r.total == sum(size[k] for k in r.ids) <= 16 and {group[k] for k in r.ids} == {r.g} for r in found)
    assert {r.batch for r in found} >= {-1, 0}


def test_shuffled_batches_lie_in_order(spark, tmp_path):
    spark.range(300).repartition(4, "id").write.parquet(f"{tmp_path}/in")
    streams.shuffled_batches(streams.file_stream(spark, f"{tmp_path}/in", 2), "id", 3, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").select("id", "order_key", "batch", F.col("_metadata.file_path").alias("f")).collect()
    assert sorted(r.id for r in found) == list(range(300))
    for name in {r.f for r in found}:
        held = [r.order_key for r in found if r.f == name]
        assert held == sorted(held)


def test_builders(spark):
    from sparkprep.operators import builders as D

    rows = spark.createDataFrame([(i, [1] * (1 + i % 7), [1] * (1 + i % 7)) for i in range(200)], "id long, input_ids array<int>, loss_mask array<int>")
    parts = D.build(spark, D.TuningData(rows, F.col("id") >= 20, packing=D.PackingConfig(16), seed=1, most={"validation": 3}))
    assert parts["test"].columns == ["id", "input_ids", "loss_mask"]
    assert R.checked(parts["train"]).count() == parts["train"].count() > 0
    assert parts["validation"].agg(F.sum(F.size("seq_start_id"))).first()[0] == 3
    with pytest.raises(KeyError):
        D.build(spark, object())
    with pytest.raises(ValueError, match="idx.parquet"):
        D.PackingConfig(8, packed_path="rows.parquet")
    assert (D.source_kind("a/x.idx.parquet"), D.source_kind("x.jsonl", True), D.source_kind("x.jsonl")) == ("packed", "chat", "records")
    assert (D.split_weights(None), D.split_weights(["a"]), D.split_weights(["a"], True)) == ("1,1,1", "9999,8,2", None)


def test_searched_mask_goes_forward(spark):
    from sparkprep.operators.examples import searched_mask

    ids = longs(1, 2, 3, 1, 2, 9)
    two = F.array(longs(1, 2), longs(7, 7), longs(1, 2))
    assert one(spark, searched_mask(ids, two)) == [1, 1, 0, 1, 1, 0]


def test_keyed_rank_equals_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    key = S.keyed(F.col("id"), 4)
    plain = rows.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(key, "id")) - 1)
    assert S.keyed_rank(plain, "g", key, "id").where("rank <> want").count() == 0
