"""Operators that SQL can't express or that have many branches, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkprep.functions import media as M
from sparkprep.operators import chat as C
from sparkprep.operators import examples as E
from sparkprep.operators import joins as J
from sparkprep.operators import loaders as L
from sparkprep.operators import makers as K
from sparkprep.operators import metrics as Q
from sparkprep.operators import providers as V
from sparkprep.operators import records as R
from sparkprep.operators import sampling as S
from sparkprep.operators.builders import build
from sparkprep.sources import readers, states


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def longs(values):
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def words(x):
    return F.filter(F.split(F.regexp_replace(x, "(<[a-z]>|\\n)", " $1 "), " +"), lambda w: w != "")


MARKS = C.Marks("<s>", "<t>", "<l>", "\n", "\n")


def plain_mask(system, turns, kind, who):
    """Which words of a rendered conversation are learnt from, turn by turn."""
    split = lambda x: [w for w in re.sub(r"(<[a-z]>|\n)", r" \1 ", x).split(" ") if w]
    head = split(f"<s>System\n{system}\n")
    out, ids = [0] * len(head), list(head)
    for i, (speaker, value, label) in enumerate(turns):
        mark = f"<l>{label}\n" if label is not None and kind else ""
        text = f"<t>{speaker}\n" + (mark if kind == "VALUE_TO_TEXT" else "") + f"{value}\n" + (mark if kind == "TEXT_TO_VALUE" else "")
        tokens, name = split(text), len(split(f"<t>{speaker}\n"))
        skip = name
        if "<l>" in tokens:
            skip = tokens.index("\n", name) + 1 if kind == "VALUE_TO_TEXT" else tokens.index("<l>") + 1
        mask = [1] * len(tokens)
        if i == 0 and kind in (None, "VALUE_TO_TEXT"):
            hidden = (0, len(tokens))
        elif speaker in who and (i > 1 or i == 1 and kind == "TEXT_TO_VALUE"):
            hidden = (1, len(tokens))
        elif speaker in who:
            hidden = (0, len(tokens))
        else:
            hidden = (0, skip)
        for k in range(*hidden):
            mask[k] = 0
        out, ids = out + mask, ids + tokens
    if turns[-1][0] not in who:
        out, ids = out + [1], ids + ["<t>"]
    return ids, out


def test_learnt_tokens_of_conversations(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        kind = [None, "TEXT_TO_VALUE", "VALUE_TO_TEXT"][i % 3]
        turns = [(("User", "Assistant")[k % 2], " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 5))), f"q{k}" if rnd.random() < 0.6 else None) for k in range(rnd.randint(2, 5))]
        rows.append((i, "be kind", turns, kind, "User"))
        want[i] = plain_mask("be kind", turns, kind, "User")
    df = spark.createDataFrame(rows, "i long, system string, conversations array<struct<from: string, value: string, label: string>>, kind string, mask string")
    made = C.preprocessed(F.col("system"), F.col("conversations"), F.col("kind"), F.col("mask"), lambda x: F.transform(words(x), lambda w: F.hash(w).cast("long")), MARKS)
    text = C.rendered(F.col("system"), F.col("conversations"), F.col("kind"), F.col("mask"), MARKS)
    found = df.select("i", words(text).alias("w"), made["loss_mask"].alias("m"), made["context_size"].alias("c"), made["labels"].alias("y"), made["input_ids"].alias("x")).collect()
    for r in found:
        ids, mask = want[r.i]
        assert (r.w, r.m) == (ids, mask)
        assert r.c == max(k + 1 for k, m in enumerate(mask) if not m) and r.y == [x if m else -100 for x, m in zip(r.x, mask)]
    with pytest.raises(Exception, match="nothing is learnt"):
        df.limit(1).select(C.preprocessed(F.lit(""), F.col("conversations"), F.col("kind"), F.lit("Nobody"), lambda x: F.transform(words(x), lambda w: F.hash(w).cast("long")), MARKS)["labels"]).collect()
    with pytest.raises(Exception, match="no such type"):
        one(spark, C.known_kind(F.lit("OTHER")))


def plain_truncation(sizes, own, most, room, extra, side):
    """The parts' sizes after truncation, step by step."""
    sizes, answer = list(sizes), sizes[-1]
    over = sum(sizes[:-1]) + max(answer, room) + extra - most
    if over <= 0:
        return sizes
    shares = [over // len(own) + (i < over % len(own)) for i in range(len(own))] if own else []
    for i, share in zip(own, shares):
        cut = min(sizes[i], share)
        sizes[i] -= cut
        over -= cut
    if over > 0:
        over += min(answer, room) if side == "right" else 0
        for i in range(len(sizes)) if side == "left" else reversed(range(len(sizes))):
            cut = min(sizes[i], over)
            sizes[i] -= cut
            over -= cut
    return sizes


@pytest.mark.parametrize("side", ["left", "right"])
def test_truncated_parts(spark, side):
    rnd = random.Random(5)
    rows = [tuple(rnd.randint(0, 12) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    for fields, own in ((["a", "c"], [0, 2]), (["b"], [1]), ([], [])):
        parts = [(n, F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda x: x.cast("long"))) for n in "abcd"]
        cut = R.truncated_parts(parts, fields, 20, 3, 2, side)
        for r in df.select("*", *(x.alias(f"x{i}") for i, x in enumerate(cut))).collect():
            want = plain_truncation(r[:4], own, 20, 3, 2, side)
            assert [len(x) for x in r[4:]] == want
            assert all(x == (list(range(1, n + 1))[:k] if side == "right" else list(range(1, n + 1))[n - k :]) for x, n, k in zip(r[4:], r[:4], want))


def test_mixed_positions(spark):
    rnd = random.Random(6)
    for _ in range(12):
        ids, images, videos, want, at = [], [], [], [], 0
        for _ in range(rnd.randint(0, 4)):
            for _ in range(rnd.randint(0, 3)):
                ids.append(1)
                want.append((at,) * 3)
                at += 1
            t, h, w = (1, 2 * rnd.randint(1, 3), 2 * rnd.randint(1, 3)) if rnd.random() < 0.6 else (2, 4, 2)
            token = 8 if t == 1 else 9
            (images if t == 1 else videos).append((t, h, w))
            for _ in range(t):
                ids += [token] * (h // 2 * w // 2)
                want += [(at, at + y, at + x) for y in range(h // 2) for x in range(w // 2)]
                at += max(1, h // 2, w // 2)
                if t > 1:  # the frames of a video stand apart
                    ids.append(2)
                    want.append((at,) * 3)
                    at += 1
        ids.append(3)
        want.append((at,) * 3)
        df = spark.createDataFrame([(ids, images, videos)], "ids array<long>, i array<struct<t: int, h: int, w: int>>, v array<struct<t: int, h: int, w: int>>")
        assert [tuple(p) for p in df.select(M.mixed_positions(F.col("ids"), 8, 9, F.col("i"), F.col("v")).alias("p")).first().p] == want


def test_adjusted_runs_by_plain_steps(spark):
    rnd = random.Random(7)
    for _ in range(10):
        ids, sizes = [], []
        for _ in range(3):
            ids += [5] * rnd.randint(0, 2) + [1] + [7] * rnd.randint(1, 4) + [2]
            sizes.append(rnd.randint(0, 8))
        want, other = list(ids), list(range(len(ids)))
        for k, n in enumerate(sizes):
            a, b = [i for i, x in enumerate(want) if x == 1][k], [i for i, x in enumerate(want) if x == 2][k]
            if n > b - a + 1:
                more = n + 2 - (b - a + 1)
                want[a + 1 : a + 1], other[a + 1 : a + 1] = [7] * more, [7] * more
            elif n < b - a + 1:
                gone = [i for i in range(a, b + 1) if want[i] == 7][n:]
                want, other = ([x for i, x in enumerate(xs) if i not in gone] for xs in (want, other))
        found = M.adjusted_runs(longs(ids), longs(sizes), 1, 2, longs(range(len(ids))))
        assert one(spark, F.struct(*(x.alias(f"x{i}") for i, x in enumerate(found)))) == (want, other)


def test_infilled_documents(spark):
    flip = lambda x, key: F.concat(longs([-1]), F.reverse(x))
    made = lambda ids, **o: one(spark, R.infilled_tokens(longs(ids), F.lit(1), 0, 99, flip, **o))
    assert made([1, 2, 0, 3, 4]) == [-1, 2, 1, 0, -1]
    assert made([0, 1, 0, 0, 2]) == [-1, 1, 0, -1, 2]
    assert made([5, 6, 7]) == [-1, 7, 6]
    assert made([1, 7, 2, 0, 3], fragment=7, whole_rate_hex="zz") == [-1, 1, 7, -1, 2]
    assert made([1, 7, 2, 0, 3], fragment=7, whole_rate_hex="00")[:4] == [1, 7, 2, 0]


def test_names_and_states(spark, tmp_path):
    names = spark.createDataFrame([("a.w",), ("a.b.w",), ("b.w1",), ("a.[x]",)], "name string")
    got = lambda p: sorted(r.name for r in J.matching_names(names, "name", p).collect())
    assert got("a.w") == ["a.w"] and got("w") == [] and got("*.w") == ["a.b.w", "a.w"] and got(re.compile("b\\.w")) == ["a.b.w", "b.w1"]
    assert got("[ab].w*") == ["a.w", "b.w1"] and got("[!a].w?") == ["b.w1"]
    with pytest.raises(KeyError):
        J.matching_names(names, "name", "no.such", required=True)
    assert J.any_match(names, "name", "b.*") and not J.any_match(names, "name", "c.*")
    with pytest.raises(KeyError, match="b.w1"):
        J.require_present(names, names.where("name <> 'b.w1'"), "name")
    from sparkprep.sources.archives import serialised
    import numpy as np

    (tmp_path / "x-1.safetensors").write_bytes(serialised({"a": np.ones(2), "b": np.zeros(3)}))
    (tmp_path / "x-2.safetensors").write_bytes(serialised({"b": np.ones(3), "c": np.ones(1)}))
    source = states.FileSource(spark, str(tmp_path))
    assert {(r.name, r.file) for r in source.names().collect()} == {("a", "x-1.safetensors"), ("b", "x-2.safetensors"), ("c", "x-2.safetensors")}
    assert [r["values"] for r in source.load("b").collect()] == [[1.0] * 3] and source.has("c*") and not source.has("d*")
    with pytest.raises(KeyError, match="missing"):
        source.load(["a", "zz"])
    (tmp_path / states.INDEX).write_text('{"weight_map": {"b": "x-1.safetensors"}}')
    assert [r["values"] for r in source.load("*").collect()] == [[0.0] * 3]
    plan = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("c", "f2"), ("d", "f2")], "name string, file string")
    held = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "name string, values array<double>")
    assert {(r.file, r.name) for r in states.whole_shards(held, plan).collect()} == {("f1", "a"), ("f1", "b")}
    assert states.whole_shards(held, plan, False).count() == 3 and [tuple(r) for r in states.unwritten(held, plan).collect()] == [("f2", ["d"])]
    with pytest.raises(KeyError, match="not in the plan"):
        states.whole_shards(held.unionByName(held.limit(1).withColumn("name", F.lit("z"))), plan)
    assert '"total_size": 12' in states.written_index(states.whole_shards(held, plan, False))


def test_readers_of_folders(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/p/a.parquet")
    assert len(readers.resolved(spark, f"{tmp_path}/p/*.parquet")) == 1
    with pytest.raises(ValueError, match="no Parquet files"):
        readers.resolved(spark, f"{tmp_path}/p/none*.parquet")
    files = spark.createDataFrame([("a", 0, 4), ("b", 5, 9)], "file string, first long, last long")
    assert {(r.id, r.file, r.row_in_file) for r in readers.places(spark.range(3, 7), "id", files).collect()} == {(3, "a", 3), (4, "a", 4), (5, "b", 0), (6, "b", 1)}
    schema = "name string, n long"
    found = lambda d: sorted((r.name, r.n) for r in readers.metadata(spark, str(tmp_path / d), schema, ("jpg",)).collect())
    for d, text in (("json", '[{"name": "x", "n": 1}]'), ("lines", '{"name": "y", "n": 2}\nbroken\n{"name": "z"}\n'), ("scan", None)):
        (tmp_path / d).mkdir()
        if text:
            (tmp_path / d / "meta.json").write_text(text)
        (tmp_path / d / "a.JPG").write_bytes(b"1")
        (tmp_path / d / "b.txt").write_bytes(b"1")
    assert found("json") == [("x", 1)] and found("lines") == [("y", 2), ("z", None)] and found("scan") == [("a.JPG", None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1").write_text("a\nb")
    (tmp_path / "t" / "2").write_text("c\n")
    readers.merge_text_files(spark, f"{tmp_path}/t/*", f"{tmp_path}/merged", 1)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/merged").collect()) == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, "q", "a")], "id long, q string, a string")
    readers.write_json_lines(rows, f"{tmp_path}/out", {"id": F.col("id"), "qa": F.struct("q", "a")})
    assert spark.read.json(f"{tmp_path}/out").first().qa == ("a", "q")


def test_loaders(spark):
    for kind in ("single", "cyclic", "batch"):
        plan = L.loader(spark, kind, 100, 0, 2, 3, global_batch=12).collect()
        assert {r["rank"] for r in plan} == {0, 1, 2} and len({r.idx for r in plan}) == len(plan) == 96
    halves = L.loader(spark, "cyclic", 96, 48, 2, 3, sharding=False).collect()
    first = L.loader(spark, "cyclic", 96, 0, 2, 3, sharding=False).where("step < 8").collect()
    assert {r.idx for r in halves} | {r.idx for r in first} == set(range(96)) and len(halves) == 48
    assert L.loader(spark, "external", 5, 0, 1, 1) is None
    with pytest.raises(ValueError, match="no loader"):
        L.loader(spark, "other", 5, 0, 1, 1)
    with pytest.raises(ValueError, match="global batch"):
        L.loader(spark, "batch", 5, 0, 1, 1)
    with pytest.raises(ValueError, match="fewer than a global batch"):
        L.split_loaders(spark, L.Training(1, 8), {"train": 7})
    training = L.Training(10, 8, 1, 2, 5, 2, 4)
    assert training.counts() == (80, 24, 8)
    plans = L.iterated(L.split_loaders(spark, training, {"train": 16, "validation": 4}), "cyclic", 3)
    assert plans["test"] is None and plans["train"].agg(F.max("step")).first()[0] == 23
    rows = spark.range(16).withColumnRenamed("id", "n")
    held = L.pulled(rows, L.loader(spark, "single", 16, 0, 4, 2), F.col("n"), 2).collect()
    assert {(r.idx % 4 // 2) for r in held if r.micro_batch == 1} == {1}
    assert L.shared(rows, [lambda d: d.count(), lambda d: d.agg(F.sum("n")).first()[0]]) == [16, 120]
    mapping = S.block_mapping(spark, 10, 25, 4, 1, truncate=True)
    assert sorted(r.position for r in mapping.collect()) == list(range(24)) and S.position(mapping, 24, -1) == mapping.where("position = 23").first()["sample"]
    with pytest.raises(IndexError):
        S.position(mapping, 24, 24)
    assert S.blends(["0.3", "a", "0.7", "b"]) == {None: (["a", "b"], [0.3, 0.7])} and S.parsed_blend(["a", "b"]) == (["a", "b"], None)
    assert S.blends(None, {"train": ["a"], "test": ["1", "b"]}) == {"train": (["a"], None), "test": (["b"], [1.0])} and S.blends() == {}
    with pytest.raises(ValueError, match="either one"):
        S.blends(["a"], {"train": ["b"]})
    plain = S.block_mapping(spark, 10, 10, 4, 1, shuffle=False)
    assert [r["sample"] for r in S.positions(plain, 10, None, None, -3).orderBy("nth").collect()] == [9, 6, 3, 0] and S.positions(plain, 10, 5, 5).count() == 0


def test_makers_and_providers(spark):
    rows = spark.createDataFrame([("i", "q", "a", [[1.0, 3.0], [2.0, 2.0]])], "image string, question string, answer string, wave array<array<double>>")
    parts = build(spark, V.Conversations({"train": rows}, "medical", {"image": "image", "question": "question", "answer": "answer"}))
    assert parts["train"].first().conversation[0].content[0] == ("image", "i")
    assert K.spoken(rows.withColumn("rate", F.lit(16)), "wave", "rate", "answer", "Say it.").first().audio.samples == [2.0, 2.0]
    with pytest.raises(ValueError, match="training split"):
        K.several_images(rows, "image", "answer", "test")
    with pytest.raises(ValueError, match="no maker"):
        K.maker("other")
    mock = build(spark, V.configured("conversations-mock", n=5, images=2))
    assert mock["test"].count() == 5 and len(mock["train"].first().conversation[0].content) == 3
    assert mock["train"].first().conversation[1] != mock["test"].first().conversation[1]
    assert sum(x.count() for x in build(spark, V.configured("pretrain-mock", invented=30)).values()) == 30
    with pytest.raises(ValueError, match="no dataset type"):
        V.configured("other")
    with pytest.raises(ValueError, match="don't fit"):
        build(spark, V.Multimodal({"a": (1, 9)}, 4, invented={"train": 1}))
    encoder = V.Encoder(lambda d: d.withColumn("x", F.col("id") * 2), lambda d, b: d.groupBy(b).agg(F.sort_array(F.collect_list("x")).alias("xs")), lambda d: d.withColumn("n", F.size("xs")))
    assert {r.batch: (r.xs, r.n) for r in encoder.run(spark.range(5), F.col("id"), 2).collect()} == {0: ([0, 2], 2), 1: ([4, 6], 2), 2: ([8], 1)}
    held = spark.createDataFrame([(0, 1, [1, 2, 3], [2, 3], ["p"]), (0, 2, [4, 5], [9], None)], "batch long, id long, input_ids array<long>, answer array<long>, images array<string>")
    found = V.collated(held.withColumn("loss_mask", longs([1, 1, 1])), "Qwen3VLProcessor", "batch", "id").first()
    assert found.media == ["p"] and found.input_ids == [[1, 2, 3], [4, 5, 0]]
    found = V.collated(held, "audio", "batch", "id").first()
    assert found.labels == [[2, 3, -100], [-100, -100, -100]]


def test_answers_and_tags(spark):
    said = lambda text: one(spark, E.thinking_and_final(F.lit(text), F.lit("4")))[0]
    assert (said("So $\\boxed{4}$").thinking, said("So $\\boxed{4}$").content) == ("So", "#### 4")
    assert said("no box \n").thinking == "no box" and said("a \\boxed{1} b $ \\boxed{4}").thinking == "a 1 b"
    assert said("a \\boxed{1} b \\boxed{4").thinking == "a 1 b \\boxed{4"
    assert E.tagged_text({"b": [1, {"c": None}], "a": True}) == "<s_b>1<sep/><s_c>None</s_c></s_b><s_a>True</s_a>"
    assert E.tagged_text({"text_sequence": "x"}) == "x"
    assert [tuple(one(spark, F.struct(*(x.alias(n) for x, n in zip(M.fitted(F.lit(1000), F.lit(337), 640, 480, fill), "wh"))))) for fill in (False, True)] == [(640, 215), (1424, 480)]
    assert one(spark, M.lettered(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: x.cast("string")))).endswith("\nL. 12")


def test_curves(spark):
    rows = [(i, 3.0 - i / 50, (3.0 - i / 50) * (1.2 if i == 99 else 1.01)) for i in range(100)]
    pairs = spark.createDataFrame(rows, "step long, golden double, now double")
    found = Q.convergence(pairs, "step", "now", "golden").first()
    assert not found.passed and abs(found.final_difference - 0.2) < 1e-9 and abs(found.failed_share - 0.01) < 1e-9
    assert Q.convergence(pairs.where("step < 99"), "step", "now", "golden").first().passed
    nan = pairs.withColumn("now", F.when(F.col("step") == 50, F.lit(float("nan"))).otherwise(F.col("now")))
    assert abs(Q.regression(nan.where("step < 99"), "step", "now", "golden").first().difference - 0.01) < 1e-3
    with pytest.raises(Exception, match="several ranks"):
        Q.adapter_facts(spark.createDataFrame([("a", 1), ("a", 2)], "t string, r long"), "t", "r").collect()
    with pytest.raises(Exception, match="no rows"):
        Q.packed_averages(spark.createDataFrame([], "s array<long>, n long, id long"), "s", F.col("n"), "id").collect()
    lines = spark.createDataFrame([(1, "iteration 1/ 9 | lm loss: 2.5E+00 | mem-max-reserved-gigabytes: 3 mem-max-reserved-gigabytes: 5"), (2, "mem-allocated-gigabytes: 1.5"), (3, "iteration 2/ 9 | lm loss: 2.0")], "n long, line string")
    assert [tuple(r) for r in Q.log_series(lines, "n", "line", "lm loss").orderBy("step").collect()] == [(0, 2.5), (1, 2.0)]
    assert Q.log_series(lines, "n", "line", "max_reserved").first().value == 5 and Q.log_series(lines, "n", "line", "alloc").first().value == 1.5


def test_progress_log(spark):
    line = lambda t, world, event, work=0: f"{t}\tJob ID: 7\t# GPUs: {world}\t{event}\tIteration: 1\tJob throughput: 1\tCumulative throughput: 1\tFloating-point operations: {work:.2e}\tTokens: 1"
    lines = ["a Starting job 4", "b Saved checkpoint 4 1e3", "c Starting job 8", "d Saving async checkpoint 8 2e3", "e Starting job 8", "f Saved async checkpoint 8", "g Saved async checkpoint 8", "h Starting job 8", "i Saving async checkpoint 8 9e3"]
    rows = []
    for i, x in enumerate(lines):
        t, *event = x.split(" ")
        work = float(event.pop()) if "e" in event[-1] and event[-1][0].isdigit() else 0
        rows.append((i, line(t, event.pop(), " ".join(event), work)))
    df = spark.createDataFrame(rows, "n long, line string")
    assert tuple(Q.job_start(df, "n", "line", 8).first()) == ("c", 1000.0, 2000.0)
    assert Q.job_start(df, "n", "line", 4).first().start is None
    assert tuple(Q.job_start(df.where("n < 2"), "n", "line", 4).first()) == ("a", 0.0, 1000.0)


def test_states_of_loaders_and_metadata_of_packing(spark, tmp_path):
    from sparkprep.operators import batches as B
    from sparkprep.operators import packing as P

    L.saved_state(spark, f"{tmp_path}/s", {"train": 64, "test": 0})
    assert L.restored_state(spark, f"{tmp_path}/s") == {"train": 64, "test": 0}
    rows = spark.createDataFrame([(i, 4, [1] * 4, [1] * 4) for i in range(6)], "id long, length long, input_ids array<int>, loss_mask array<int>")
    for k in range(2):
        P.write_with_metadata(rows, 8, f"{tmp_path}/p{k}", f"{tmp_path}/meta")
    found = spark.read.json(f"{tmp_path}/meta").collect()
    assert len(found) == 2 and {(r.pack_size, r.packing_factor, r.max_per_bin) for r in found} == {(8, 2.0, 2)}
    held = rows.select("id", "input_ids", F.lit(0).cast("long").alias("bin"), F.array("id", "id").alias("shape"))
    merged = B.selected_and_merged(held.where("id < 2"), "id", "input_ids", "shape").first()
    assert merged["keys"] == "0,1" and len(merged["values"]) == 8 and merged.shape == [[0, 0], [1, 1]]
    names = spark.createDataFrame([("fc1", "l.0"), ("norm", "")], "name string, prefix string")
    assert E.unmatched_patterns(names, "name", "prefix", ["fc1", "*.1.*", "l.*"]) == ["*.1.*"]
    padded = lambda n: one(spark, M.padded_vectors(F.lit([[1.0, 2.0], [3.0, 4.0]]), n))
    assert padded(3) == [[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]] and padded(1) == [[1.0, 2.0]]


def test_archives_as_a_provider(spark, tmp_path):
    from sparkprep.sources.archives import tar_shards

    rows = spark.createDataFrame([("a", "txt", b"1", 0), ("a", "jpg", b"2", 0), ("b", "wav", b"3", 0)], "key string, extension string, content binary, shard long")
    (tmp_path / "0.tar").write_bytes(bytes(tar_shards(rows, "key", "shard").first().content))
    parts = build(spark, V.Archives({"train": str(tmp_path)}, lambda d: d.select("key", "kind")))
    assert sorted(map(tuple, parts["train"].collect())) == [("a", "image"), ("a", "raw"), ("b", "audio")]
