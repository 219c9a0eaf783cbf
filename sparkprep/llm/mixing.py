"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents that belong to the same set of sources form one pattern. The driver sees patterns alone: their words, and the
sources' targets. A pattern sends words to its sources over three arcs of its size each, for the first, second and third
copy, whose costs rise (convex), so repetition comes only when fresh words are short. The flow of least cost that fills the
quotas says how many words of each pattern are taken. Every document of a pattern is taken as often as the flow fills the
pattern's size; for the remainder, documents are selected in the order of a seeded hash. A histogram of the hash finds the
bucket in which the remainder ends, only that bucket is sorted, and last the document whose size fits the rest best is added.
Selections follow from the seed and the data alone, so reruns agree.

The driver plans for up to ``MAX_PATTERNS`` patterns. Where there are more, the flow falls apart into parts that share no
source, so it is solved in parts: a source whose documents belong to no other takes its quota, which needs no driver, and
the flow over patterns of several sources, and what shares a source with them, is still the driver's. Targets are then found by rounds
of sums over the sources. More than ``MAX_PATTERNS`` patterns within that last part are an error; sources may be any number.

Null texts have no words; documents without words are taken 0 words. A null source is a source, the last in order. Rows that
repeat a doc_id within a pattern are selected together. Texts of any length count whole. An empty table gives no rows.
Columns other than doc_id, text and source pass through ``mixed`` and are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import arrow_rows, materialise, text_bytes
from sparkprep.llm.sharding import numbered

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: The cost of a word's first, second and third copy.
COPY_COSTS = (0, 1, 3)
#: Different sets of sources that the driver plans for at once.
MAX_PATTERNS = 4096
SEED = 42
#: Buckets of the selecting hash for each pattern.
BUCKET_BITS = 12
KEYS = ["copies", "cut_bucket", "cut_r", "cut_doc", "fill_r", "fill_doc"]


def targets(sizes: list[int], weights: list[int], total: int, most: int = MAX_COPIES) -> list[Fraction]:
    """Shares of ``total`` by weight, none over ``most`` times its size; what is over goes to the others by weight."""
    out = [Fraction(0)] * len(sizes)
    left, free = Fraction(total), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] > weight * most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in full)
        free -= set(full)
    return out


def flow(patterns: list[tuple[int, list[int]]], quotas: list[int], costs: tuple[int, ...] = COPY_COSTS) -> list[int]:
    """Words taken from each pattern (size, its sources) by the cheapest of the largest flows into the sources' quotas.

    Successive shortest paths with potentials. The cost of a word depends only on the copy that it is.
    """
    p, s = len(patterns), len(quotas)
    source, sink = p + s, p + s + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(p + s + 2)]

    def arc(a: int, b: int, room: int, price: int) -> None:
        for x, y, c, q in ((a, b, room, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            cap.append(c)
            cost.append(q)

    for i, (size, members) in enumerate(patterns):
        for price in costs:
            arc(source, i, size, price)
        for j in members:
            arc(i, p + j, size * len(costs), 0)
    for j, quota in enumerate(quotas):
        arc(p + j, sink, quota, 0)
    potential = [0] * len(out)
    while True:
        best, via = {source: 0}, {}
        queue = [(0, source)]
        while queue:
            d, at = heapq.heappop(queue)
            if d > best[at]:
                continue
            for e in out[at]:
                if cap[e] and (nd := d + cost[e] + potential[at] - potential[to[e]]) < best.get(to[e], nd + 1):
                    best[to[e]], via[to[e]] = nd, e
                    heapq.heappush(queue, (nd, to[e]))
        if sink not in best:
            break
        for node, d in best.items():
            potential[node] += min(d, best[sink])
        for node in range(len(out)):
            if node not in best:
                potential[node] += best[sink]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        step = min(cap[e] for e in path)
        for e in path:
            cap[e] -= step
            cap[e ^ 1] += step
    taken = [0] * p
    for e in out[source]:
        taken[to[e]] += cap[e ^ 1]
    return taken


def sized(docs: DataFrame, members: F.Column | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, pattern, members, size, r): words of the whole text, the sources as JSON, and the selecting hash."""
    belongs = F.array_sort(F.array_distinct(members if members is not None else F.array(F.col("source").cast("string"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            words = [len(x.split()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.int64())], ["doc_id", "members", "size"])

    counted = docs.select(F.col("doc_id").cast("long"), belongs.alias("members"), text_bytes()).mapInArrow(run, "doc_id long, members array<string>, size long")
    return counted.select("doc_id", F.to_json("members").alias("pattern"), "members", "size", seeded("doc_id", seed).alias("r"))


def seeded(doc_id: str, seed: int = SEED) -> F.Column:
    """60 bits of an MD5 of the id and the seed, which SQL engines can repeat."""
    text = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket_of(r: str) -> F.Column:
    return F.shiftright(r, 60 - BUCKET_BITS)


#: What is planned for a pattern: its first source's size and target, copies of each document, and words to take once more.
CELLS = "pattern string, source_size long, target double, copies long, rest long"


def planned(found: list[Row], weights: tuple[int, ...]) -> list[tuple]:
    """``CELLS`` of all patterns (pattern, members, size), by one flow."""
    found = sorted(found, key=lambda r: r["pattern"])
    names = sorted({m for r in found for m in r["members"]}, key=lambda x: (x is None, x or ""))
    at = {m: i for i, m in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for m in r["members"]:
            sizes[at[m]] += r["size"]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(r["size"] for r in found))
    taken = flow([(r["size"], [at[m] for m in r["members"]]) for r in found], [round(x) for x in wanted])
    return [(r["pattern"], sizes[k := at[r["members"][0]]] if r["members"] else 0, float(wanted[k]) if r["members"] else 0.0, *divmod(n, max(r["size"], 1))) for r, n in zip(found, taken)]


def source_targets(patterns: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) of any number of sources, by rounds of sums in which sources over their limit become full."""
    sizes = patterns.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked, _ = numbered(materialise(sizes.withColumn("last", F.col("source").isNull()), "sources"), ["last", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    total = patterns.agg(F.sum("size")).first()[0] or 0
    rows = materialise(ranked.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "sources")
    while True:
        gone, free = rows.agg(F.sum(F.when(F.col("full"), MAX_COPIES * F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        left, free = total - (gone or 0), free or 1
        wide = lambda x: x.cast("decimal(38,0)")
        over = wide(F.lit(left)) * F.col("weight") > wide(F.lit(free)) * (MAX_COPIES * F.col("source_size"))
        if not rows.where(~F.col("full") & over).limit(1).count():
            target = F.when(F.col("full"), (MAX_COPIES * F.col("source_size")).cast("double")).otherwise((F.lit(left) * F.col("weight")).cast("double") / free)
            return rows.select("source", "source_size", target.alias("target"))
        rows = materialise(rows.withColumn("full", F.col("full") | over), "sources")


def planned_in_parts(patterns: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``CELLS`` of all patterns: sources by themselves without a flow, the others by one on the driver."""
    spark = patterns.sparkSession
    wanted = materialise(source_targets(patterns, weights), "targets")
    several = patterns.where(F.size("members") != 1)
    shared = materialise(several.select(F.explode("members").alias("source")).distinct().withColumn("shared", F.lit(True)), "shared")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    single = patterns.where(F.size("members") == 1).withColumn("source", F.col("members")[0])
    joined = single.join(shared, same(single, shared), "left").drop(shared["source"])
    alone = joined.where("shared is null").drop("shared")
    quota = F.rint("target").cast("long")
    cells = alone.join(wanted, same(alone, wanted)).select("pattern", "source_size", "target", F.expr("cast(rint(target) as long) div greatest(size, 1)").alias("copies"), (quota % F.greatest("size", F.lit(1))).alias("rest"))
    rest = several.unionByName(joined.where("shared").select("pattern", "members", "size")).limit(MAX_PATTERNS + 1).collect()
    if len(rest) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources that share one")
    of = {r["source"]: r for r in wanted.join(shared, same(wanted, shared), "left_semi").collect()}
    rest, names = sorted(rest, key=lambda r: r["pattern"]), list(of)
    at = {m: i for i, m in enumerate(names)}
    taken = flow([(r["size"], [at[m] for m in r["members"]]) for r in rest], [round(of[m]["target"]) for m in names])
    first = lambda r: of[r["members"][0]] if r["members"] else {"source_size": 0, "target": 0.0}
    more = [(r["pattern"], first(r)["source_size"], first(r)["target"], *divmod(n, max(r["size"], 1))) for r, n in zip(rest, taken)]
    return cells.unionByName(spark.createDataFrame(more, CELLS)) if more else cells


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each pattern: source_size and target (those of its first source), copies, and what is selected once more.

    ``cut_r``/``cut_doc``: the last selected key (hash, doc_id) in hash order; ``fill_r``/``fill_doc``: the key added last.
    """
    spark = rows.sparkSession
    patterns = materialise(rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")), "patterns")
    if patterns.count() <= MAX_PATTERNS:
        held = spark.createDataFrame(planned(patterns.collect(), weights), CELLS)
    else:
        held = planned_in_parts(patterns, weights)
    held = materialise(held, "cells")

    units = rows.join(held, "pattern").where("rest > 0").groupBy("pattern", "r", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest")).where("size > 0")
    units = materialise(units.withColumn("bucket", bucket_of("r")), "units")
    sums = units.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket"))  # 4,096 buckets of a pattern at most
    cut = sums.withColumn("before", running - F.col("words")).where("before <= rest and before + words > rest").select("pattern", F.col("bucket").alias("cut_bucket"), "before")
    cut = materialise(cut, "cuts")
    inside = units.join(cut, "pattern").where("bucket = cut_bucket")
    total = F.sum("size").over(Window.partitionBy("pattern").orderBy("r", "doc").rowsBetween(Window.unboundedPreceding, 0))
    ends = inside.withColumn("gone", F.col("before") + total).where("gone <= rest").groupBy("pattern").agg(F.max(F.struct("r", "doc")).alias("last"), F.max("gone").alias("gone"))
    ends = cut.join(ends, "pattern", "left").select("pattern", "cut_bucket", F.coalesce("gone", "before").alias("gone"), F.col("last.r").alias("cut_r"), F.col("last.doc").alias("cut_doc"))
    ends = materialise(ends, "ends")
    free = units.join(ends, "pattern").where("bucket > cut_bucket or bucket = cut_bucket and (cut_r is null or r > cut_r or r = cut_r and doc > cut_doc)")
    gap = F.col("rest") - F.col("gone")
    fill = free.where(F.abs(F.col("size") - gap) < gap).groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "r", "doc")).alias("x"))
    ends = ends.join(fill, "pattern", "left").select("pattern", "cut_bucket", "cut_r", "cut_doc", F.col("x.r").alias("fill_r"), F.col("x.doc").alias("fill_doc"))
    return materialise(held.drop("rest").join(ends, "pattern", "left"), "plan")


def with_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` (pattern, doc_id, r) with the plan's columns and ``copies`` as each row is taken."""
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bucket = bucket_of("r")
    before = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & ((F.col("r") < F.col("cut_r")) | ((F.col("r") == F.col("cut_r")) & (doc <= F.col("cut_doc")))))
    added = (F.col("r") == F.col("fill_r")) & (doc == F.col("fill_doc"))
    more = F.coalesce(before, F.lit(False)) | F.coalesce(added, F.lit(False))
    return rows.join(planned, "pattern").withColumn("copies", F.col("copies") + more.cast("int"))


def mix(docs: DataFrame, members: F.Column | None = None, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row for each row of ``docs``; taken counts words with repeats."""
    rows = materialise(sized(docs, members, seed), "sized")
    return with_copies(rows, plan(rows, weights)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` by source, each as often as the mix takes it, with the columns it has."""
    planned = plan(materialise(sized(docs, None, seed), "sized"), weights).select("pattern", *KEYS)
    own = {"pattern": F.to_json(F.array(F.col("source").cast("string"))), "r": seeded("doc_id", seed), "doc_id": F.col("doc_id").cast("long")}
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), *(x.alias(c) for c, x in own.items()))
    taken = with_copies(rows, planned).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
