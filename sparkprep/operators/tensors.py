"""Tables of named tensors in long form (name, row, col, value), and packed arrays: cutting, interleaving, quantising, merging.

Long form keeps every operator a projection or an equi-join, so a weight of any size spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The 16 values of a 4-bit float with 2 exponent bits and 1 mantissa bit (fixed by the format).
FP4_VALUES = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, -0.0, -0.5, -1.0, -1.5, -2.0, -3.0, -4.0, -6.0]


def column_shard(row: Column, rows: int, ranks: int) -> tuple[Column, Column]:
    """(rank, row there) when dimension 0 of ``rows`` rows is cut evenly; rows beyond a multiple pad the last rank."""
    each = -(-rows // ranks)
    return F.floor(row / each).cast("long"), (row % each).cast("long")


def unshard(rank: Column, row: Column, rows: int, ranks: int) -> Column:
    """The row before ``column_shard``."""
    return (rank * -(-rows // ranks) + row).cast("long")


def qkv_place(row: Column, heads: int, groups: int, dim: int, part: str) -> Column:
    """Where a row of the query, key or value matrix stands in the interleaved one: by group its queries, key and value."""
    each = heads // groups
    head = F.floor(row / dim).cast("long")
    block = (each + 2) * dim
    if part == "q":
        return (F.floor(head / each) * block + head % each * dim + row % dim).cast("long")
    return (head * block + (each + int(part == "v")) * dim + row % dim).cast("long")


def qkv_part(row: Column, heads: int, groups: int, dim: int) -> tuple[Column, Column]:
    """(part, row there) of a row of the interleaved matrix: the inverse of ``qkv_place``."""
    each = heads // groups
    block = (each + 2) * dim
    group, inside = F.floor(row / block).cast("long"), row % block
    slot = F.floor(inside / dim).cast("long")
    part = F.when(slot < each, "q").when(slot == each, "k").otherwise("v")
    own = F.when(slot < each, group * each * dim + inside).otherwise(group * dim + inside % dim)
    return part, own.cast("long")


def gated_qkv_place(row: Column, heads: int, groups: int, dim: int, part: str) -> Column:
    """Where a row stands when every group has its queries, their gates, key and value. Parts are q, g (a gate row for each head row), k and v."""
    each = heads // groups
    head, block = F.floor(row / dim).cast("long"), (2 * each + 2) * dim
    if part in "qg":
        return (F.floor(head / each) * block + (head % each + (each if part == "g" else 0)) * dim + row % dim).cast("long")
    return (head * block + (2 * each + int(part == "v")) * dim + row % dim).cast("long")


def cut_kind(module: Column, fixed: dict[str, str] | None = None) -> Column:
    """How a module's weights are cut over ranks, by its class name: column, row or replicated; ``fixed`` names exceptions. An unknown one is an error."""
    kind = F.when(module.rlike("ColumnParallel|VocabParallelEmbedding|DotProductAttention|CrossEntropy"), "column").when(module.contains("RowParallel"), "row").when(module.rlike("Norm|Router|^IdentityOp$|LinearForLastLayer"), "replicated")
    for name, value in (fixed or {}).items():
        kind = F.when(module == name, value).otherwise(kind)
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("no known way to cut "), module)).cast("string"))


def cut_place(kind: Column, row: Column, col: Column, rows: int, cols: int, ranks: int) -> Column:
    """The rank that holds a cell of a weight by its kind; null where every rank does, as for vectors of row-cut modules."""
    by_row, by_col = column_shard(row, rows, ranks)[0], column_shard(col, cols, ranks)[0]
    return F.when(kind == "column", by_row).when((kind == "row") & F.lit(cols > 1), by_col)


def unstacked(stacks: DataFrame, group: str, values: str) -> DataFrame:
    """(group, index, value): the parts of stacked experts, each a row."""
    return stacks.select(group, F.posexplode(values).alias("index", "value")).select(group, F.col("index").cast("long").alias("index"), "value")


def transposed(matrix: DataFrame) -> DataFrame:
    """(row, col, value) with rows and columns exchanged."""
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def kv_place(row: Column, dim: int, part: str) -> Column:
    """Where a row of keys or values stands when the groups alternate."""
    return ((F.floor(row / dim) * 2 + int(part == "v")) * dim + row % dim).cast("long")


def gate_up_place(row: Column, rows: int, ranks: int, part: str) -> Column:
    """Where a row of the gate or up matrix stands when every rank holds its gate rows and then its up rows."""
    each = rows // ranks
    return (F.floor(row / each) * 2 * each + (each if part == "up" else 0) + row % each).cast("long")


def interleave_place(row: Column, rows: int, block: int) -> Column:
    """Two halves of ``rows`` rows dealt out in blocks: half 0's block, half 1's block, and so on."""
    half = rows // 2
    inside = row % half
    return (F.floor(inside / block) * 2 * block + F.floor(row / half) * block + inside % block).cast("long")


def int4_quantise(values: Column) -> Column:
    """struct<scale, packed>: eight 4-bit numbers in each int32, the least place first; scale is the magnitude / 7, not under 1e-10."""
    scale = F.greatest(F.array_max(F.transform(values, lambda x: F.abs(x.cast("double")))) / 7, F.lit(1e-10))

    def packed(v: Column) -> Column:
        small = lambda i: F.coalesce(F.greatest(F.least(F.rint(F.get(v["x"], i).cast("double") / v["s"]), F.lit(7.0)), F.lit(-8.0)).cast("long") + 8, F.lit(0).cast("long"))
        word = lambda w: sum((F.shiftleft(small(w * 8 + k), 4 * k) for k in range(1, 8)), small(w * 8))
        return F.struct(v["s"].alias("scale"), F.transform(F.sequence(F.lit(0), F.floor((F.size(v["x"]) - 1) / 8).cast("int")), word).alias("packed"))

    return F.transform(F.array(F.struct(values.alias("x"), scale.alias("s"))), packed)[0]


def int4_dequantise(packed: Column, scale: Column, size: Column) -> Column:
    """The values that ``int4_quantise`` packed."""
    nibbles = lambda w: F.array(*(F.shiftright(w, 4 * k).bitwiseAND(F.lit(15)) for k in range(8)))
    return F.transform(F.slice(F.flatten(F.transform(packed, nibbles)), F.lit(1), size), lambda x: (x - 8) * scale)


def fp4_dequantise(packed: Column, exponent: Column) -> Column:
    """Bytes of two 4-bit floats, the low half first, times 2 ** (exponent - 127)."""
    values = F.array(*map(F.lit, FP4_VALUES))
    pairs = F.transform(packed, lambda b: F.array(F.element_at(values, (b % 16 + 1).cast("int")), F.element_at(values, (F.floor(b / 16) % 16 + 1).cast("int"))))
    return F.transform(F.flatten(pairs), lambda x: x * F.pow(F.lit(2.0), exponent - 127))


def block_dequantise(values: DataFrame, scales: DataFrame, block: int = 128) -> DataFrame:
    """(name, row, col, value) times the scale of its block: scales are (name, block_row, block_col, scale)."""
    placed = values.withColumns({"block_row": F.floor(F.col("row") / block).cast("long"), "block_col": F.floor(F.col("col") / block).cast("long")})
    return placed.join(scales, ["name", "block_row", "block_col"]).select("name", "row", "col", (F.col("value") * F.col("scale")).alias("value"))


def multiplied(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of the product of two matrices in long form: an equi-join on the inner place, then a sum."""
    right = b.select(F.col("row").alias("k"), F.col("col"), F.col("value").alias("w"))
    left = a.select("row", F.col("col").alias("k"), F.col("value").alias("v"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


def low_rank_merged(base: DataFrame, b: DataFrame, a: DataFrame, alpha: float, rank: int) -> DataFrame:
    """base + alpha / rank * (b x a)."""
    added = multiplied(b, a).withColumn("value", F.col("value") * (alpha / rank))
    return base.unionByName(added).groupBy("row", "col").agg(F.sum("value").alias("value"))


def row_norms(matrix: DataFrame) -> DataFrame:
    """(row, norm)."""
    return matrix.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def stacked(parts: DataFrame, group: str, index: str, value: str, number: int) -> DataFrame:
    """(group, values): the parts of each group in the order of their index, for groups that have all ``number`` of them."""
    held = parts.groupBy(group).agg(F.count_distinct(index).alias("n"), F.array_sort(F.collect_list(F.struct(index, value))).alias("p"))
    return held.where(F.col("n") == number).select(group, F.transform("p", lambda x: x[value]).alias("values"))


def compared(a: Column, b: Column) -> dict[str, Column]:
    """Largest and mean difference and the cosine of two arrays."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    return {
        "max_difference": F.array_max(F.transform(pairs, lambda p: F.abs(p["x"] - p["y"]))),
        "mean_difference": total(lambda p: F.abs(p["x"] - p["y"])) / F.size(a),
        "cosine": total(lambda p: p["x"] * p["y"]) / F.sqrt(total(lambda p: p["x"] * p["x"]) * total(lambda p: p["y"] * p["y"])),
    }


def shard_files(files: DataFrame, name: str, savers: int) -> DataFrame:
    """Adds ``saver``: file i in the order of names goes to saver i mod savers. A list of files, not of rows."""
    place = F.row_number().over(Window.orderBy(name)).cast("long") - 1
    return files.withColumn("saver", place % savers)


def head_major_place(row: Column, heads: int, parts: list[int]) -> Column:
    """Where a row of flat components (each ``heads`` x its size) stands when every head has its part of each together."""
    each = sum(parts)
    out, begin, inside = None, 0, 0
    for size in parts:
        here = row - begin
        place = F.floor(here / size) * each + inside + here % size
        out = F.when(row < begin + heads * size, place) if out is None else out.when(row < begin + heads * size, place)
        begin, inside = begin + heads * size, inside + size
    return out.cast("long")


def component_shard(row: Column, sizes: list[int], ranks: int) -> tuple[Column, Column]:
    """(rank, row there) when every component of stacked ones is cut evenly over the ranks by itself."""
    rank = own = None
    begin = before = 0
    for size in sizes:
        each = size // ranks
        here = row - begin
        inside = row < begin + size
        r, o = F.floor(here / each), before + here % each
        rank, own = (F.when(inside, r), F.when(inside, o)) if rank is None else (rank.when(inside, r), own.when(inside, o))
        begin, before = begin + size, before + each
    return rank.cast("long"), own.cast("long")


def global_expert(local: Column, rank: Column, each: int) -> Column:
    """An expert's number over all ranks."""
    return (rank * each + local).cast("long")


def fanned_out(rows: DataFrame, name: str, targets: list[str]) -> DataFrame:
    """Each row under several names: the last part of its name replaced by each target."""
    stem = F.regexp_replace(name, r"[^.]*$", "")
    return rows.withColumn(name, F.explode(F.array(*(F.concat(stem, F.lit(t)) for t in targets))))


def prefixed_adapters(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    """Adapter parameters alone, under a prefix, with ``place``: their order under each parent."""
    parent = F.regexp_replace(name, r"\.[^.]*\.[^.]*$", "")
    place = F.row_number().over(Window.partitionBy(parent).orderBy(name)).cast("long") - 1
    return rows.where(F.col(name).rlike(r"\.(?:lora|adapter)")).withColumns({"place": place, "full_name": F.concat(F.lit(prefix), name)})


def shared_norm(rows: DataFrame, name: str, group: Column, value: Column) -> DataFrame:
    """(group, norm) over different parameters: one that several ranks hold counts once."""
    held = rows.groupBy(name, group.alias("group")).agg(F.max(value).alias("v"))
    return held.groupBy("group").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def zero_centred(weights: Column) -> Column:
    """Weights of a norm as they are stored around 0: less 1."""
    return F.transform(weights, lambda x: x - 1)


def from_zero_centred(stored: Column) -> Column:
    """Weights of a norm from those stored around 0."""
    return F.transform(stored, lambda x: x + 1)
