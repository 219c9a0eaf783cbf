"""Column expressions over token arrays: padding, truncation, masks, labels, boundaries and searches.

All stay in the JVM but for running sums, which take Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORE = -100


def long(x: Column) -> Column:
    return x.cast("long")


def upto(n: Column) -> Column:
    """1 to n; nothing for an n under 1 (a sequence would run backwards)."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def ceil_to_multiple(n: Column, multiple: int) -> Column:
    """The least multiple that is not under ``n``."""
    return long(F.ceil(n / multiple)) * multiple


def ceil_to_power_of_two(n: Column) -> Column:
    """The least power of two that is not under ``n`` (1 for n of at most 1)."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L").bitwiseOR(F.lit(0)) * long(F.pow(2, F.length(F.bin(n - 1)))))


def rounded(a: Column, digits: int) -> Column:
    """Doubles rounded in binary, as C does it: halves of the product go away from zero, and what is rounded to zero keeps its sign.

    ``F.round`` takes the shortest decimal that a double prints as, which has no negative zero and no binary halves.
    """
    scale = 10.0**digits

    def step(x: Column) -> Column:
        whole = F.rint(x * scale)
        away = F.when(F.abs(x * scale - whole) == 0.5, x * scale + 0.5 * F.signum(x)).otherwise(whole) / scale
        return F.when(F.abs(away) < math.inf, away).otherwise(x)

    return F.transform(a, step)


def pad_right(a: Column, size: Column | int, pad: int) -> Column:
    """``a`` with ``pad`` put behind until it has ``size`` items; longer arrays stay."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(size - F.size(a), F.lit(0)).cast("int")).cast("array<bigint>"))


def pad_or_cut(a: Column, size: int, pad: int, most: int | None = None) -> Column:
    """``a`` padded to ``size``; cut only if it is longer than ``most`` (``size`` if not given)."""
    return pad_right(F.slice(a, 1, most or size), size, pad)


def truncate(a: Column, size: int, side: str = "right") -> Column:
    """``right`` keeps the first ``size`` items, ``left`` the last; 0 keeps none."""
    if size == 0:
        return F.slice(a, 1, 0)
    return F.slice(a, 1, size) if side == "right" else F.slice(a, F.greatest(F.size(a) - size + 1, F.lit(1)), F.lit(size))


def answer_mask(a: Column, answer_start: Column) -> Column:
    """1 from place ``answer_start`` (0-based), 0 before."""
    return F.transform(a, lambda _, i: (i >= answer_start).cast("long"))


def packed_mask(a: Column, answer_start: Column) -> Column:
    """The mask of a packed example: shifted left by one, the last place 0."""
    return F.transform(a, lambda _, i: ((i >= answer_start - 1) & (i < F.size(a) - 1)).cast("long"))


def packed_mask_of(mask: Column) -> Column:
    """A mask as its labels need it: shifted left by one, the last place 0."""
    shifted = F.concat(F.slice(mask.cast("array<bigint>"), F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0))), F.array(F.lit(0).cast("long")))
    return F.when(F.size(mask) > 0, shifted).otherwise(mask.cast("array<bigint>"))


def next_labels(a: Column, ignore: int = IGNORE) -> Column:
    """Next-token labels: shifted left, the last one ignored."""
    return F.when(F.size(a) > 0, F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.lit(ignore).cast("long")))).otherwise(a)


def masked_labels(labels: Column, mask: Column, ignore: int = IGNORE) -> Column:
    """Labels, ignored where the mask is 0."""
    return F.zip_with(labels, mask, lambda x, m: F.when(m == 0, F.lit(ignore).cast("long")).otherwise(x))


def stands_at(needle: Column, haystack: Column, place: Column) -> Column:
    """Whether ``needle`` stands at a 1-based place; its first item is looked at before a piece is cut out. An empty one stands everywhere."""
    return (F.size(needle) == 0) | (F.get(haystack, place - 1) == F.get(needle, F.lit(0))) & (F.slice(haystack, place, F.size(needle)) == needle)


def find_array(needle: Column, haystack: Column) -> Column:
    """First 0-based place of ``needle`` in ``haystack``, -1 if there is none."""
    places = upto(F.size(haystack) - F.size(needle) + 1)
    hits = F.filter(places, lambda p: stands_at(needle, haystack, p))
    return F.when(F.size(needle) > F.size(haystack), F.lit(-1).cast("long")).otherwise(long(F.coalesce(F.try_element_at(hits, F.lit(1)) - 1, F.lit(-1))))


def find_array_last(needle: Column, haystack: Column) -> Column:
    """Last 0-based place of ``needle`` in ``haystack``, -1 if there is none."""
    places = upto(F.size(haystack) - F.size(needle) + 1)
    hits = F.filter(places, lambda p: stands_at(needle, haystack, p))
    return F.when(F.size(needle) > F.size(haystack), F.lit(-1).cast("long")).otherwise(long(F.coalesce(F.try_element_at(hits, F.lit(-1)) - 1, F.lit(-1))))


@F.arrow_udf(T.ArrayType(T.LongType()))
def running_sums(lengths: pa.Array) -> pa.Array:
    """0 and the running sums: the boundaries of sequences of these lengths.

    SQL has no running sum over an array but by work that grows with its square; here all arrays of a batch are summed at once.
    """
    items, n = lengths.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False), len(lengths)
    sizes = np.array(pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    total = np.r_[0, np.cumsum(items)]
    row = np.repeat(np.arange(n), sizes + 1)
    place = np.arange(len(row)) - row  # the place among all items: each row before this one has one boundary more than items
    sums = total[place] - total[(ends - sizes)[row]]
    offsets = np.r_[0, np.cumsum(sizes + 1)].astype(np.int32)
    mask = pc.is_null(lengths) if lengths.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums, pa.int64()), mask=mask)


def boundary_lengths(boundaries: Column) -> Column:
    """Differences of neighbouring boundaries."""
    return F.transform(upto(F.size(boundaries) - 1), lambda i: F.element_at(boundaries, (i + 1).cast("int")) - F.element_at(boundaries, i.cast("int")))


def cut_at_padding(boundaries: Column, pad: int = -1) -> Column:
    """The boundaries before the first ``pad``."""
    at = F.array_position(boundaries, F.lit(pad).cast("long"))
    return F.when(at > 0, F.slice(boundaries, F.lit(1), (at - 1).cast("int"))).otherwise(boundaries)


def positions_by_segment(boundaries: Column) -> Column:
    """Position ids that restart at each boundary."""
    return F.flatten(F.transform(boundary_lengths(boundaries), lambda n: F.transform(upto(n.cast("int")), lambda x: long(x) - 1)))


def zigzag_rank(position: Column, n: Column | int, ranks: int) -> Column:
    """The rank that holds a position when ``n`` places are cut into ``2 ranks`` chunks and rank r takes chunks r and 2 ranks - 1 - r."""
    chunk = long(F.floor(position / (n / (2 * ranks))))
    return F.least(chunk, F.lit(2 * ranks - 1) - chunk)


def replace_with_copies(a: Column, token: int, counts: Column) -> Column:
    """The k-th ``token`` in ``a`` becomes counts[k] copies of it."""
    at = lambda x: F.filter(F.transform(x, lambda y, i: F.when(y == token, i)), lambda i: i.isNotNull())
    # Each place of the token ends a piece of the array; pieces don't overlap, so the work is linear.
    before = lambda v, k: F.when(k > 0, F.get(v["at"], k - 1) + 1).otherwise(0)
    piece = lambda v, p, k: F.concat(F.slice(v["a"], before(v, k) + 1, p - before(v, k)), F.array_repeat(F.get(v["a"], p), F.get(v["n"], k).cast("int")))
    rest = lambda v: F.slice(v["a"], before(v, F.size(v["at"])) + 1, F.size(v["a"]))
    whole = lambda v: F.concat(F.flatten(F.transform(v["at"], lambda p, k: piece(v, p, k))), rest(v))
    return F.transform(F.array(F.struct(a.alias("a"), at(a).alias("at"), counts.alias("n"))), whole)[0]


def find_array_from(needle: Column, haystack: Column, start: Column) -> Column:
    """struct<begin, end> of the first place of ``needle`` from place ``start`` on, end exclusive; both -1 without one, or for an empty needle."""
    places = F.filter(upto(F.size(haystack) - F.size(needle) + 1), lambda p: (p > start) & stands_at(needle, haystack, p))
    at = long(F.coalesce(F.try_element_at(places, F.lit(1)) - 1, F.lit(-1)))
    found = F.when(F.size(needle) > 0, at).otherwise(F.lit(-1).cast("long"))
    return F.struct(found.alias("begin"), F.when(found >= 0, found + F.size(needle)).otherwise(F.lit(-1)).cast("long").alias("end"))


def sequence_counts(starts: Column, total: Column) -> tuple[Column, Column]:
    """The tokens of each sequence of a packed row without its end token, and of all: boundaries are ``starts`` and the row's end."""
    counts = F.transform(boundary_lengths(F.concat(starts.cast("array<bigint>"), F.array(long(total)))), lambda n: n - 1)
    return counts, long(total) - F.size(starts)


def segment_masks(mask: Column, ids: Column, boundaries: Column, answer_only: bool = True, end: int = 0) -> Column:
    """A packed row's mask without the last place of each segment: its own mask, or 1 but where ``ids`` holds the end token."""
    values = mask.cast("array<bigint>") if answer_only else F.transform(ids, lambda x: (x != end).cast("long"))
    cut = lambda v: F.flatten(F.transform(upto(F.size(v["b"]) - 1), lambda i: F.slice(v["m"], (F.element_at(v["b"], i) + 1).cast("int"), F.greatest(F.element_at(v["b"], i + 1) - F.element_at(v["b"], i) - 1, F.lit(0)).cast("int"))))
    return F.transform(F.array(F.struct(values.alias("m"), boundaries.alias("b"))), cut)[0]


def pad_or_cut_positions(positions: Column, size: int, most: int) -> Column:
    """Position ids that go on counting from their number up to ``size``; cut only if there are more than ``most``."""
    more = F.when(F.size(positions) < size, F.transform(F.sequence(F.size(positions), F.lit(size - 1)), long)).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(positions) < size, F.concat(positions.cast("array<bigint>"), more)).when(F.size(positions) > most, F.slice(positions, 1, most)).otherwise(positions)


def uniform_size(size: Column, tensor: int, context: int = 1, eights: bool = False) -> Column:
    """The length that all rows of a batch are padded to: a multiple of the ranks, twice so for context ranks, and of 16 for 8-bit floats."""
    multiple = tensor * context * 2 if context > 1 else tensor
    return ceil_to_multiple(size, math.lcm(multiple, 16) if eights else multiple)


def segment_zigzag(boundaries: Column, rank: int, ranks: int) -> Column:
    """The places of a packed row that a context rank holds: of each segment the r-th of 2 ``ranks`` chunks and its mirror image."""

    def places(b: Column, i: Column) -> Column:
        begin, size = F.element_at(b, i), F.element_at(b, i + 1) - F.element_at(b, i)
        each = F.floor(size / (2 * ranks))
        chunk = lambda k: F.when(each > 0, F.sequence(begin + each * k, begin + each * (k + 1) - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.concat(chunk(rank), chunk(2 * ranks - 1 - rank))

    return F.transform(F.array(boundaries.cast("array<bigint>")), lambda b: F.flatten(F.transform(upto(F.size(b) - 1), lambda i: places(b, i))))[0]


def kept_without(ids: Column, mask: Column) -> Column:
    """The items where a mask is 1."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("x"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["x"])


def micro_part(a: Column, k: int, parts: int) -> Column:
    """The k-th of ``parts`` pieces that follow one another and are as long as the first, but for the last."""
    each = F.ceil(F.size(a) / parts).cast("int")
    return F.slice(a, each * k + 1, each)


def has_bad_value(a: Column, most: float = 1000.0) -> Column:
    """Whether an array holds NaN, infinity or a magnitude over ``most``."""
    return F.exists(a, lambda x: F.isnan(x) | (F.abs(x) > most))


def runs(a: Column) -> Column:
    """Runs of equal neighbours as array<struct<start, end, value>>, end exclusive."""
    starts = F.filter(upto(F.size(a)), lambda i: (i == 1) | (F.element_at(a, i) != F.element_at(a, F.greatest(i - 1, F.lit(1)))))
    # The starts are bound once; a lambda that named them would work them out again for each run.
    spans = lambda s: F.transform(
        s, lambda i, k: F.struct(long(i - 1).alias("start"), long(F.coalesce(F.try_element_at(s, (k + 2).cast("int")) - 1, F.size(a))).alias("end"), F.element_at(a, i).alias("value"))
    )
    return F.transform(F.array(starts), spans)[0]


def valid_row(input_ids: Column, loss_mask: Column, starts: Column) -> Column:
    """Whether a packed row holds: equal lengths, the first boundary 0, boundaries rising within the row."""
    rising = F.forall(upto(F.size(starts)), lambda i: F.element_at(starts, i) >= F.element_at(starts, F.greatest(i - 1, F.lit(1))))
    return (F.size(input_ids) == F.size(loss_mask)) & (F.size(starts) > 0) & (F.try_element_at(starts, F.lit(1)) == 0) & rising & (F.try_element_at(starts, F.lit(-1)) < F.size(input_ids))


def kinds_of(a: Column, kinds: list[int]) -> tuple[Column, Column]:
    """How many items are of the given kinds, and which of these there are, in order."""
    found = F.filter(a, lambda x: x.isin(*kinds))
    return long(F.size(found)), F.array_sort(F.array_distinct(found))
