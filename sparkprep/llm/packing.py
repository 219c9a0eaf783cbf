"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces of one length are interchangeable, so the whole problem is a histogram of at most ``capacity`` lengths, whatever the
corpus. A solution is a list of bin patterns (lengths, how many such bins). Islands of solutions evolve in Spark tasks: a
crossover injects whole well-filled bins of one parent into the other, takes out the bins that hold pieces twice, and puts
displaced pieces back by best fit, whose bins a short random search completes; after each round every island gets its neighbour's elite. The best plan assigns each
piece by its rank within its length, so pieces are never gathered: a piece's rank is its number within its task plus the
counts of the tasks before.

A null text is empty and has one token, the end. Every row of ``docs`` is packed, also rows that repeat a doc_id. Only documents of
more than ``capacity`` tokens are cut; their first piece takes the remainder. An empty table gives no rows. Columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import arrow_rows, materialise
from sparkprep.llm.tokens import Encoder

CAPACITY = 2048
END_ID = 0
ISLANDS, ROUNDS, OFFSPRING, POPULATION = 6, 3, 4, 4
#: Choices that the search for a bin's best filling sees.
NODES = 400
#: A bin is well filled if at most this share of it is free.
WELL_FILLED = 0.01

#: Lengths in falling order, and how many bins are filled so.
Bins = list[tuple[tuple[int, ...], int]]


def fullest(free: int, lengths: list[int], left: dict[int, int], used: Counter[int], random: np.random.Generator, nodes: int = NODES) -> list[int]:
    """Pieces that fill ``free`` best, of those that a search over ``nodes`` choices sees; a random tenth of choices is passed over."""
    best, chosen = [free, []], []
    skipped = iter((random.random(nodes) < 0.1).tolist())

    def go(k: int, free: int) -> None:
        if free < best[0]:
            best[:] = [free, chosen[:]]
        k = min(k, bisect_right(lengths, free) - 1)
        while k >= 0 and best[0] > 0:
            n = lengths[k]
            if left[n] > used[n]:
                passed = next(skipped, None)
                if passed is None:
                    return
                if not passed:
                    used[n] += 1
                    chosen.append(n)
                    go(k, free - n)
                    chosen.pop()
                    used[n] -= 1
            k -= 1

    go(len(lengths) - 1, free)
    return best[1]


def best_fit(counts: dict[int, int], capacity: int, random: np.random.Generator | None = None) -> Bins:
    """Bins for all pieces: the longest piece left opens a bin, and the longest that fits what is free follows.

    Bins that come out alike are made at once, so the work grows with the different lengths and not with the pieces. With
    ``random``, bins that this leaves with room are completed by a search, which differs from one draw to the next.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    bins: Bins = []
    while lengths:
        free, pattern, used = capacity, [], Counter()
        k = len(lengths) - 1
        while k >= 0 and free > 0:
            k = min(k, bisect_right(lengths, free) - 1)
            if k < 0:
                break
            n = lengths[k]
            take = min(left[n] - used[n], free // n)
            if take > 0:
                pattern += [n] * take
                used[n] += take
                free -= n * take
            k -= 1
        if random is not None and free and len(pattern) > 1:
            more = fullest(capacity - pattern[0], lengths, left, Counter(pattern[:1]), random)
            if sum(more) > sum(pattern[1:]):
                pattern = [pattern[0], *more]
                used = Counter(pattern)
        times = min(left[n] // u for n, u in used.items())
        bins.append((tuple(pattern), times))
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect_right(lengths, n) - 1)
    return bins


def number(bins: Bins) -> int:
    return sum(times for _, times in bins)


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the sum of squared fillings."""
    return -number(bins), sum(times * (sum(pattern) / capacity) ** 2 for pattern, times in bins)


def crossover(a: Bins, b: Bins, counts: dict[int, int], capacity: int, random: np.random.Generator) -> Bins:
    """A child of ``a`` with whole well-filled bins of ``b``."""
    left = Counter(counts)
    child: Bins = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        used = Counter(pattern)
        times = min(times, *(left[n] // u for n, u in used.items()))
        if times > 0:
            child.append((pattern, times))
            for n, u in used.items():
                left[n] -= u * times

    full = [x for x in b if sum(x[0]) >= capacity * (1 - WELL_FILLED)]
    for i in random.permutation(len(full))[: random.integers(1, len(full) + 1) if full else 0]:
        put(full[i][0], int(random.integers(1, full[i][1] + 1)))
    # Bins of a that hold pieces already placed go; a random share of its poorly filled bins is displaced too.
    for pattern, times in sorted(a, key=lambda x: -sum(x[0])):
        if sum(pattern) >= capacity * (1 - WELL_FILLED) or random.random() < 0.5:
            put(pattern, times)
    return child + best_fit(left, capacity, random)


def evolve(population: list[Bins], counts: dict[int, int], capacity: int, seed: int, offspring: int = OFFSPRING) -> list[Bins]:
    random = np.random.default_rng(seed)
    for _ in range(offspring):
        i, j = random.integers(0, len(population), 2)
        population = [*population, crossover(population[i], population[j], counts, capacity, random)]
    return sorted(population, key=lambda x: fitness(x, capacity), reverse=True)[:POPULATION]


def shuffled_fit(counts: dict[int, int], capacity: int, random: np.random.Generator) -> Bins:
    """A first solution that differs: a random share of each length is packed before the rest."""
    some = {n: int(random.integers(0, c + 1)) if random.random() < 0.2 else c for n, c in counts.items()}
    return best_fit(some, capacity, random) + best_fit({n: c - some[n] for n, c in counts.items()}, capacity, random)


def solve(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, seed: int = 42) -> Bins:
    """The best plan that the islands find; they stop early at a number of bins that no plan can beat.

    Plans have a few thousand patterns at most, as lengths are bounded, so islands may hand theirs to the driver.
    """
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    least = max(least, sum(c for n, c in counts.items() if 2 * n > capacity))
    elites: list[list[Bins]] = [[best_fit(counts, capacity)] for _ in range(ISLANDS)]
    for round_ in range(ROUNDS):
        sent = [elites[i] + elites[i - 1][:1] for i in range(ISLANDS)]  # each island gets its neighbour's elite

        def live(rows: Iterator[pa.RecordBatch], sent: list[list[Bins]] = sent, round_: int = round_) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for i in batch.column(0).to_pylist():
                    random = np.random.default_rng([seed, i])
                    start = sent[i] if round_ else [*sent[i], *(shuffled_fit(counts, capacity, random) for _ in range(POPULATION - 1))]
                    for k, bins in enumerate(evolve(start, counts, capacity, seed + 1000 * round_ + i)):
                        flat = [x for pattern, times in bins for x in (len(pattern), times, *pattern)]
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([k], pa.int32()), pa.array([flat], pa.list_(pa.int64()))], ["island", "k", "bins"])

        elites = [[] for _ in range(ISLANDS)]
        for row in sorted(spark.range(0, ISLANDS, 1, ISLANDS).mapInArrow(live, "island long, k int, bins array<long>").collect(), key=lambda r: (r[0], r[1])):
            flat, at, bins = row["bins"], 0, []
            while at < len(flat):
                bins.append((tuple(flat[at + 2 : at + 2 + flat[at]]), flat[at + 1]))
                at += 2 + flat[at]
            elites[row["island"]].append(bins)
        best = max((x for island in elites for x in island), key=lambda x: fitness(x, capacity))
        if number(best) == least:  # no plan has fewer
            break
    return best


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth numbers the pieces of one length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = Encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in arrow_rows(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if k else 0
                    length = end - start
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start:end].tobytes()), task, seen[length]))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def slots(bins: Bins) -> dict[int, np.ndarray]:
    """For each length, the ranges of ranks that the patterns take: (first rank, first sequence, pieces in a bin, offset)."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for pattern, times in bins:
        offset = 0
        for n, u in Counter(pattern).items():
            ranges.setdefault(n, []).append((used[n], sequence, u, offset))
            used[n] += u * times
            offset += n * u
        sequence += times
    return {n: np.array(x, np.int64) for n, x in ranges.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity), "pieces")
    counted = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}  # a row for each length
    ranges = slots(solve(spark, counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                held = ranges[n]
                row = held[np.searchsorted(held[:, 0], ranks[at], side="right") - 1]
                k = ranks[at] - row[:, 0]
                sequence[at] = row[:, 1] + k // row[:, 2]
                offset[at] = row[:, 3] + k % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
