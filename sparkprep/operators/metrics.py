"""Analytics of training metrics: losses, intervals, throughput, convergence and norms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.arrays import sequence_counts


def masked_loss(loss: Column, mask: Column) -> tuple[Column, Column]:
    """Aggregates: the sum of loss over unmasked tokens and their number."""
    return F.sum(loss * mask), F.sum(mask).cast("long")


def perplexity(loss: Column, most: float = 20.0) -> Column:
    return F.exp(F.least(loss, F.lit(most)))


def by_interval(series: DataFrame, step: Column, interval: int, loss: Column, skipped: Column) -> DataFrame:
    """One row for each log interval: mean of losses that count, and numbers of advanced, skipped and NaN steps."""
    bad = F.isnan(loss)
    return series.groupBy(F.floor(step / interval).cast("long").alias("interval")).agg(
        F.avg(F.when(~skipped & ~bad, loss)).alias("mean_loss"),
        F.sum((~skipped).cast("long")).alias("advanced"),
        F.sum(skipped.cast("long")).alias("skipped"),
        F.sum(bad.cast("long")).alias("nan_steps"),
    )


def throughput_window(series: DataFrame, step: str, seconds: Column, window: int, batch: int, tokens: int, ranks: int, group: str) -> DataFrame:
    """Batches, samples and tokens a second over the last ``window`` steps of each group, and for each rank; steps with too
    short a history or no time passed go. Each run (group) is one window partition."""
    order = Window.partitionBy(group).orderBy(step)
    passed = seconds - F.lag(seconds, window - 1).over(order)
    rated = series.withColumn("passed", passed).where("passed > 0")
    each = F.lit(float(window - 1)) / F.col("passed")
    return rated.select(group, step, each.alias("batches_per_s"), (each * batch).alias("samples_per_s"), (each * batch * tokens).alias("tokens_per_s"), (each * batch * tokens / ranks).alias("tokens_per_s_rank"))


@dataclass(frozen=True)
class Tolerances:
    """Limits of a comparison of loss curves; relative tolerances are (from what golden value on, tolerance), the first that holds."""

    tiers: tuple[tuple[float, float], ...] = ((2.0, 0.10), (0.5, 0.05), (float("-inf"), 0.02))
    correlation: float = 0.95
    final: float = 0.03
    outliers: float = 0.1
    deviations: float = 3.0
    skipped: float = 0.0


def convergence(pairs: DataFrame, step: str, current: str, golden: str, limits: Tolerances = Tolerances()) -> DataFrame:
    """One row: correlation, failed_share (points outside of their tier's tolerance), final_difference, outliers (share of differences over
    three deviations), deviation, and passed. A first share of steps may be skipped; curves are ordered by ``step``."""
    if limits.skipped > 0:
        pairs = from_place(pairs, step, int(pairs.count() * limits.skipped))
    a, b = F.col(current), F.col(golden)
    tier = None
    for low, tolerance in limits.tiers:
        tier = F.when(b > low, tolerance) if tier is None else tier.when(b > low, tolerance)
    relative = F.when(b != 0, F.abs(a - b) / F.abs(b)).otherwise(F.abs(a))
    totals = pairs.agg(F.corr(current, golden).alias("correlation"), F.avg((relative > tier).cast("double")).alias("failed_share"), F.max_by(F.struct(a.alias("a"), b.alias("b")), step).alias("last"), F.avg(a - b).alias("mean"), F.stddev_pop(a - b).alias("deviation"))
    found = totals.select("*", F.when(F.col("last.b") != 0, F.abs(F.col("last.a") - F.col("last.b")) / F.col("last.b")).otherwise(F.abs("last.a")).alias("final_difference")).first()  # one row
    odd = F.abs(a - b - F.lit(found["mean"])) > limits.deviations * F.lit(found["deviation"])
    one = pairs.agg(F.avg(odd.cast("double")).alias("outliers"))
    kept = [F.lit(found[c]).cast("double").alias(c) for c in ("correlation", "failed_share", "final_difference", "deviation")]
    passed = (F.col("correlation") >= limits.correlation) & (F.col("failed_share") <= limits.outliers) & (F.col("final_difference") <= limits.final) & (F.col("outliers") <= limits.outliers)
    return one.select(*kept, "outliers").withColumn("passed", passed)


def from_place(rows: DataFrame, order: str, place: int) -> DataFrame:
    """The rows from a 0-based place on in the order of a column without ties: a top-k selection finds where they begin."""
    if place <= 0:
        return rows
    low = rows.select(order).orderBy(order).limit(place + 1).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("low")).first()
    return rows.where(F.col(order) >= low["low"]) if low["n"] > place else rows.where(F.lit(False))


def upto_place(rows: DataFrame, order: str, place: int) -> DataFrame:
    """The rows before a 0-based place."""
    high = rows.select(order).orderBy(order).limit(place).agg(F.max(order)).first()[0] if place > 0 else None
    return rows.where(F.col(order) <= high) if high is not None else rows.where(F.lit(False))


def steady_means(series: DataFrame, step: str, values: list[str], skipped: float = 0.1, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: the means of columns over a stretch of steps without NaN. The stretch begins behind a first share of steps, one at least, or at ``start``."""
    first = max(1, int(series.count() * skipped)) if start is None else start
    kept = from_place(series if end is None else upto_place(series, step, end), step, first)
    return kept.agg(*(F.avg(F.when(~F.isnan(v), F.col(v))).alias(v) for v in values))


def regression(series: DataFrame, step: str, current: str, golden: str, tolerance: float = 0.05, **stretch: float) -> DataFrame:
    """One row: the signed relative difference of two runs' steady means, and whether it is within the tolerance either way."""
    means = steady_means(series, step, [current, golden], **stretch)
    difference = relative_difference(F.col(current), F.col(golden))
    return means.select(F.col(current), F.col(golden), difference.alias("difference"), (F.abs(difference) <= tolerance).alias("passed"))


def packed_averages(rows: DataFrame, starts: str, total: Column, order: str, batch: int | None = None) -> DataFrame:
    """One row: sequences a row, tokens a row, squared length of a sequence, squares of a row, without end tokens.

    With ``batch``, rows behind the last whole batch in the order of ``order`` are left out. No rows, or none with a sequence, are an error.
    """
    if batch:
        # The rows behind the last whole batch are fewer than a batch: a top-k selection finds where they begin.
        extra = rows.count() % batch
        low = rows.select(order).orderBy(F.desc(order)).limit(extra).agg(F.min(order)).first()[0] if extra else None
        rows = rows if low is None else rows.where(F.col(order) < low)
    counts, whole = sequence_counts(F.col(starts), total)
    held = rows.select(F.size(starts).alias("n"), whole.alias("t"), F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x * x).alias("q"))
    sums = held.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("q").alias("q"))
    checked = F.when(F.col("rows") == 0, F.raise_error("no rows to process")).when(F.col("n") == 0, F.raise_error("no sequences to average")).otherwise(F.lit(True)).cast("boolean")
    return sums.where(checked).select((F.col("n") / F.col("rows")).alias("sequences_per_row"), (F.col("t") / F.col("rows")).alias("tokens_per_row"), (F.col("q") / F.col("n")).alias("squared_length"), (F.col("q") / F.col("rows")).alias("squares_per_row"))


def adapter_facts(adapters: DataFrame, target: str, rank: str, default: int | None = None) -> DataFrame:
    """(target, rank) of adapters whose rank isn't the default; a target with several ranks is an error when it is read."""
    held = adapters.groupBy(target).agg(F.min(rank).alias("rank"), F.max(rank).alias("most"))
    bad = F.concat(F.lit("several ranks of "), F.col(target))
    checked = held.select(target, F.when(F.col("rank") == F.col("most"), F.col("rank")).otherwise(F.raise_error(bad).cast("long")).alias("rank"))
    return checked if default is None else checked.where(F.col("rank") != default)


def norms(values: DataFrame, name: str, value: Column) -> DataFrame:
    """(name, norm): the L2 norm of each parameter, and of all under a null name, in one pass by grouping sets."""
    return values.rollup(name).agg(F.sqrt(F.sum(value * value)).alias("norm"))


def relative_difference(value: Column, base: Column) -> Column:
    """(value - base) / base; null for a base of 0."""
    return F.when(base != 0, (value - base) / base)


#: What training logs print, by name (fixed by the log's format).
LOG_PATTERNS = {
    "iteration": r"iteration\s+(\d+)/\s+\d+",
    "elapsed time per iteration (ms)": r"elapsed time per iteration \(ms\):\s+([\d.]+)",
    "lm loss": r"lm loss:\s+([\d.E+\-]+)",
    "GPU utilization": r"GPU utilization:\s+([\d.]+)",
    "step time": r"Step Time :\s+([\d.]+)s",
    "grad norm": r"grad norm:\s+([\d.]+|nan|inf)",
    "alloc": r"mem-allocated-gigabytes:\s*([\d\.]+)",
    "max_alloc": r"mem-max-allocated-gigabytes:\s*([\d\.]+)",
    "max_reserved": r"mem-max-reserved-gigabytes:\s*([\d\.]+)",
}


def log_values(lines: DataFrame, line: str, patterns: dict[str, str]) -> DataFrame:
    """(other columns, metric, nth, value) for every match of a pattern in a line."""
    named = lambda k: lambda v, i: F.struct(F.lit(k).alias("metric"), i.cast("long").alias("nth"), v.cast("double").alias("value"))
    found = [F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(1)), named(k)) for k, p in patterns.items()]
    return lines.select(*[c for c in lines.columns if c != line], F.inline(F.concat(*found)))


def log_series(lines: DataFrame, number: str, line: str, metric: str, patterns: dict[str, str] = LOG_PATTERNS) -> DataFrame:
    """(step, value) of a metric of a log whose lines are numbered: the k-th value belongs to the k-th iteration, which announces the step before it.

    ``max_reserved`` is the largest of all, ``alloc`` and ``max_alloc`` the first: one row with a null step.
    """
    values = log_values(lines, line, {k: p for k, p in patterns.items() if k in (metric, "iteration")})
    if metric == "max_reserved":
        return values.where(F.col("metric") == metric).agg(F.max("value").alias("value")).select(F.lit(None).cast("long").alias("step"), "value")
    first = values.where("nth = 0")
    if metric in ("alloc", "max_alloc"):
        return first.where(F.col("metric") == metric).agg(F.min_by("value", number).alias("value")).select(F.lit(None).cast("long").alias("step"), "value")
    # One log is one order: its values are numbered by one task, as many as the log has iterations.
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("metric").orderBy(number)))
    steps = ranked.where("metric = 'iteration'").select("k", (F.col("value").cast("long") - 1).alias("step"))
    return ranked.where(F.col("metric") == metric).select("k", "value").join(steps, "k").select("step", "value")


def islands(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """Adds ``island``: a number that rises when ``value`` changes, in the order of each group."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("long"), F.lit(1))
    return rows.withColumn("changed", changed).withColumn("island", F.sum("changed").over(w)).drop("changed")


def remaining(elapsed: Column, done: Column) -> Column:
    """Time left of a run by the share of it that is done and the time that took; null before anything is done."""
    return F.when(done > 0, elapsed / done * (1 - done))


def throughputs(series: DataFrame, group: str, order: str, work: Column, seconds: Column) -> DataFrame:
    """Adds (job, cumulative): work a second since the step before, and since the group's first step; null for the first."""
    w = Window.partitionBy(group).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begin, passed = F.first(seconds).over(upto), seconds - F.lag(seconds).over(w)
    done = F.sum(work).over(upto) - F.first(work).over(upto)
    return series.withColumns({"job": F.when(passed > 0, work / passed), "cumulative": F.when(seconds > begin, done / (seconds - begin))})


def job_start(lines: DataFrame, number: str, line: str, world: int) -> DataFrame:
    """(start, start_work, saved_work) of a progress log whose lines are numbered: when the first job since the world last had another size
    began, the work saved by then, and the work saved in all.

    Lines are tab-separated: time, job, world size, event, and further fields, of which the eighth is the work. A checkpoint that is saved asynchronously counts
    once its end is logged. One log is one order, so one task reads it; a log without such a job has null for its start.
    """
    f = F.split(F.trim(line), "\t")
    value = lambda i: F.substring_index(F.get(f, F.lit(i)), ": ", -1)
    parsed = lines.select(F.col(number).alias("n"), F.get(f, F.lit(0)).alias("time"), value(2).cast("long").alias("world"), F.get(f, F.lit(3)).alias("event"), value(7).cast("double").alias("work"))
    w = Window.orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begun = parsed.withColumns({"saves": F.sum((F.col("event") == "Saving async checkpoint").cast("long")).over(upto), "pending": F.last(F.when(F.col("event") == "Saving async checkpoint", F.col("work")), True).over(upto)})
    ends = begun.withColumn("ends", F.sum((F.col("event") == "Saved async checkpoint").cast("long")).over(Window.partitionBy("saves").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    committed = F.when(F.col("event") == "Saved checkpoint", F.col("work")).when((F.col("event") == "Saved async checkpoint") & (F.col("saves") > 0) & (F.col("ends") == 1), F.col("pending"))
    held = ends.withColumn("saved", F.coalesce(F.last(committed, True).over(upto), F.lit(0.0))).withColumn("other", F.max(F.when(F.col("world") != world, F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = F.when((F.col("event") == "Starting job") & (F.col("world") == world) & (F.col("n") > F.coalesce("other", F.lit(-1))), F.struct("n", "time", "saved"))
    return held.agg(F.min(first).alias("s"), F.max_by("saved", "n").alias("saved_work")).select(F.col("s.time").alias("start"), F.col("s.saved").alias("start_work"), "saved_work")


def loss_flags(series: DataFrame, step: str, loss: str, factor: float = 10.0) -> DataFrame:
    """Adds (is_bad, is_spike): a loss that is NaN or infinite, and one of over ``factor`` times the largest good one so far."""
    good = F.when(~F.isnan(loss) & (F.abs(loss) != float("inf")), F.col(loss))
    largest = F.max(good).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    return series.withColumns({"is_bad": good.isNull(), "is_spike": F.coalesce(good > factor * largest, F.lit(False))})


def whole_norm(parameters: DataFrame, name: str, value: Column, expert: Column, rank: str) -> DataFrame:
    """(group, squares) of dense and expert parameters, and all under a null group with the norm: a dense one that several ranks hold counts once,
    an expert counts for each rank that holds its own."""
    held = parameters.withColumns({"g_": F.when(expert, "expert").otherwise("dense"), "r_": F.when(expert, F.col(rank))}).groupBy("g_", name, "r_").agg(F.max(value).alias("v"))
    return held.rollup(F.col("g_").alias("group")).agg(F.sum(F.col("v") * F.col("v")).alias("squares")).withColumn("norm", F.sqrt("squares"))


def rank_extents(rows: DataFrame, group: str, value: Column, ran: Column) -> DataFrame:
    """(group, largest, all_ran, least, median) over what ranks report; nulls are ranks that report nothing. The median is the lower of two middles."""
    held = rows.select(group, value.alias("v_"), ran.alias("ran_"))
    return held.groupBy(group).agg(F.max("v_").alias("largest"), F.bool_and("ran_").alias("all_ran"), F.min("v_").alias("least"), F.expr("percentile_disc(0.5) within group (order by v_)").alias("median"))


def encoded_max(value: Column, none: int = -1) -> Column:
    """Aggregate: the largest value over ranks where ``none`` stands for no value; null if no rank has one."""
    return F.max(F.when(value != none, value))
