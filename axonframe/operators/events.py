"""Operators over spikes: rows of (neuron, t_us, event_id) or (neuron, tick)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(*more: str):
    return W.partitionBy("neuron").orderBy("t_us", *more, "event_id")


def counts_per_neuron(spikes: DataFrame, neurons: DataFrame) -> DataFrame:
    """Spikes of every neuron; silent ones have 0."""
    n = spikes.groupBy("neuron").agg(F.count("*").alias("n_spikes"))
    return neurons.join(n, "neuron", "left").select("neuron", F.coalesce("n_spikes", F.lit(0)).alias("n_spikes"))


def rates(spikes: DataFrame, neurons: DataFrame, seconds: float) -> DataFrame:
    """Mean rate over all neurons, and the share of neurons that spiked: one row."""
    per = counts_per_neuron(spikes, neurons)
    return per.agg(
        F.round(F.when(F.count("*") > 0, F.sum("n_spikes") / (F.count("*") * seconds)).otherwise(0.0), 12).alias("mean_rate_hertz"),
        F.round(F.coalesce(F.avg((F.col("n_spikes") > 0).cast("double")), F.lit(0.0)), 9).alias("fraction_spiked"),
    )


def intervals(spikes: DataFrame) -> DataFrame:
    """Time from each spike of a neuron to its next one, in seconds."""
    gap = (F.col("t_us") - F.lag("t_us").over(order())) / 1e6
    return spikes.select("neuron", "event_id", gap.alias("isi")).where("isi is not null")


def interval_cv(spikes: DataFrame) -> DataFrame:
    """Per neuron the number, mean and coefficient of variation (sample deviation over mean) of its intervals."""
    return intervals(spikes).groupBy("neuron").agg(
        F.count("*").alias("n_intervals"),
        F.round(F.avg("isi"), 6).alias("mean_isi"),
        F.round(F.when((F.count("*") > 1) & (F.avg("isi") > 0), F.stddev_samp("isi") / F.avg("isi")).otherwise(0.0), 6).alias("cv"),
    )


def prefix_sums(table: DataFrame, key: str, block: Column, *values: str) -> DataFrame:
    """Running sums of ``values`` in order of the distinct ``key``, without one task that sorts everything.

    ``block`` is an expression of the key that never falls as the key grows: sums
    within blocks and over the few block totals add up to the whole.
    """
    own = W.partitionBy("_block").orderBy(key)
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    parts = table.withColumn("_block", block)
    totals = parts.groupBy("_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    totals = totals.select("_block", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    return parts.join(totals, "_block").select(*table.columns, *[(F.sum(v).over(own) + F.col(f"_{v}")).alias(f"{v}_sum") for v in values])


def ks_statistic(samples: DataFrame, alpha: float = 0.001) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov of ``samples`` (which 0 or 1, value): the largest gap of the distributions and its critical value."""
    each = samples.groupBy("value").agg(F.count_if(F.col("which") == 0).alias("a"), F.count_if(F.col("which") == 1).alias("b"))
    sums = prefix_sums(each, "value", F.floor("value"), "a", "b")
    n = samples.agg(F.count_if(F.col("which") == 0).alias("n"), F.count_if(F.col("which") == 1).alias("m"))
    gap = F.abs(F.col("a_sum") / F.col("n") - F.col("b_sum") / F.col("m"))
    critical = F.sqrt(F.lit(-0.5) * F.log(F.lit(alpha / 2))) * F.sqrt((F.max("n") + F.max("m")) / (F.max("n") * F.max("m")))
    return sums.crossJoin(F.broadcast(n)).agg(F.round(F.max(gap), 9).alias("statistic"), F.round(critical, 9).alias("critical"))


def seconds_to_ticks(seconds: Column, dt: float) -> Column:
    """Whole ticks, halves away from zero."""
    return F.round(seconds / F.lit(dt)).cast("long")


def time_of_tick(tick: Column, dt: float) -> Column:
    """Seconds; divides by the ticks a second where they are whole, which is exact."""
    whole = round(1 / dt)
    return tick / F.lit(float(whole)) if whole and abs(whole * dt - 1) < 1e-12 else tick * F.lit(dt)


def to_ticks(spikes: DataFrame, dt: float) -> DataFrame:
    return spikes.withColumn("tick", seconds_to_ticks(F.col("t_us") / 1e6, dt))


def last_spiked(ticks: DataFrame) -> DataFrame:
    """Of rows (neuron, tick, spiked) the tick of the last spike so far, -1 before the first."""
    w = W.partitionBy("neuron").orderBy("tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ticks.withColumn("last_spiked", F.coalesce(F.max(F.when(F.col("spiked"), F.col("tick"))).over(w), F.lit(-1)))


def refractory(last: Column, tick: Column, dt: float, duration: float, inclusive: bool = False) -> Column:
    since = (tick - last) * F.lit(dt)
    return (last >= 0) & ((since <= duration) if inclusive else (since < duration))


def active(last: Column, tick: Column, window: int) -> Column:
    """Within ``window`` ticks of the last spike."""
    return (last >= 0) & (tick - last <= window)


def exponential_trace(last: Column, tick: Column, tau: float) -> Column:
    return F.when(last >= 0, F.exp(-(tick - last) / F.lit(tau))).otherwise(0.0)


def raster(spikes: DataFrame, bin_us: int) -> DataFrame:
    """Spikes of each neuron in each time bin."""
    return spikes.groupBy("neuron", F.floor(F.col("t_us") / bin_us).alias("bin")).agg(F.count("*").alias("n"))


def fold_leaky(values: DataFrame, key: str, by: list[str], x: str, keep: float) -> DataFrame:
    """State of a leaky integrator ``s = keep * s + x`` after all rows of a key in order of ``by``."""
    rows = F.array_sort(F.collect_list(F.struct(*by, x)))
    return values.groupBy(key).agg(rows.alias("r")).select(key, F.aggregate("r", F.lit(0.0), lambda s, r: s * F.lit(keep) + r[x]).alias("state"))


def fold_threshold(values: DataFrame, key: str, by: list[str], x: str, keep: float, threshold: float) -> DataFrame:
    """As :func:`fold_leaky`, but the state falls to 0 and counts a spike where it passes ``threshold``."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def step(a, r):
        v = a["s"] * F.lit(keep) + r[x]
        return F.struct(F.when(v > threshold, 0.0).otherwise(v).alias("s"), (a["n"] + F.when(v > threshold, 1).otherwise(0)).alias("n"))

    rows = F.array_sort(F.collect_list(F.struct(*by, x)))
    return values.groupBy(key).agg(F.aggregate(rows, start, step).alias("a")).select(key, F.col("a.s").alias("state"), F.col("a.n").alias("n_spikes"))
