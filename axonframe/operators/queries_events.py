"""Queries over events as spikes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import three_decimals
from . import events as E
from .registry import SPK, edges, EDGE, neurons, query, spikes, table

SECONDS = 86_400.0
#: Ticks of a minute, for queries that need a coarse clock.
MINUTE = 60.0


@query(f"WITH {SPK} SELECT c_custkey AS neuron, count(event_id) AS n_spikes FROM customer LEFT JOIN spk ON c_custkey = neuron GROUP BY c_custkey")
def spike_counts_per_neuron(spark, sf_dir):
    return E.counts_per_neuron(spikes(spark, sf_dir), neurons(spark, sf_dir))


@query(f"""WITH {SPK}, n AS (SELECT c_custkey, count(event_id) AS k FROM customer LEFT JOIN spk ON c_custkey = neuron GROUP BY c_custkey)
SELECT round(sum(k) / (count(*) * {SECONDS}), 12) AS mean_rate_hertz, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END), 9) AS fraction_spiked FROM n""")
def mean_firing_rate(spark, sf_dir):
    return E.rates(spikes(spark, sf_dir), neurons(spark, sf_dir), SECONDS)


@query(f"""WITH {SPK}, i AS (SELECT neuron, event_id, (t_us - lag(t_us) OVER (PARTITION BY neuron ORDER BY t_us, event_id)) / 1e6 AS isi FROM spk)
SELECT neuron, event_id, isi FROM i WHERE isi IS NOT NULL""")
def interspike_intervals(spark, sf_dir):
    return E.intervals(spikes(spark, sf_dir))


@query(f"""WITH {SPK}, i AS (SELECT neuron, (t_us - lag(t_us) OVER (PARTITION BY neuron ORDER BY t_us, event_id)) / 1e6 AS isi FROM spk)
SELECT neuron, count(*) AS n_intervals, round(avg(isi), 6) AS mean_isi, round(CASE WHEN count(*) > 1 AND avg(isi) > 0 THEN stddev_samp(isi) / avg(isi) ELSE 0.0 END, 6) AS cv
FROM i WHERE isi IS NOT NULL GROUP BY neuron""")
def interval_cv(spark, sf_dir):
    return E.interval_cv(spikes(spark, sf_dir))


@query("""WITH s AS (SELECT value, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS which FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
n AS (SELECT count(*) FILTER (which = 0) AS n, count(*) FILTER (which = 1) AS m FROM s),
v AS (SELECT value, count(*) FILTER (which = 0) AS a, count(*) FILTER (which = 1) AS b FROM s GROUP BY value),
c AS (SELECT sum(a) OVER w AS a, sum(b) OVER w AS b FROM v WINDOW w AS (ORDER BY value))
SELECT round(max(abs(a / n - b / m)), 9) AS statistic, round(sqrt(-0.5 * ln(0.001 / 2)) * sqrt((max(n) + max(m)) / (max(n) * max(m))), 9) AS critical FROM c, n""")
def ks_two_event_types(spark, sf_dir):
    rows = spikes(spark, sf_dir).where("event_type in ('click', 'view') and value is not null")
    return E.ks_statistic(rows.select((F.col("event_type") != "click").cast("int").alias("which"), "value"))


@query(f"WITH {SPK} SELECT event_id, CAST(round(t_us / 1e6 / {MINUTE}) AS BIGINT) AS tick, round(t_us / 1e6 / {MINUTE}) * {MINUTE} AS tick_time FROM spk")
def spikes_to_ticks(spark, sf_dir):
    ticks = E.to_ticks(spikes(spark, sf_dir), MINUTE)
    return ticks.select("event_id", "tick", E.time_of_tick(F.col("tick"), MINUTE).alias("tick_time"))


GRID = f"""{SPK}, g AS (SELECT neuron, CAST(round(t_us / 1e6 / {MINUTE}) AS BIGINT) AS tick, bool_or(event_type = 'click') AS spiked FROM spk GROUP BY 1, 2),
l AS (SELECT *, coalesce(max(CASE WHEN spiked THEN tick END) OVER (PARTITION BY neuron ORDER BY tick ROWS UNBOUNDED PRECEDING), -1) AS last_spiked FROM g)"""


def grid(spark, sf_dir):
    ticks = E.to_ticks(spikes(spark, sf_dir), MINUTE).groupBy("neuron", "tick").agg(F.bool_or(F.col("event_type") == "click").alias("spiked"))
    return E.last_spiked(ticks)


@query(f"WITH {GRID} SELECT neuron, tick, last_spiked FROM l")
def last_spiked_per_tick(spark, sf_dir):
    return grid(spark, sf_dir).drop("spiked")


@query(f"WITH {GRID} SELECT neuron, tick, last_spiked >= 0 AND (tick - last_spiked) * {MINUTE} < 3600 AS refractory FROM l")
def refractory_gate(spark, sf_dir):
    return grid(spark, sf_dir).select("neuron", "tick", E.refractory(F.col("last_spiked"), F.col("tick"), MINUTE, 3600.0).alias("refractory"))


@query(f"WITH {GRID} SELECT neuron, tick FROM l WHERE last_spiked >= 0 AND tick - last_spiked <= 30")
def active_window_gate(spark, sf_dir):
    return grid(spark, sf_dir).where(E.active(F.col("last_spiked"), F.col("tick"), 30)).select("neuron", "tick")


@query(f"WITH {GRID} SELECT neuron, tick, round(CASE WHEN last_spiked >= 0 THEN exp(-(tick - last_spiked) / 120.0::DOUBLE) ELSE 0.0 END, 9) AS trace FROM l")
def exponential_trace(spark, sf_dir):
    return grid(spark, sf_dir).select("neuron", "tick", F.round(E.exponential_trace(F.col("last_spiked"), F.col("tick"), 120.0), 9).alias("trace"))


@query(f"WITH {GRID} SELECT neuron, tick, spiked FROM l WHERE tick % 10 = 0")
def stride_sample(spark, sf_dir):
    return grid(spark, sf_dir).where("tick % 10 = 0").select("neuron", "tick", "spiked")


@query(f"WITH {SPK} SELECT neuron, min(t_us) AS first_us, arg_min(event_id, (t_us, event_id)) AS event_id FROM spk GROUP BY neuron")
def first_spike(spark, sf_dir):
    return spikes(spark, sf_dir).groupBy("neuron").agg(F.min("t_us").alias("first_us"), F.min_by("event_id", F.struct("t_us", "event_id")).alias("event_id"))


@query(f"WITH {SPK} SELECT neuron, t_us // 3600000000 AS bin, count(*) AS n FROM spk GROUP BY 1, 2")
def raster_bins(spark, sf_dir):
    return E.raster(spikes(spark, sf_dir), 3_600_000_000)


SELECTIONS = "s AS (SELECT c_custkey AS neuron, c_mktsegment || '/' || c_custkey AS selection FROM customer WHERE c_custkey % 3 = 0)"


def selected(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("neuron"), F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")).alias("selection"))
    return spikes(spark, sf_dir).join(chosen, "neuron")


@query(f"WITH {SPK}, {SELECTIONS} SELECT event_id, printf('%.3f', t_us / 1e6) || chr(9) || selection AS line FROM spk JOIN s USING (neuron)")
def spike_selection_time_id(spark, sf_dir):
    return selected(spark, sf_dir).select("event_id", F.concat(three_decimals(F.col("t_us") / 1e6), F.lit("\t"), "selection").alias("line"))


@query(f"WITH {SPK}, {SELECTIONS} SELECT event_id, selection || chr(9) || printf('%.3f', t_us / 1e6) AS line FROM spk JOIN s USING (neuron)")
def spike_selection_id_time(spark, sf_dir):
    return selected(spark, sf_dir).select("event_id", F.concat("selection", F.lit("\t"), three_decimals(F.col("t_us") / 1e6)).alias("line"))


@query(f"""WITH {SPK}, b AS (SELECT t_us // 3600000000 AS bin, event_type FROM spk)
SELECT bin, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM b GROUP BY bin""")
def pivot_traces(spark, sf_dir):
    b = spikes(spark, sf_dir).select(F.floor(F.col("t_us") / 3_600_000_000).alias("bin"), "event_type")
    wide = b.groupBy("bin").pivot("event_type", ["click", "purchase", "view"]).count()
    return wide.na.fill(0)


@query("""SELECT o_custkey, list_reduce(list_prepend(0.0::DOUBLE, list(o_totalprice ORDER BY o_orderdate, o_orderkey)), lambda a, x: a * 0.5::DOUBLE + x) AS state FROM orders GROUP BY o_custkey""")
def leaky_integrator_fold(spark, sf_dir):
    return E.fold_leaky(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 0.5)


@query("""WITH r AS (SELECT o_custkey, list({'s': o_totalprice, 'n': 0} ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey, list_reduce(list_prepend({'s': 0.0::DOUBLE, 'n': 0}, l), lambda a, x: {'s': CASE WHEN a.s * 0.9::DOUBLE + x.s > 400000 THEN 0.0::DOUBLE ELSE a.s * 0.9::DOUBLE + x.s END, 'n': a.n + CASE WHEN a.s * 0.9::DOUBLE + x.s > 400000 THEN 1 ELSE 0 END}) AS a FROM r)
SELECT o_custkey, a.s AS state, a.n AS n_spikes FROM f""")
def threshold_reset_fold(spark, sf_dir):
    return E.fold_threshold(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 0.9, 400_000.0)


DELIVERY = f"""WITH {SPK}, {EDGE}, k AS (SELECT neuron, CAST(round(t_us / 1e6 / {MINUTE}) AS BIGINT) AS tick, event_id FROM spk),
d AS (SELECT dst, tick + delay AS arrival, event_id, weight FROM k JOIN edge ON neuron = src)"""


def deliveries(spark, sf_dir):
    """Spikes sent along all connections: each arrives its delay later."""
    sent = E.to_ticks(spikes(spark, sf_dir), MINUTE).select("neuron", "tick", "event_id")
    e = edges(spark, sf_dir)
    return sent.join(e, sent.neuron == e.src).select("dst", (F.col("tick") + F.col("delay")).alias("arrival"), "event_id", "weight")


@query(f"{DELIVERY} SELECT dst, arrival, round(sum(weight), 6) AS current FROM d GROUP BY dst, arrival")
def delayed_delivery(spark, sf_dir):
    return deliveries(spark, sf_dir).groupBy("dst", "arrival").agg(F.round(F.sum("weight"), 6).alias("current"))


@query(f"""{DELIVERY}, g AS (SELECT dst, arrival, sum(CAST(round(weight * 1e8) AS BIGINT)) AS w FROM d GROUP BY dst, arrival)
SELECT dst, arrival, CAST(sum(w) OVER (PARTITION BY dst ORDER BY arrival) AS BIGINT) AS total FROM g""")
def weighted_arrival_running_sum(spark, sf_dir):
    g = deliveries(spark, sf_dir).groupBy("dst", "arrival").agg(F.sum(F.round(F.col("weight") * 1e8).cast("long")).alias("w"))
    return g.select("dst", "arrival", F.sum("w").over(W.partitionBy("dst").orderBy("arrival")).alias("total"))


@query(f"{DELIVERY} SELECT dst, count(*) AS n_arrivals FROM d GROUP BY dst")
def arrival_counts(spark, sf_dir):
    return deliveries(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("n_arrivals"))


#: Inputs that act while delay <= t < delay + duration, in hours of the day.
PULSES = (("early", 1.0, 6.0, 2.5), ("noon", 11.5, 1.25, -1.0), ("long", 4.0, 14.0, 0.5), ("never", 3.0, 0.0, 9.0))


@query(f"""WITH {SPK}, p(pulse, delay, duration, amplitude) AS (VALUES {', '.join(str(p) for p in PULSES)}), h AS (SELECT event_id, (t_us % 86400000000) / 3.6e9 AS t FROM spk)
SELECT pulse, count(*) AS n, round(sum(amplitude), 6) AS total FROM h JOIN p ON t >= delay AND t < delay + duration GROUP BY pulse""")
def pulse_window_range_join(spark, sf_dir):
    h = spikes(spark, sf_dir).select("event_id", ((F.col("t_us") % 86_400_000_000) / 3.6e9).alias("t"))
    p = spark.createDataFrame(PULSES, "pulse string, delay double, duration double, amplitude double")  # a handful of rows
    return h.join(F.broadcast(p), F.expr("t >= delay and t < delay + duration")).groupBy("pulse").agg(F.count("*").alias("n"), F.round(F.sum("amplitude"), 6).alias("total"))


@query(f"""WITH {SPK}, b AS (SELECT neuron, t_us // 3600000000 AS bin, count(*) AS n FROM spk GROUP BY 1, 2),
d AS (SELECT neuron, n, abs(n - lag(n) OVER (PARTITION BY neuron ORDER BY bin)) AS diff FROM b)
SELECT neuron, round(stddev_pop(n), 9) AS temporal_std, round(avg(diff), 9) AS mean_abs_diff, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 9) AS active_fraction FROM d GROUP BY neuron""")
def dynamics_health(spark, sf_dir):
    b = E.raster(spikes(spark, sf_dir), 3_600_000_000)
    b = b.withColumn("diff", F.abs(F.col("n") - F.lag("n").over(W.partitionBy("neuron").orderBy("bin"))))
    return b.groupBy("neuron").agg(F.round(F.stddev_pop("n"), 9).alias("temporal_std"), F.round(F.avg("diff"), 9).alias("mean_abs_diff"), F.round(F.avg((F.col("n") > 1).cast("double")), 9).alias("active_fraction"))


@query(f"""WITH {SPK}, b AS (SELECT neuron, t_us // 3600000000 AS bin, count(*) AS n FROM spk GROUP BY 1, 2)
SELECT neuron, bin, n, round(avg(n) OVER (PARTITION BY neuron), 9) AS static_mean, first(n) OVER (PARTITION BY neuron ORDER BY bin) AS first_frame,
row_number() OVER (PARTITION BY neuron ORDER BY (bin * 48271 + 12345) % 2147483647, bin) AS shuffled FROM b""")
def temporal_controls(spark, sf_dir):
    b, w = E.raster(spikes(spark, sf_dir), 3_600_000_000), W.partitionBy("neuron")
    return b.select(
        "neuron", "bin", "n", F.round(F.avg("n").over(w), 9).alias("static_mean"), F.first("n").over(w.orderBy("bin")).alias("first_frame"),
        F.row_number().over(w.orderBy((F.col("bin") * 48271 + 12345) % 2147483647, "bin")).alias("shuffled"),
    )
