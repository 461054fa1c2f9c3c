"""Queries over inputs, recordings, readouts and lanes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import stored
from . import events as E
from . import features as X
from .registry import EDGE, SPK, edges, neurons, query, spikes, table

TRACE = f"""{SPK}, tr AS (SELECT neuron, row_number() OVER (PARTITION BY neuron ORDER BY t_us, event_id) - 1 AS step, coalesce(value, 0.0) AS v FROM spk)"""


def traces(spark, sf_dir):
    """Values of each neuron's events as a recorded trace."""
    s = spikes(spark, sf_dir)
    return s.select("neuron", (F.row_number().over(E.order()) - 1).alias("step"), F.coalesce("value", F.lit(0.0)).alias("v"))


@query(f"WITH {TRACE} SELECT neuron, round(max(v) - arg_min(v, step), 9) AS height, min(CASE WHEN v = top THEN step END) AS peak_step FROM (SELECT *, max(v) OVER (PARTITION BY neuron) AS top FROM tr) GROUP BY neuron")
def psp_height(spark, sf_dir):
    """Height over the first value, and the first step of the peak."""
    t = traces(spark, sf_dir).withColumn("top", F.max("v").over(W.partitionBy("neuron")))
    return t.groupBy("neuron").agg(F.round(F.max("v") - F.min_by("v", "step"), 9).alias("height"), F.min(F.when(F.col("v") == F.col("top"), F.col("step"))).alias("peak_step"))


@query(f"WITH {TRACE}, n AS (SELECT neuron, max(step) AS last FROM tr GROUP BY neuron) SELECT tr.neuron, step, v FROM tr JOIN n USING (neuron) WHERE (step >= 10 AND (step - 10) % 5 = 0) OR (last < 10 AND step = last)")
def readout_schedule(spark, sf_dir):
    """Steps from a start on, every fifth; the last step where a trace ends before the start."""
    t = traces(spark, sf_dir).withColumn("last", F.max("step").over(W.partitionBy("neuron")))
    return t.where("(step >= 10 and (step - 10) % 5 = 0) or (last < 10 and step = last)").select("neuron", "step", "v")


@query(f"WITH {TRACE} SELECT step, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(max(v), 6) AS most, round(avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END), 9) AS recent FROM tr GROUP BY step")
def state_statistics(spark, sf_dir):
    """Potential over all neurons in each step, and the share of them that are high."""
    return traces(spark, sf_dir).groupBy("step").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.max("v"), 6).alias("most"), F.round(F.avg((F.col("v") > 50).cast("double")), 9).alias("recent"))


@query(f"WITH {TRACE} SELECT round(quantile_cont(v, 0.005), 6) AS low, round(quantile_cont(v, 0.995), 6) AS high, CAST(ceil(sqrt(count(DISTINCT neuron))) AS BIGINT) AS side FROM tr")
def video_range(spark, sf_dir):
    """Colour range of a recording and the side of the grid that shows all neurons."""
    return traces(spark, sf_dir).agg(F.round(F.percentile("v", F.lit(0.005)), 6).alias("low"), F.round(F.percentile("v", F.lit(0.995)), 6).alias("high"), F.ceil(F.sqrt(F.count_distinct("neuron"))).cast("long").alias("side"))


POPULATIONS = (("input", 0, 100), ("hidden", 100, 900), ("output", 900, 1_000_000_000))


@query(f"WITH p(population, first, past) AS (VALUES {', '.join(map(str, POPULATIONS))}) SELECT c_custkey AS neuron, population, c_custkey - first AS index_in_population FROM customer JOIN p ON c_custkey >= first AND c_custkey < past")
def population_of_neuron(spark, sf_dir):
    """Ranges of neurons looked up by a chain of comparisons: populations are few, neurons many."""
    n = neurons(spark, sf_dir)
    name, first = F.lit(None).cast("string"), F.lit(None).cast("int")
    for p, a, b in POPULATIONS:
        inside = F.col("neuron").between(a, b - 1)
        name, first = F.when(inside, p).otherwise(name), F.when(inside, a).otherwise(first)
    return n.select("neuron", name.alias("population"), (F.col("neuron") - first).alias("index_in_population")).where("population is not null")


@query("""WITH e AS (SELECT o_custkey AS neuron, o_orderkey AS entry, o_orderpriority AS input, o_totalprice / 100000 AS weight FROM orders)
SELECT c_custkey AS neuron, count(entry) AS n_entries, round(coalesce(sum(weight), 0), 7) AS total FROM customer LEFT JOIN e ON neuron = c_custkey GROUP BY c_custkey""")
def input_sum_per_neuron(spark, sf_dir):
    """Inputs of every neuron summed; neurons without any get 0."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("neuron"), "o_orderkey", (F.col("o_totalprice") / 100000).alias("weight"))
    per = e.groupBy("neuron").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return neurons(spark, sf_dir).join(per, "neuron", "left").select("neuron", F.coalesce("n", F.lit(0)).alias("n_entries"), F.round(F.coalesce("w", F.lit(0.0)), 7).alias("total"))


@query("""WITH f AS (SELECT vec_id, (i - 1) % 16 AS slot, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)) SELECT vec_id, CAST(slot AS INTEGER) AS slot, round(avg(v), 6) AS drive FROM f GROUP BY vec_id, slot""")
def input_projection_mean(spark, sf_dir):
    """Many features on each of 16 input neurons, by their mean."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return each.groupBy("vec_id", (F.col("i") % 16).alias("slot")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("drive"))


@query("SELECT vec_id, step, round(CASE WHEN step BETWEEN 2 AND 6 THEN abs(CAST(embedding[1] AS DOUBLE)) * 3 ELSE 0.0 END, 6) AS drive FROM embeddings, range(10) t(step)")
def drive_envelope(spark, sf_dir):
    """Input that is on from step 2 to step 6."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("step"))
    return rows.select("vec_id", "step", F.round(F.when(F.col("step").between(2, 6), F.col("x") * 3).otherwise(0.0), 6).alias("drive"))


@query("SELECT vec_id, embedding IS NOT NULL AS kept, round(list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 65) IF i % 3 = 1]), 5) AS total FROM embeddings")
def feature_mask(spark, sf_dir):
    """Features of a mask only."""
    kept = F.filter(F.transform("embedding", lambda v: v.cast("double")), lambda v, i: i % 3 == 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", kept.isNotNull().alias("kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS class, CASE WHEN label = i - 1 THEN 1.0 ELSE 0.0 END AS target FROM embeddings, range(1, 11) t(i)")
def one_hot_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(X.one_hot(F.col("label"), 10)).alias("class", "target"))


@query(f"WITH {EDGE}, f AS (SELECT proto, min((src, dst)) AS first FROM edge GROUP BY proto) SELECT proto AS synapse, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS number FROM f")
def registered_synapses(spark, sf_dir):
    """Synapses numbered in the order that they are first used."""
    f = edges(spark, sf_dir).groupBy(F.col("proto").alias("synapse")).agg(F.min(F.struct("src", "dst")).alias("first"))
    return f.select("synapse", (F.row_number().over(W.orderBy("first")) - 1).cast("long").alias("number"))  # a handful of kinds


@query(f"WITH {EDGE} SELECT src, dst FROM edge WHERE delay = 1 UNION SELECT s, dst FROM (SELECT dst, min(src) AS s FROM edge GROUP BY dst)")
def connections_to_check(spark, sf_dir):
    """Connections listed one by one and those sampled for each target, together."""
    e = edges(spark, sf_dir)
    return e.where("delay = 1").select("src", "dst").unionByName(e.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")).distinct()


COEFFICIENTS = "co AS (SELECT l_linenumber AS plane, CAST(l_suppkey % 40 AS INTEGER) AS lane, CAST(sum(CASE WHEN l_suppkey % 40 > l_linenumber * 4 THEN l_quantity ELSE 0 END) AS BIGINT) AS c FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {COEFFICIENTS} SELECT lane, count(*) FILTER (c <> 0) AS planes, min(plane) FILTER (c <> 0) = max(plane) FILTER (c <> 0) AS owned FROM co GROUP BY lane HAVING count(*) FILTER (c <> 0) > 0")
def lane_owners(spark, sf_dir):
    """Lanes in use: one that a single plane uses is that plane's own."""
    li = table(spark, sf_dir, "lineitem")
    lane = (F.col("l_suppkey") % 40).cast("int")
    co = li.groupBy(F.col("l_linenumber").alias("plane"), lane.alias("lane")).agg(F.sum(F.when(lane > F.col("l_linenumber") * 4, F.col("l_quantity")).otherwise(0)).cast("long").alias("c"))
    used = co.where("c <> 0").groupBy("lane").agg(F.count("*").alias("planes"), (F.min("plane") == F.max("plane")).alias("owned"))
    return used


@query("""WITH s AS (SELECT p_partkey AS plane, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size END AS searched FROM part), m AS (SELECT max(searched) AS most, 12 * count(*) AS cap FROM s),
b AS (SELECT plane, CAST(ceil(CASE WHEN searched = 0 THEN most ELSE searched END * 1.25) AS BIGINT) AS wanted FROM s, m),
h AS (SELECT h, (SELECT sum(least(wanted, h)) FROM b) AS whole FROM range(1, 65) t(h)), l AS (SELECT coalesce(max(h) FILTER (whole <= cap), 1) AS level, coalesce(max(cap - whole) FILTER (whole <= cap AND whole = (SELECT max(whole) FROM h, m WHERE whole <= cap)), 0) AS spare FROM h, m),
r AS (SELECT plane, wanted, row_number() OVER (PARTITION BY wanted > level ORDER BY plane DESC) AS n, level, spare FROM b, l)
SELECT plane, wanted, CASE WHEN wanted > level AND n <= spare THEN level + 1 ELSE least(wanted, level) END AS lanes FROM r""")
def lane_budgets(spark, sf_dir):
    """Lanes of each plane: a quarter more than were found, as many as the largest for a plane that starts at zero; cut, the largest first, to a cap of 12 a plane."""
    from .factorise import budgets

    part = table(spark, sf_dir, "part")
    searched = part.select(F.col("p_partkey").alias("plane"), F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(F.col("p_size")).alias("searched"))
    return budgets(searched, 0.25, 12 * part.count())


@query(f"WITH {SPK}, c AS (SELECT neuron, event_type, count(*) AS n FROM spk GROUP BY 1, 2) SELECT event_type, count(*) AS neurons, round(avg(n / 43200.0::DOUBLE), 9) AS mean_rate, round(stddev_samp(n / 43200.0::DOUBLE), 9) AS std_rate FROM c GROUP BY event_type")
def spike_statistics(spark, sf_dir):
    """Rates per tick of the neurons of each kind."""
    c = spikes(spark, sf_dir).groupBy("neuron", "event_type").agg((F.count("*") / 43200.0).alias("rate"))
    return c.groupBy("event_type").agg(F.count("*").alias("neurons"), F.round(F.avg("rate"), 9).alias("mean_rate"), F.round(F.stddev_samp("rate"), 9).alias("std_rate"))


@query("""WITH l AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS a, stddev_pop(CAST(embedding[2] AS DOUBLE)) AS s, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, round(a - 0.1 * s - 0.001 * n, 6) AS score, CAST(rank() OVER (ORDER BY round(a - 0.1 * s - 0.001 * n, 6) DESC, label) AS BIGINT) AS place FROM l""")
def candidate_score(spark, sf_dir):
    """Candidates scored with penalties for spread and cost, and ranked."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(at(0)) - F.stddev_pop(at(1)) * 0.1 - F.count("*") * 0.001, 6).alias("score"))
    return c.select("label", "score", F.rank().over(W.orderBy(F.desc("score"), "label")).cast("long").alias("place"))  # a row for each class


@query("""WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS BIGINT) AS type, CAST(CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS BIGINT) AS extends FROM nation),
r(type, ancestor, depth) AS (SELECT type, extends, 1 FROM n WHERE extends IS NOT NULL UNION ALL SELECT r.type, n.extends, depth + 1 FROM r JOIN n ON n.type = r.ancestor WHERE n.extends IS NOT NULL) SELECT type, ancestor, depth FROM r""")
def extends_chain(spark, sf_dir):
    """All ancestors of each type, a join for each link of the longest chain."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("type"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 3)).cast("long").alias("extends"))
    n = stored(n, "types")
    step = n.where("extends is not null").select("type", F.col("extends").alias("ancestor"), F.lit(1).alias("depth"))
    out, up = step, n.where("extends is not null").select(F.col("type").alias("ancestor"), F.col("extends").alias("above"))
    while step.head(1):  # as often as the longest chain has links
        step = stored(step.join(up, "ancestor").select("type", F.col("above").alias("ancestor"), (F.col("depth") + 1).alias("depth")), "chain")
        out = out.unionByName(step)
    return out


@query("""WITH f AS (SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS pixel, greatest(0, CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i))
SELECT pixel, count(*) FILTER (v > 0) AS active, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-6, 6) AS std FROM f GROUP BY pixel""")
def sparse_pixel_statistics(spark, sf_dir):
    """Activity of each input, for a readout without a network."""
    v = F.greatest(F.lit(0.0), F.col("v").cast("double"))
    f = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pixel", "v")).select("pixel", v.alias("v"))
    return f.groupBy("pixel").agg(F.count_if(F.col("v") > 0).alias("active"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v") + 1e-6, 6).alias("std"))
