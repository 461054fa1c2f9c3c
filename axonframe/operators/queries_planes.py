"""Queries over values of connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import graph as G
from . import planes as P
from .registry import EDGE, ORD, edges, query, table

UPDATES = """updates AS (SELECT l_linenumber % 3 AS plane, CAST((l_orderkey * 31 + l_partkey) % 5000 AS BIGINT) AS ordinal, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS delta FROM lineitem),
deltas AS (SELECT plane, ordinal, CAST(sum(delta) AS BIGINT) AS delta FROM updates GROUP BY plane, ordinal HAVING sum(delta) <> 0)"""


def updates(spark, sf_dir):
    """A queue of changes, several for an edge."""
    li = table(spark, sf_dir, "lineitem")
    delta = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    return li.select((F.col("l_linenumber") % 3).alias("plane"), ((F.col("l_orderkey") * 31 + F.col("l_partkey")) % 5000).alias("ordinal"), delta.alias("delta"))


@query(f"WITH {UPDATES} SELECT * FROM deltas")
def compact_deltas(spark, sf_dir):
    return P.compact(updates(spark, sf_dir))


@query(f"WITH {EDGE}, {UPDATES}, e AS (SELECT count(*) AS e FROM edge), n AS (SELECT plane, count(*) AS n FROM deltas GROUP BY plane) SELECT round(max(n) / max(e)::DOUBLE, 12) AS occupancy, max(n) / max(e)::DOUBLE >= 0.2 AS refit_due FROM n, e")
def occupancy_and_refit_due(spark, sf_dir):
    return P.occupancy(P.compact(updates(spark, sf_dir)), edges(spark, sf_dir).count(), 0.2)


@query(f"WITH {UPDATES} SELECT plane, count(*) AS n, CAST(sum(delta) AS BIGINT) AS total, CAST(sum(delta * delta) AS BIGINT) AS squares FROM deltas GROUP BY plane")
def plane_update_sums(spark, sf_dir):
    return P.compact(updates(spark, sf_dir)).groupBy("plane").agg(F.count("*").alias("n"), F.sum("delta").alias("total"), F.sum(F.col("delta") * F.col("delta")).alias("squares"))


@query(f"WITH {ORD}, {UPDATES} SELECT p.plane, ord.ordinal, round(weight + coalesce(delta, 0), 9) AS value FROM ord CROSS JOIN (SELECT CAST(unnest(range(3)) AS INTEGER) AS plane) p LEFT JOIN deltas d ON d.plane = p.plane AND d.ordinal = ord.ordinal")
def plane_read_with_deltas(spark, sf_dir):
    values = G.ordinals(edges(spark, sf_dir)).select(F.explode(F.array(*map(F.lit, range(3)))).alias("plane"), "ordinal", F.col("weight").alias("value"))
    return P.with_deltas(values, P.compact(updates(spark, sf_dir))).withColumn("value", F.round("value", 9))


@query(f"WITH {EDGE} SELECT round(avg(weight), 9) AS mean, round(stddev_pop(weight), 9) AS std, round(sqrt(avg(weight * weight)), 9) AS rms, round(min(weight), 9) AS least, round(max(weight), 9) AS most FROM edge")
def weight_stats(spark, sf_dir):
    return P.stats(edges(spark, sf_dir))


@query(f"WITH {EDGE}, r AS (SELECT sqrt(avg(weight * weight)) AS rms FROM edge) SELECT src, dst, round(weight * 2.5::DOUBLE / greatest(rms, 1e-12), 6) AS weight FROM edge, r")
def scale_to_rms(spark, sf_dir):
    return P.scale_to_rms(edges(spark, sf_dir), 2.5).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.e AS u, b.e AS w FROM v a JOIN v b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM v))
SELECT src, dst, round(list_sum(list_transform(range(1, 65), lambda i: u[i] * (0.5 + (i - 1) % 4) * w[i])), 6) AS value FROM p""")
def low_rank_plane(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("lanes"))
    n = e.agg(F.count("*").alias("n"))
    pairs = e.select(F.col("vec_id").alias("src")).crossJoin(F.broadcast(n)).select("src", ((F.col("src") * 7 + 3) % F.col("n")).alias("dst"))
    return P.low_rank(pairs, rows, rows, [0.5 + i % 4 for i in range(64)]).withColumn("value", F.round("value", 6))


FIT = f"""{EDGE}, r AS (SELECT src, avg(weight) AS r FROM edge GROUP BY src), c AS (SELECT dst, avg(weight) AS c FROM edge GROUP BY dst), a AS (SELECT avg(weight) AS a FROM edge),
fit AS (SELECT src, dst, weight, r + c - a AS fit FROM edge JOIN r USING (src) JOIN c USING (dst), a)"""


@query(f"WITH {FIT} SELECT src, dst, round(fit, 6) AS fit FROM fit")
def row_col_mean_start(spark, sf_dir):
    return P.mean_start(edges(spark, sf_dir)).select("src", "dst", F.round("fit", 6).alias("fit"))


@query(f"WITH {FIT}, q AS (SELECT sqrt(avg(weight * weight)) AS rms FROM fit) SELECT round(max(abs(fit - weight) / greatest(abs(weight), rms)), 9) AS worst_error FROM fit, q")
def worst_relative_error(spark, sf_dir):
    return P.worst_error(P.mean_start(edges(spark, sf_dir)))


@query(f"WITH {EDGE}, w AS (SELECT CASE WHEN src % 97 = 0 THEN 'nan'::DOUBLE ELSE weight END AS w FROM edge) SELECT round(sqrt(avg(w * w) FILTER (NOT isnan(w))), 9) AS rms, count(*) FILTER (isnan(w)) AS n_not_finite FROM w")
def plane_rms_finite(spark, sf_dir):
    w = edges(spark, sf_dir).select(F.when(F.col("src") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("weight")).alias("w"))
    fine = ~F.isnan("w") & (F.abs("w") < float("inf"))
    return w.agg(F.round(F.sqrt(F.avg(F.when(fine, F.col("w") * F.col("w")))), 9).alias("rms"), F.count_if(~fine).alias("n_not_finite"))


@query(f"WITH {EDGE} SELECT src, dst, CAST(greatest(1, round(delay + weight)) AS BIGINT) AS delay_ticks FROM edge")
def edge_delay_ticks(spark, sf_dir):
    return edges(spark, sf_dir).select("src", "dst", F.greatest(F.lit(1), F.round(F.col("delay") + F.col("weight")).cast("long")).alias("delay_ticks"))
