"""Operators over values of connections: planes, sparse deltas and low-rank products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(updates: DataFrame) -> DataFrame:
    """Queued updates (plane, ordinal, delta) summed; exact zeros go."""
    return updates.groupBy("plane", "ordinal").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def with_deltas(values: DataFrame, deltas: DataFrame) -> DataFrame:
    """Values (plane, ordinal, value) with their deltas added."""
    return values.join(deltas, ["plane", "ordinal"], "left").select("plane", "ordinal", (F.col("value") + F.coalesce("delta", F.lit(0))).alias("value"))


def occupancy(deltas: DataFrame, edges: int, threshold: float) -> DataFrame:
    """Largest share of edges with a delta over all planes, and whether a refit is due; a threshold of 0 or less never is."""
    per = deltas.groupBy("plane").agg(F.count("*").alias("n"))
    share = F.coalesce(F.max("n"), F.lit(0)) / F.lit(float(max(1, edges)))
    return per.agg(F.round(share, 12).alias("occupancy"), ((share >= threshold) & F.lit(threshold > 0)).alias("refit_due"))


def stats(values: DataFrame, column: str = "weight") -> DataFrame:
    """Mean, population deviation, root mean square and extremes; all 0 where there is nothing."""
    x, zero = F.col(column), F.lit(0.0)
    return values.agg(*[F.round(F.coalesce(v, zero), 9).alias(n) for n, v in (("mean", F.avg(x)), ("std", F.stddev_pop(x)), ("rms", F.sqrt(F.avg(x * x))), ("least", F.min(x)), ("most", F.max(x)))])


def scale_to_rms(values: DataFrame, target: float, column: str = "weight", least: float = 1e-12) -> DataFrame:
    """``column`` times target / max(rms, least), so that its root mean square is ``target``."""
    if target < 0:
        raise ValueError("a root mean square can't be negative")
    rms = values.agg(F.sqrt(F.avg(F.col(column) * F.col(column))).alias("_rms"))
    return values.crossJoin(F.broadcast(rms)).withColumn(column, F.col(column) * F.lit(target) / F.greatest("_rms", F.lit(least))).drop("_rms")


def dot(*arrays: Column) -> Column:
    """Sum of the products of equal places."""
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(out, F.lit(0.0), lambda s, x: s + x)


def low_rank(edges: DataFrame, u: DataFrame, v: DataFrame, coefficients: list[float]) -> DataFrame:
    """Value of each edge from rows ``u`` of sources and ``v`` of targets (node, lanes)."""
    rows = edges.join(u.select(F.col("node").alias("src"), F.col("lanes").alias("_u")), "src").join(v.select(F.col("node").alias("dst"), F.col("lanes").alias("_v")), "dst")
    return rows.withColumn("value", dot(F.col("_u"), F.array(*map(F.lit, coefficients)), F.col("_v"))).drop("_u", "_v")


def mean_start(edges: DataFrame, column: str = "weight") -> DataFrame:
    """First fit of each edge: mean of its source and mean of its target less the mean of all."""
    rows = edges.groupBy("src").agg(F.avg(column).alias("_row"))
    cols = edges.groupBy("dst").agg(F.avg(column).alias("_col"))
    whole = edges.agg(F.avg(column).alias("_all"))
    return edges.join(rows, "src").join(cols, "dst").crossJoin(F.broadcast(whole)).withColumn("fit", F.col("_row") + F.col("_col") - F.col("_all")).drop("_row", "_col", "_all")


def worst_error(fitted: DataFrame, value: str = "weight", fit: str = "fit") -> DataFrame:
    """Largest |fit - value| / max(|value|, rms of the plane)."""
    rms = fitted.agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_rms"))
    error = F.abs(F.col(fit) - F.col(value)) / F.greatest(F.abs(value), F.col("_rms"), F.lit(1e-300))
    return fitted.crossJoin(F.broadcast(rms)).agg(F.round(F.coalesce(F.max(error), F.lit(0.0)), 9).alias("worst_error"))
